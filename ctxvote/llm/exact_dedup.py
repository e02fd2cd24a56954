"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Each document's digest goes to one of `FAN ** rounds` runs, dealt evenly over rows, so that a digest shared by a third
of the corpus is spread over all runs.  A run is one partition's rows sorted by digest and merged to one entry per
digest, with the surviving identifier and the number of rows.  Then the partitions exchange runs in binomial rounds:
in round r the `FAN` runs whose numbers differ in digit r alone deal their entries among themselves by digit r of the
digest, and each merges the `FAN` sorted parts that it receives, entry by entry, retaining the verified identifier.
After the last round a run holds all digests that begin with its number.  A merge meets at most `FAN` entries of a
digest, and no run ever holds more than its share of the digests.  The winners go back down to the first runs.

A digest entry is verified: beside SHA-256 it carries the byte length and an independent 64-bit hash of the text,
and entries merge only when all three agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, own_rows, partitions_of

#: Runs that one merge takes: a hexadecimal digit of the digest a round.
FAN = 16

_KEY = ["digest", "n_bytes", "check"]


def rounds_for(partitions: int) -> int:
    """Rounds of the exchange: at least as many runs as partitions, and two rounds."""
    return max(2, math.ceil(math.log(max(partitions, 1), FAN) - 1e-9))


def fingerprints(docs: DataFrame, rounds: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(row, doc_id, digest, n_bytes, check, run)`: the verified digest of each whole text, and its first run."""
    rows = own_rows(docs, id_col, text_col)
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").alias("n_bytes"),
        F.xxhash64("text").alias("check"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(FAN**rounds)).cast("int").alias("run"),
    )


def _merged(entries: DataFrame, keep: str) -> DataFrame:
    """Runs by their numbers: each in one partition, sorted by digest, equal entries next to each other merged.

    The aggregation buffer holds a struct, so Spark merges in the order of the sort and builds no hash table.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    runs = entries.repartition(partitions_of(entries.sparkSession), "run").sortWithinPartitions("run", *_KEY)
    return runs.groupBy("run", *_KEY).agg(best("winner").alias("winner"), F.sum("group_size").alias("group_size"))


def merge_tree(prints: DataFrame, rounds: int, keep: str = "smallest") -> tuple[DataFrame, DataFrame]:
    """(entries of the first runs, entries of the merged ones): `run, *_KEY, winner, group_size`.

    `winner` holds the retained identifier behind a flag by which identifiers come before nulls, and its row.
    """
    flag = F.col("doc_id").isNull() if keep == "smallest" else F.col("doc_id").isNotNull()
    entries = prints.select("run", *_KEY, F.struct(flag.alias("flag"), F.col("doc_id").alias("id"), "row").alias("winner"), F.lit(1).cast("long").alias("group_size"))
    level = leaf = cut(_merged(entries, keep))
    for r in range(rounds):
        level = _merged(level.withColumn("run", _dealt(F.col("run"), F.col("digest"), r)), keep)
    return leaf, level


def _dealt(run: Column, digest: Column, r: int) -> Column:
    """The number of a run with digit `r` replaced by that of a digest."""
    digit = F.conv(F.substring(F.hex(digest), r + 1, 1), 16, 10).cast("int")
    return (run + (digit - F.floor(run / FAN**r).cast("int") % FAN) * FAN**r).cast("int")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: `doc_id, keep_id, group_size, kept, text_sha256, text_key`.

    Texts are equal when identical; a null text is empty, and empty texts equal each other.  The row with the
    smallest (`keep="largest"`: largest) id of a group stays.  Very long texts are hashed whole.  Rows without an id lose to any row that has one; in
    a group of rows without ids, one stays and keep_id is null.  Of rows that repeat id and text, one is marked as
    kept.  `text_key` is `xxhash64` of the text.  An empty table gives no rows; other columns are not read.
    """
    rounds = rounds_for(partitions_of(docs.sparkSession))
    prints = cut(fingerprints(docs, rounds, id_col, text_col))
    leaf, root = merge_tree(prints, rounds, keep)
    # A digest has one entry in a first run, so the way down is never skewed; single texts need no way down.
    winners = root.where("group_size > 1").select(*_KEY, "winner", "group_size")
    down = winners.join(leaf.select(*_KEY, "run"), _KEY)
    rows = prints.join(down, [*_KEY, "run"], "left")
    alone = F.col("group_size").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("winner.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("winner.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("check").alias("text_key"),
    )
