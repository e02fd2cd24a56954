"""Data set construction and sampling (A-11 to A-13, O-8 to O-11, F-11, J-13, K-6)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hashed(entries: DataFrame, key: str, seed: int) -> DataFrame:
    """`entries` with `_h`, whose order decides a split; rows without a key are in no split."""
    return entries.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))).where("_h is not null")


def split_cut(entries: DataFrame, share: float = 0.8, key: str = "entry_id", seed: int = 42) -> tuple[str, object, int, int] | None:
    """(`_h`, key, train rows of that key, all rows of that key) of the last of the first floor(share * n) rows in the
    seeded hash order; None where that is no row.

    Keys fall into 65,536 ranges of the hash; the ranges' counts tell in which one the cut falls, and only that range
    is ordered.
    """
    keys = _hashed(entries.select(key), key, seed).withColumn("_range", F.substring("_h", 1, 4))
    sizes = sorted(keys.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # 65,536 rows at most
    left = math.floor(share * sum(r.n for r in sizes))
    for r in sizes:
        if 0 < left <= r.n:
            rows = keys.where(F.col("_range") == r["_range"]).groupBy("_h", key).agg(F.count(F.lit(1)).alias("n"))
            ranked = rows.withColumn("_upto", F.sum("n").over(Window.orderBy("_h", key)))  # one range only
            last = ranked.where(F.col("_upto") >= left).orderBy("_h", key).first()
            return last["_h"], last[key], left - last["_upto"] + last["n"], last["n"]
        left -= r.n
    return None


def split_exact(entries: DataFrame, share: float = 0.8, key: str = "entry_id", seed: int = 42, keys: DataFrame | None = None) -> DataFrame:
    """O-8: `entries` with `train`: exactly floor(share * n) rows, chosen by a seeded hash order.

    Rows are compared with the cut where they stand, so none is shuffled; where the cut falls among rows of one key,
    those are numbered.  `keys` has the same keys where they can be had with less work.
    """
    cut = split_cut(entries if keys is None else keys, share, key, seed)
    rows = _hashed(entries, key, seed)
    if cut is None:
        return rows.withColumn("train", F.lit(False)).drop("_h")
    h, last, first_n, n = cut
    last = F.lit(last).cast(entries.schema[key].dataType)
    tied = (F.col("_h") == h) & (F.col(key) == last)
    ahead = (F.col("_h") < h) | ((F.col("_h") == h) & (F.col(key) < last))
    if first_n < n:
        number = F.row_number().over(Window.partitionBy(key).orderBy("_h"))
        return rows.where(~tied).withColumn("train", ahead).union(rows.where(tied).withColumn("train", number <= first_n)).drop("_h")
    return rows.withColumn("train", ahead | tied).drop("_h")


def sequence_key(tokens: Column) -> Column:
    """A-11: what makes sequences equal."""
    return F.sha2(F.array_join(tokens, " "), 256)


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """A-11: `group_key, first_id, n` of equal token sequences."""
    return entries.groupBy(sequence_key(F.col("tokens")).alias("group_key")).agg(F.min("entry_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def label_votes(entries: DataFrame, label_type: str = "type") -> DataFrame:
    """`group_key, var, label, n_votes` over the members of a group; labels that are not human vote too."""
    rows = entries.select(sequence_key(F.col("tokens")).alias("group_key"), F.explode(F.try_element_at("labels", F.lit(label_type))).alias("var", "_l"))
    return rows.groupBy("group_key", "var", F.col("_l.label").alias("label")).agg(F.count(F.lit(1)).alias("n_votes"))


def majority(votes: DataFrame) -> DataFrame:
    """A-12: `group_key, var, label, n_labels`: the most frequent label, ties to the smaller one.

    Where the two first tie, share their first 45 bytes, both are longer than that, and the first has no
    `__anon_ty`, the longer one wins.
    """
    order = Window.partitionBy("group_key", "var").orderBy(F.desc("n_votes"), "label")
    every = Window.partitionBy("group_key", "var")
    ranked = votes.select("*", F.row_number().over(order).alias("_r"), F.lead("label").over(order).alias("_l2"), F.lead("n_votes").over(order).alias("_n2"), F.count(F.lit(1)).over(every).alias("n_labels"))
    head = lambda c: F.substring(F.encode(c, "UTF-8"), 1, 45)
    longer = (F.col("n_votes") == F.col("_n2")) & (F.octet_length("label") > 45) & (F.octet_length("_l2") > 45) & (head("label") == head("_l2"))
    longer = longer & ~F.contains("label", F.lit("__anon_ty")) & (F.octet_length("_l2") > F.octet_length("label"))
    return ranked.where("_r = 1").select("group_key", "var", F.when(longer, F.col("_l2")).otherwise(F.col("label")).alias("label"), "n_labels")


def conflicts(majority: DataFrame) -> DataFrame:
    """A-13: how many groups disagree on some name whose winner lacks `__anon_ty`."""
    return majority.where((F.col("n_labels") > 1) & ~F.contains("label", F.lit("__anon_ty"))).select(F.countDistinct("group_key").alias("n_conflicts"))


def create_dataset(entries: DataFrame, share: float = 0.8, seed: int = 42, label_type: str = "type") -> DataFrame:
    """O-10, O-11: one entry per group of equal sequences, with `train`.

    A group of several takes its first member's tokens and meta and the majority labels, all human; a single entry
    stays as it is, its `raw` line too where the corpus has one.
    """
    keyed = entries.withColumn("group_key", sequence_key(F.col("tokens")))
    groups = duplicate_groups(entries)
    first = keyed.join(groups.select("group_key", F.col("first_id").alias("entry_id"), "n"), ["group_key", "entry_id"])
    votes = label_votes(entries, label_type).join(groups.where("n > 1").select("group_key"), "group_key", "left_semi")
    label = F.struct(F.lit(True).alias("human"), F.col("label").alias("label"))
    voted = majority(votes).groupBy("group_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("var").alias("key"), label.alias("value"))))).alias("_m"))
    out = first.join(voted, "group_key", "left")
    merged = F.when(F.col("n") > 1, F.create_map(F.lit(label_type), F.coalesce("_m", F.lit(None)))).otherwise(F.col("labels"))
    columns = [c for c in entries.columns if c != "labels"]
    if "raw" in columns:
        out = out.withColumn("raw", F.when(F.col("n") == 1, F.col("raw")))
    return split_exact(out.select(*columns, merged.alias("labels"), F.col("n").alias("n_members")), share, seed=seed, keys=first)


def in_list(members: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """F-11, J-13: members whose key a list holds."""
    return members.join(listed.select(key).distinct(), key, "left_semi")


def listed_and_sample(members: DataFrame, listed: DataFrame, key: str, add: int, seed: int = 42) -> DataFrame:
    """F-11, O-9: the members that a list holds and, beyond it, those of `add` sampled keys with a binary's record."""
    found = in_list(members, listed, key)
    if add <= 0:
        return found
    chosen = sample_unlisted(members.where("kind = 'bins'").select(key), listed, key, add, seed).distinct()
    return found.unionByName(in_list(members, chosen, key))


def sample_unlisted(members: DataFrame, listed: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """O-9: the members of n keys that the list does not hold, chosen by a seeded hash order (a limit that is the feature)."""
    keys = members.select(key).distinct().join(listed.select(key).distinct(), key, "left_anti")
    chosen = keys.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)
    return members.join(chosen, key, "left_semi")
