"""Vocabularies and count models (A-2 to A-8, J-1, J-2, F-1, F-3, F-14, K-2, K-3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import kind_of
from ..functions.windows import SIZES, context_windows, let, marked_names

#: Vocabulary rows that a join may broadcast: labels are short, so that is tens of megabytes at most.
BROADCAST_LABELS = 500_000


def human_label(label_type: str):
    """The human label of a name in an entry's nested label map, as a struct; null where the entry lacks one."""
    label = lambda var: F.try_element_at(F.try_element_at(F.col("labels"), F.lit(label_type)), var)
    return lambda var: let(label(var), lambda found: F.when(found["human"], F.struct(found["label"].alias("label"))))


def labelled_windows(entries: DataFrame, label_type: str = "type", sizes=SIZES, flanking: bool = True, full_strip: bool = False, keyed: bool = False) -> DataFrame:
    """J-1, F-1, F-3: context windows of targets with a human label, which the entry's own map gives without a join."""
    windows = context_windows(entries, sizes, flanking, full_strip, attach=lambda var: human_label(label_type)(var)["label"], attach_from=("labels",), keyed=keyed)
    return windows.withColumnRenamed("attached", "label")


def build_vocab(entries: DataFrame, label_type: str = "type") -> DataFrame:
    """A-2, A-3: `kind, id, label, count`: occurrences of human labels by kind, ranked by count, then label.

    A name's label is looked up inside its entry's row, so partial aggregation leaves a row a label for the shuffle.
    """
    rows = marked_names(entries, attach=human_label(label_type), attach_from=("labels",)).where("attached is not null")
    counts = rows.groupBy(kind_of(F.col("var")).alias("kind"), F.col("attached.label").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("count"), "label"))
    return counts.select("kind", (rank - 1).alias("id"), "label", "count")


def window_counts(windows: DataFrame) -> DataFrame:
    """A-4, A-5, J-15: how often a window had a label.  The kind is part of the key, so kinds never mix; partial
    aggregation meets hot windows (all padding, boiler-plate) before the shuffle."""
    return windows.groupBy("n", "hash", "kind", "label").agg(F.count(F.lit(1)).alias("count"))


def window_key() -> Column:
    """Size, hash and kind of a window in 16 bytes."""
    kind = F.when(F.col("kind") == "function", "01").otherwise("00")
    return F.unhex(F.concat("hash", F.lpad(F.hex("n"), 6, "0"), kind))


def _key_parts(key: Column) -> list[Column]:
    """`n, hash, kind` of a window's key."""
    n = F.conv(F.hex(F.substring(key, 13, 3)), 16, 10).cast("int")
    return [n.alias("n"), F.lower(F.hex(F.substring(key, 1, 12))).alias("hash"), F.when(F.substring(key, 16, 1) == F.lit(b"\x01"), "function").otherwise("variable").alias("kind")]


def top_labels(counts: DataFrame, vocab: DataFrame, k: int = 5) -> DataFrame:
    """J-2, F-14, A-6: `n, hash, kind, rank, vocab_id, label, count, total`: the k most frequent labels of a window that
    the vocabulary has; ties go to the smaller label; `total` sums the labels that stay."""
    ids = vocab.select("kind", "label", F.col("id").alias("vocab_id"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_LABELS else ids
    known = counts.join(ids, ["kind", "label"])
    window = Window.partitionBy("n", "hash", "kind")
    ranked = known.withColumn("rank", F.row_number().over(window.orderBy(F.desc("count"), "label"))).where(F.col("rank") <= k)
    return ranked.select("n", "hash", "kind", "rank", "vocab_id", "label", "count", F.sum("count").over(window).alias("total"))


def build_model(entries: DataFrame, vocab: DataFrame, label_type: str = "type", sizes=SIZES, k: int = 5, flanking: bool = True, full_strip: bool = False) -> DataFrame:
    """A-7, A-8: the model of all sizes in one pass over the corpus: `n, hash, kind, rank, vocab_id, label, count, total`.

    Each window is shuffled once, as its 16-byte key `_key` (which stays, for joins) and the id of its label; counts,
    ranks and labels follow where it lands.  A vocabulary too large to broadcast goes by `top_labels`.
    """
    ids = vocab.select("kind", "label", F.col("id").alias("vocab_id"))
    n_ids, n_distinct = ids.agg(F.count(F.lit(1)), F.count_distinct("kind", "vocab_id")).first()
    if n_ids > BROADCAST_LABELS or n_ids > n_distinct:
        return top_labels(window_counts(labelled_windows(entries, label_type, sizes, flanking, full_strip)), vocab, k)
    windows = labelled_windows(entries, label_type, sizes, flanking, full_strip, keyed=True)
    keyed = windows.join(F.broadcast(ids), ["kind", "label"]).select("_key", F.col("vocab_id").cast("int"))
    counts = keyed.repartition("_key").groupBy("_key", "vocab_id").agg(F.count(F.lit(1)).alias("count"))
    known = counts.select("_key", *_key_parts(F.col("_key")), "vocab_id", "count").join(F.broadcast(ids), ["kind", "vocab_id"])
    window = Window.partitionBy("_key")
    ranked = known.withColumn("rank", F.row_number().over(window.orderBy(F.desc("count"), "label"))).where(F.col("rank") <= k)
    return ranked.select("_key", "n", "hash", "kind", "rank", "vocab_id", "label", "count", F.sum("count").over(window).alias("total"))


def nested(model: DataFrame) -> DataFrame:
    """K-3: a row per window, its labels in an array by rank; counts must fit 32 bits, as in the exchange format."""
    checked = F.when(F.col("count") < 2**32, F.col("count")).otherwise(F.raise_error(F.lit("a count exceeds 32 bits")).cast("long"))
    preds = F.array_sort(F.collect_list(F.struct("rank", "vocab_id", "label", checked.alias("count"))))
    own = ["_key"] if "_key" in model.columns else []  # rows of a window already lie together by it
    rows = model.groupBy(*own or ["n", "hash", "kind"]).agg(*[F.first(c).alias(c) for c in (["n", "hash", "kind"] if own else [])], F.first("total").alias("total"), preds.alias("_p"))
    return rows.select("n", "hash", "kind", "total", F.transform("_p", lambda p: F.struct(p["vocab_id"].alias("vocab_id"), p["label"].alias("label"), p["count"].alias("count"))).alias("preds"))


def flat(model: DataFrame) -> DataFrame:
    """The rows of `top_labels` from nested ones; empty padding (count 0) goes (F-4)."""
    rows = model.select("n", "hash", "kind", "total", F.posexplode("preds").alias("p", "x"))
    return rows.where("x.count > 0").select("n", "hash", "kind", (F.col("p") + 1).alias("rank"), "x.vocab_id", "x.label", "x.count", "total")


def lookup_labels(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    """J-4: `kind, id` to labels; a function without a function vocabulary entry falls back to the variables'."""
    own = vocab.select("kind", "id", F.col("label").alias("_own"))
    other = vocab.where("kind = 'variable'").select("id", F.col("label").alias("_other"))
    return ids.join(own, ["kind", "id"], "left").join(other, "id", "left").select(*ids.columns, F.coalesce("_own", "_other").alias("label"))
