"""Evaluation reports over prediction records (A-14 to A-27, F-7, F-8, J-10 to J-12, K-4).

`records` is the one table that all reports aggregate: the best candidate of each target, with flags.  Every report is
one conditional aggregation or a small grouped one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import names, types
from ..functions.text import body_hash, without_space
from ..lineage import cut
from . import typesys
from .model import BROADCAST_LABELS

#: The cut-offs of a sweep.
CUTOFFS = (None, 0.40, 0.65, 0.90, 0.95)
PREFIX = "HAL_"


def records(predictions: DataFrame, vocab: DataFrame) -> DataFrame:
    """F-7: the first candidate that is not of category 10, with type flags, comparisons and whether the label is known.

    `entry_id, var, kind, pred, label, count, score, label_missing, pred_composite, label_composite, pred_cat, label_cat,
    layout_cat, layout_match, fields, fuzzy, same_layout, pred_fn, label_fn, label_name, known`.
    """
    used = predictions.select(F.col("pred").alias("label")).union(predictions.select("label"))
    table = typesys.type_table(used, vocab)
    missing = cut(table.where("missing").select(F.col("label").alias("pred")))
    small = missing.count() <= BROADCAST_LABELS
    usable = predictions.join(F.broadcast(missing) if small else missing, "pred", "left_anti")
    best = usable.withColumn("_r", F.row_number().over(Window.partitionBy("entry_id", "var", "kind").orderBy("rank"))).where("_r = 1")
    pairs = typesys.compare_pairs(best, table)
    fn = lambda c: F.coalesce(types.function_name(F.col(f"{c}.head")), F.col(f"{c}.label"))
    pairs = pairs.select(
        "pred", "label", F.col("q.missing").alias("label_missing"), F.col("p.composite").alias("pred_composite"), F.col("q.composite").alias("label_composite"), F.col("p.cat").alias("pred_cat"), F.col("q.cat").alias("label_cat"),
        "layout_cat", "layout_match", "fields", "fuzzy", "same_layout", fn("p").alias("pred_fn"), fn("q").alias("label_fn"), types.type_name(F.col("label"), F.col("q.parsed")).alias("label_name"),
    )
    known = vocab.select("kind", "label", F.lit(True).alias("_known"))
    rows = best.select("entry_id", "var", "kind", "pred", "label", "count", "score").join(pairs, ["pred", "label"])
    return rows.join(known, ["kind", "label"], "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")


def _n(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def _ratio(a: str, b: str, name: str, guarded: bool = True) -> Column:
    return F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0) if guarded else F.lit(None)), 6).alias(name)


def exact() -> Column:
    """Equality without white space."""
    return without_space(F.col("pred")) == without_space(F.col("label"))


def written(rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """F-8: records that pass the threshold (1 and more: all) and whose label is not of category 10."""
    if threshold is not None and threshold < 1.0:
        rows = rows.where(F.col("score") >= threshold)
    return rows.where(~F.col("label_missing"))


def accuracy(rows: DataFrame, threshold: float | None = None) -> DataFrame:
    """A-14: by kind: accuracy, coverage and selective risk.  Coverage divides by all records, category 10 included."""
    kept = ~F.col("label_missing") & (F.lit(True) if threshold is None or threshold >= 1.0 else F.col("score") >= threshold)
    out = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_records"), _n(kept, "n_written"), _n(kept & exact(), "n_correct"))
    return out.select("kind", "n_records", "n_written", "n_correct", _ratio("n_correct", "n_written", "accuracy", False), _ratio("n_written", "n_records", "coverage"), F.round(1 - F.try_divide("n_correct", "n_written"), 6).alias("selective_risk"))


def threshold_stats(rows: DataFrame, threshold: float) -> DataFrame:
    """A-15: by kind: records before, dropped by and after a threshold, and the range of scores."""
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_before"), _n(F.col("score") < threshold, "n_dropped"), _n((F.col("score") >= threshold) & ~F.col("label_missing"), "n_after"), F.round(F.min("score"), 6).alias("min_score"), F.round(F.max("score"), 6).alias("max_score")
    )


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """A-16: by cut-off: coverage and exact risk of variables and functions, struct action rate and risk.

    Equality is of the raw texts here, and labels of category 10 count nowhere.  Each record meets the five cut-offs
    inside the aggregation, so no row is multiplied.
    """
    scored = rows.where(~F.col("label_missing"))
    is_var, is_fn = F.col("kind") == "variable", F.col("kind") == "function"
    same = F.col("pred") == F.col("label")
    struct_pred = F.coalesce(typesys.merged(F.col("pred_cat")) == "struct", F.lit(False))
    struct_label = F.coalesce(typesys.merged(F.col("label_cat")) == "struct", F.lit(False))
    aggregates = [_n(is_var, "pre_var"), _n(is_fn, "pre_fn")]
    for i, cutoff in enumerate(CUTOFFS):
        kept = F.lit(True) if cutoff is None else F.col("score") >= cutoff
        aggregates += [_n(kept & is_var, f"var{i}"), _n(kept & is_fn, f"fn{i}"), _n(kept & is_var & same, f"var_ok{i}"), _n(kept & is_fn & same, f"fn_ok{i}"), _n(kept & is_var & struct_pred, f"act{i}"), _n(kept & is_var & struct_pred & struct_label & F.col("same_layout"), f"act_ok{i}")]
    total = scored.agg(*aggregates)
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    risk = lambda a, b: F.round(F.when(b > 0, 1 - a / b).otherwise(0.0), 6)
    lines = []
    for i, cutoff in enumerate(CUTOFFS):
        c = lambda name, i=i: F.col(f"{name}{i}")
        lines.append(F.struct(F.lit("none" if cutoff is None else f"{cutoff:.2f}").alias("cutoff"), ratio(c("var"), F.col("pre_var")).alias("var_coverage"), risk(c("var_ok"), c("var")).alias("var_risk"), ratio(c("fn"), F.col("pre_fn")).alias("fn_coverage"), risk(c("fn_ok"), c("fn")).alias("fn_risk"), ratio(c("act"), F.col("pre_var")).alias("struct_action"), risk(c("act_ok"), c("act")).alias("struct_risk")))
    return total.select(F.inline(F.array(*lines)))


def _wrong() -> Column:
    """Variables that are neither exactly nor fuzzily right."""
    return (F.col("kind") == "variable") & ~exact() & ~(F.col("label_composite") & F.col("fuzzy"))


def ood_rate(rows: DataFrame) -> DataFrame:
    """A-17, J-11: wrong variables whose label the vocabulary lacks."""
    out = written(rows).agg(_n(_wrong(), "n_wrong"), _n(_wrong() & ~F.col("known"), "n_unknown"))
    return out.select("n_wrong", "n_unknown", _ratio("n_unknown", "n_wrong", "unknown_rate"))


def top_missing(rows: DataFrame, n: int = 3) -> DataFrame:
    """A-17, O-7: the names of the most frequent unknown labels (a limit that is the feature)."""
    return written(rows).where(_wrong() & ~F.col("known")).groupBy("label_name").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "label_name").limit(n)


def functions_by_address(rows: DataFrame) -> DataFrame:
    """A-18, J-12: `addr, label_fn, best_fn, n_votes`: of each address the function name with the largest summed score; the label is
    that of the first record; best_fn is null where no prediction was written."""
    found = rows.where("kind = 'function'").withColumn("addr", names.sub_address(F.col("var"))).where("addr is not null")
    labels = found.groupBy("addr").agg(F.min_by("label_fn", F.struct("entry_id", "var")).alias("label_fn"))
    sums = written(found).groupBy("addr", "pred_fn").agg(F.round(F.sum("score"), 9).alias("total"), F.count(F.lit(1)).alias("n_votes"))
    order = Window.partitionBy("addr").orderBy(F.desc("total"), F.desc("n_votes"), "pred_fn")
    best = sums.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("addr", F.col("pred_fn").alias("best_fn"), "n_votes")
    return labels.join(best, "addr", "left")


def _prf(out: DataFrame, tp: str, predicted: str, actual: str) -> DataFrame:
    p = F.when(F.col(predicted) > 0, F.col(tp) / F.col(predicted)).otherwise(0.0)
    r = F.when(F.col(actual) > 0, F.col(tp) / F.col(actual)).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return out.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def address_accuracy(by_address: DataFrame) -> DataFrame:
    """A-18, A-20: accuracy of the aggregated functions, and precision and recall of those with the prefix."""
    label, pred = F.col("label_fn").startswith(PREFIX), F.coalesce(F.col("best_fn").startswith(PREFIX), F.lit(False))
    same = F.coalesce(F.col("label_fn") == F.col("best_fn"), F.lit(False))
    out = by_address.agg(_n(F.col("best_fn").isNotNull(), "n_addresses"), _n(same, "n_correct"), _n(label, "n_labels"), _n(pred, "n_predicted"), _n(label & same, "tp"))
    return _prf(out, "tp", "n_predicted", "n_labels")


def prefix_prf(rows: DataFrame) -> DataFrame:
    """A-19: precision, recall and unknown labels of function records whose name has the prefix."""
    fn = written(rows).where("kind = 'function'")
    label, pred, same = F.col("label_fn").startswith(PREFIX), F.col("pred_fn").startswith(PREFIX), F.col("label_fn") == F.col("pred_fn")
    out = fn.agg(_n(label, "n_labels"), _n(pred, "n_predicted"), _n(label & same, "tp"), _n(pred & ~(label & same), "fp"), _n(label & ~same, "fn"), _n(label & ~same & ~F.col("known"), "n_unknown"))
    return _prf(out, "tp", "n_predicted", "n_labels")


def struct_metrics(rows: DataFrame) -> DataFrame:
    """A-21, A-22: exact and fuzzy hits on composite labels, false positives and negatives, and a breakdown of the errors."""
    kept = written(rows)
    var = F.col("kind") == "variable"
    label, pred, fuzzy = F.col("label_composite"), F.col("pred_composite"), F.col("fuzzy")
    wrong = pred & (F.col("pred") != F.col("label")) & var & ~(label & fuzzy)
    out = kept.agg(
        _n(label, "n_labels"), _n(pred, "n_predicted"), _n(var, "n_variables"), _n(var & label & exact(), "n_exact"), _n(var & label & ~exact() & fuzzy, "n_fuzzy"), _n(wrong, "n_wrong"), _n(wrong & ~F.col("known"), "n_unknown"),
        _n(wrong & label, "wrong_struct"), _n(wrong & ~label, "not_struct"), _n(pred & var & ~label, "false_positives"), _n(~pred & var & label, "false_negatives"),
    )
    return out.select("*", _ratio("n_exact", "n_labels", "exact_rate"), F.round(F.try_divide(F.col("n_exact") + F.col("n_fuzzy"), F.col("n_labels")), 6).alias("fuzzy_rate"), F.round(F.try_divide("false_negatives", "n_labels"), 6).alias("fnr"), F.round(F.try_divide(F.col("false_positives"), F.col("n_variables") - F.col("n_labels")), 6).alias("fpr"))


def layout_rates(rows: DataFrame) -> DataFrame:
    """A-23: match rates by category and in total (arrays count in neither)."""
    kept = written(rows).where("kind = 'variable' and layout_cat is not null and layout_cat <> 'array'")
    out = kept.rollup("layout_cat").agg(F.count(F.lit(1)).alias("n"), _n(F.col("layout_match"), "n_match"))
    return out.select(F.coalesce("layout_cat", F.lit("total")).alias("category"), "n", "n_match", _ratio("n_match", "n", "rate"))


def field_prf(rows: DataFrame) -> DataFrame:
    """A-24: micro precision and recall of (offset, width)."""
    kept = written(rows).where("kind = 'variable' and layout_cat in ('struct', 'ptr-struct')")
    out = kept.agg(*[F.coalesce(F.sum(f"fields.{c}"), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    out = out.select("*", (F.col("tp") + F.col("fp")).alias("_p"), (F.col("tp") + F.col("fn")).alias("_a"))
    return _prf(out, "tp", "_p", "_a").drop("_p", "_a")


def composite_prf(rows: DataFrame) -> DataFrame:
    """A-25: by merged category: identification of composites, weighted by how often labels have it."""
    kept = written(rows).where("kind = 'variable'").select(typesys.merged(F.col("pred_cat")).alias("p"), typesys.merged(F.col("label_cat")).alias("q"), "same_layout")
    hit = F.coalesce(F.col("same_layout") & (F.col("p") == F.col("q")), F.lit(False))
    pred = kept.where("p is not null").groupBy(F.col("p").alias("category")).agg(_n(hit, "tp"), _n(~hit, "fp"))
    label = kept.where("q is not null").groupBy(F.col("q").alias("category")).agg(F.count(F.lit(1)).alias("n_labels"), _n(~hit, "fn"))
    out = pred.join(label, "category", "full").na.fill(0, ["tp", "fp", "fn", "n_labels"]).where("category in ('struct', 'union')")
    out = out.select("*", (F.col("tp") + F.col("fp")).alias("_p"), (F.col("tp") + F.col("fn")).alias("_a"))
    return _prf(out, "tp", "_p", "_a").drop("_p", "_a")


def composite_average(by_category: DataFrame) -> DataFrame:
    """A-25: the average over categories weighted by their labels."""
    weighted = lambda c: F.round(F.try_divide(F.sum(F.col(c) * F.col("n_labels")), F.sum("n_labels")), 6).alias(c)
    return by_category.agg(F.sum("n_labels").cast("long").alias("n_labels"), weighted("precision"), weighted("recall"), weighted("f1"))


def top_correct(rows: DataFrame, kind: str, n: int) -> DataFrame:
    """A-26, O-7: the labels that were right most often, with their share (a limit that is the feature)."""
    right = written(rows).where((F.col("kind") == kind) & exact())
    counts = right.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    share = F.round(F.col("count") / F.sum("count").over(Window.partitionBy()), 6).alias("share")  # one row a label
    return counts.select("label", "count", share).orderBy(F.desc("count"), "label").limit(n)


def train_membership(rows: DataFrame, entries: DataFrame, train: DataFrame, body=body_hash) -> DataFrame:
    """A-27, J-10: accuracy on variables of entries whose body the training entries hold or do not."""
    bodies = train.select(body(F.col("tokens")).alias("body")).where("body is not null").distinct().withColumn("in_train", F.lit(True))
    flagged = entries.select("entry_id", body(F.col("tokens")).alias("body")).join(bodies, "body", "left").select("entry_id", F.coalesce("in_train", F.lit(False)).alias("in_train"))
    kept = written(rows).where("kind = 'variable'").join(flagged, "entry_id")
    out = kept.groupBy("in_train").agg(F.count(F.lit(1)).alias("n_written"), _n(exact(), "n_correct"))
    return out.select("in_train", "n_written", "n_correct", _ratio("n_correct", "n_written", "accuracy"))


def output_records(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """K-4: written records as JSON lines: var, pred, label, count, layout and the entry's meta."""
    joined = written(rows).join(entries.select("entry_id", "meta"), "entry_id")
    return joined.select(F.to_json(F.struct("var", "pred", "label", "count", "meta", F.col("layout_cat").alias("layout_category"), "layout_match")).alias("value"))


def throughput(n_entries: int, inference_seconds: float, total_seconds: float) -> Row:
    """A-28: milliseconds an entry, entries a second, and the run times of the inference and of everything."""
    each = 1000.0 * inference_seconds / n_entries if n_entries else 0.0
    return Row(ms_per_entry=round(each, 2), entries_per_second=round(1000.0 / each, 1) if each else 0.0, inference_seconds=round(inference_seconds, 3), total_seconds=round(total_seconds, 3))
