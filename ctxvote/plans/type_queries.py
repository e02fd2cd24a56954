"""Queries over types and evaluation reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import types
from ..lineage import shared_table
from ..operators import dataset, metrics, typesys
from . import sql
from .adapters import document_entries, part_types
from .queries import divided, predictions, query

# ---- types over a label for each part ------------------------------------------------------------------------------

_FIELDS = """'[{"T": 4, "n": "a", "t": "int", "s": 4}, {"T": 5, "s": ' || (z % 5) || '}, {"T": 4, "n": "b", "t": "long", "s": ' || CASE WHEN z % 3 = 0 THEN '8' ELSE '4' END || '}]'"""
_PARTS = f"""
raw_parts AS (SELECT p_partkey AS key, p_size AS z, replace(p_brand, '#', '_') AS b FROM part),
parts AS (SELECT key, CASE key % 11 WHEN 0 THEN '{{"T": 6, "n": "' || b || '", "l": ' || {_FIELDS} || ', "s": 16}}' WHEN 1 THEN '{{"T": 6, "n": "' || b || '_t", "l": ' || {_FIELDS} || ', "s": ' || z || '}}'
  WHEN 2 THEN '{{"T": 7, "n": "U_' || b || '", "l": ' || {_FIELDS} || '}}' WHEN 3 THEN '{{"T": 3, "t": "const ' || b || '"}}' WHEN 4 THEN '{{"T": 3, "t": "* volatile U_' || b || '_' || (z % 5) || '"}}' WHEN 5 THEN '{{"T": 2, "n": ' || (z % 5) || ', "s": 4, "t": "int"}}'
  WHEN 6 THEN '{{"T": 6, "n": ' || z || ', "l": []}}' WHEN 7 THEN '{{"T": 6, "n": "x", "l": [{{"n": "a", "s": 4}}], "s": 4}}' WHEN 8 THEN 'ptr<' || b || '>' WHEN 9 THEN '{{"T": 9, "t": "HAL_' || b || '"}}'
  ELSE '{{"T": 6, "n": "' || b || '", "l": [{{"T": 4, "n": "a", "t": "int"}}, {{"T": 4, "n": "z", "t": "$q", "s": ' || z || '}}], "s": 8}}' END AS label FROM raw_parts),
part_vocab AS (SELECT label, min(key) AS id FROM parts GROUP BY label)"""
_TYPES = (_PARTS, sql.types("SELECT label FROM parts", "SELECT id, label FROM part_vocab"))
_PAIRS = f"""
lagged AS (SELECT DISTINCT label AS pred, lead(label) OVER (ORDER BY key) AS label FROM parts UNION SELECT DISTINCT label, lead(label, 11) OVER (ORDER BY key) FROM parts),
sides AS (SELECT l.pred, l.label, p.structs AS ps, p.unions AS pu, p.defs AS pd, p.cat AS pc, q.structs AS qs, q.unions AS qu, q.defs AS qd, q.cat AS qc, p.an AS pn, p.asz AS pz, q.an AS qn, q.asz AS qz, {sql.LAYOUT} AS layout_cat FROM lagged l JOIN type_table p ON p.label = l.pred JOIN type_table q ON q.label = l.label)"""


def _vocab(spark, sf_dir) -> DataFrame:
    rows = part_types(spark, sf_dir).groupBy("label").agg(F.min("key").alias("id"))
    return rows.select(F.lit("variable").alias("kind"), "id", "label")


def _table(spark, sf_dir) -> DataFrame:
    return typesys.type_table(part_types(spark, sf_dir).select("label"), _vocab(spark, sf_dir))


def _compared(spark, sf_dir) -> DataFrame:
    """Every part's label beside those of the next part and of the eleventh next."""
    rows = part_types(spark, sf_dir)
    beside = lambda k: rows.select("key", F.col("label").alias("pred")).join(rows.select((F.col("key") - k).alias("key"), "label"), "key").select("pred", "label")
    near, far = beside(1), beside(11)  # keys run without gaps
    return typesys.compare_pairs(near.union(far).where("label is not null"), _table(spark, sf_dir))


@query("type_parse", sql.chain(*_TYPES) + "SELECT label, code AS head, ok AS parsed, n, s, t, len(l) AS n_members, an, asz FROM type_table")
def type_parse(spark, sf_dir):
    """T-8, T-9, T-10."""
    p = F.col("parsed")
    rows = typesys.parsed_labels(part_types(spark, sf_dir))
    return rows.select("label", F.col("head.code").alias("head"), p.isNotNull().alias("parsed"), p["n"].alias("n"), p["s"].alias("s"), p["t"].alias("t"), F.when(p["l"].isNotNull(), F.size(p["l"])).cast("long").alias("n_members"), F.col("arr.n").alias("an"), F.col("arr.s").alias("asz"))


@query("type_names", sql.chain(*_TYPES) + "SELECT label, coalesce(n, label) AS name, CASE WHEN code = 9 THEN head_t END AS fn FROM type_table")
def type_names(spark, sf_dir):
    """T-11, T-12."""
    return typesys.parsed_labels(part_types(spark, sf_dir)).select("label", types.type_name(F.col("label"), F.col("parsed")).alias("name"), types.function_name(F.col("head")).alias("fn"))


@query("type_category", sql.chain(*_TYPES) + "SELECT label, cat, coalesce(ok AND code = 10, false) AS missing, len(defs) > 0 AS composite FROM type_table")
def type_category(spark, sf_dir):
    """C-3, C-6."""
    return _table(spark, sf_dir).select("label", "cat", "missing", "composite")


@query("pointer_resolve", sql.chain(*_TYPES) + "SELECT label, len(structs) AS n_structs, len(unions) AS n_unions, defs[1].n AS first FROM type_table")
def pointer_resolve(spark, sf_dir):
    """J-8, T-16."""
    d = F.col("defs")
    return _table(spark, sf_dir).select("label", F.size(typesys.structs(d)).cast("long").alias("n_structs"), F.size(typesys.unions(d)).cast("long").alias("n_unions"), F.get(d, 0)["n"].alias("first"))


@query("field_sizes", sql.chain(*_TYPES) + f"SELECT label, array_to_string(CASE WHEN ok THEN {sql.sizes('d', 6)} END, ',') AS struct_sizes, array_to_string(CASE WHEN ok THEN {sql.sizes('d', 7)} END, ',') AS union_sizes FROM type_table")
def field_sizes(spark, sf_dir):
    """T-17."""
    joined = lambda code: F.array_join(types.member_sizes(F.col("parsed"), code).cast("array<string>"), ",")
    return typesys.parsed_labels(part_types(spark, sf_dir)).select("label", joined(6).alias("struct_sizes"), joined(7).alias("union_sizes"))


@query("field_offsets", sql.chain(*_TYPES) + f"SELECT label, array_to_string({sql.offset_widths('d')}, ',') AS widths, array_to_string({sql.named_offsets('d')}, ',') AS named FROM type_table WHERE ok AND code = 6 AND len({sql.offset_widths('d')}) > 0")
def field_offsets(spark, sf_dir):
    """T-18, T-19."""
    p = F.col("parsed")
    widths = F.transform(types.offset_widths(p), lambda x: F.concat_ws(":", x["off"].cast("string"), x["width"].cast("string")))
    named = F.coalesce(F.transform(types.named_offsets(p), lambda x: x["off"].cast("string")), F.array().cast("array<string>"))
    return typesys.parsed_labels(part_types(spark, sf_dir)).select("label", F.array_join(widths, ",").alias("widths"), F.array_join(named, ",").alias("named")).where("widths is not null")


@query("definition_stats", sql.chain(*_TYPES) + "SELECT (SELECT count(*) FROM type_table WHERE NOT ok) AS parse_errors, (SELECT count(*) FROM definitions WHERE len(defs) > 1) AS multi_names, (SELECT sum(len(defs) - 1) FROM definitions)::BIGINT AS duplicates")
def definition_stats(spark, sf_dir):
    """A-29."""
    return typesys.definition_stats(_vocab(spark, sf_dir))


@query("layout_compare", sql.chain(*_TYPES, _PAIRS) + f"SELECT pred, label, layout_cat, {sql.MATCH} AS layout_match FROM sides WHERE label IS NOT NULL")
def layout_compare(spark, sf_dir):
    """C-1, J-9."""
    return _compared(spark, sf_dir).select("pred", "label", "layout_cat", "layout_match")


@query("composite_same", sql.chain(*_TYPES, _PAIRS) + f"""
SELECT pred, label, coalesce(replace(pc, 'ptr-', '') = replace(qc, 'ptr-', '') AND CASE WHEN pc IN ('struct', 'ptr-struct') THEN {sql.same_sizes('pd', 'qd', 6)} WHEN pc IN ('union', 'ptr-union') THEN {sql.same_sizes('pu', 'qu', 7)} ELSE pc = qc END, false) AS same_layout FROM sides""")
def composite_same(spark, sf_dir):
    """C-7."""
    return _compared(spark, sf_dir).select("pred", "label", "same_layout")


@query("field_level_prf", sql.chain(*_TYPES, _PAIRS, f"""
widths AS (SELECT pred, label, list_transform(ps, lambda dd: {sql.offset_widths('dd')}) AS pw, list_transform(qs, lambda dd: {sql.offset_widths('dd')}) AS qw FROM sides),
us AS (SELECT pred, label, qw, unnest(pw) AS a, unnest(range(len(pw))) AS i FROM widths), crossed AS (SELECT pred, label, a, i, unnest(qw) AS b, unnest(range(len(qw))) AS j FROM us),
cmp AS (SELECT pred, label, i, j, len(list_intersect(a, b)) AS tp, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS fp, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS fn FROM crossed WHERE len(a) > 0 AND len(b) > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY pred, label ORDER BY tp DESC, i, j) AS r FROM cmp)""") + "SELECT pred, label, tp, fp, fn FROM best WHERE r = 1")
def field_level_prf(spark, sf_dir):
    """C-2."""
    rows = _compared(spark, sf_dir).where("fields is not null")
    return rows.select("pred", "label", *[F.col(f"fields.{c}").cast("long").alias(c) for c in ("tp", "fp", "fn")])


@query("fuzzy_match", sql.chain(*_TYPES, _PAIRS) + f"SELECT pred, label, {sql.fuzzy('pd', 'qd')} AS fuzzy FROM sides")
def fuzzy_match(spark, sf_dir):
    """C-4, C-5, T-20."""
    return _compared(spark, sf_dir).select("pred", "label", "fuzzy")


# ---- reports over the predictions of the test entries --------------------------------------------------------------

_REPORT = (
    *sql.PREDICTED,
    sql.types("SELECT pred AS label FROM predictions UNION SELECT label FROM predictions", "SELECT id, label FROM vocab WHERE kind = 'variable'"),
    f"""
usable AS (SELECT p.*, row_number() OVER (PARTITION BY entry_id, var, p.kind ORDER BY rank) AS r FROM predictions p JOIN type_table x ON x.label = p.pred WHERE NOT coalesce(x.ok AND x.code = 10, false)),
best AS (SELECT * FROM usable WHERE r = 1),
pair_sides AS (SELECT l.pred, l.label, p.structs AS ps, p.unions AS pu, p.defs AS pd, p.cat AS pc, q.structs AS qs, q.unions AS qu, q.defs AS qd, q.cat AS qc, p.an AS pn, p.asz AS pz, q.an AS qn, q.asz AS qz, coalesce(q.ok AND q.code = 10, false) AS label_missing,
  coalesce(CASE WHEN p.code = 9 THEN p.head_t END, l.pred) AS pred_fn, coalesce(CASE WHEN q.code = 9 THEN q.head_t END, l.label) AS label_fn, coalesce(q.n, l.label) AS label_name, {sql.LAYOUT} AS layout_cat
  FROM (SELECT DISTINCT pred, label FROM best) l JOIN type_table p ON p.label = l.pred JOIN type_table q ON q.label = l.label),
compared AS (SELECT *, {sql.MATCH} AS layout_match, {sql.fuzzy('pd', 'qd')} AS fuzzy,
  coalesce(replace(pc, 'ptr-', '') = replace(qc, 'ptr-', '') AND CASE WHEN pc IN ('struct', 'ptr-struct') THEN {sql.same_sizes('pd', 'qd', 6)} WHEN pc IN ('union', 'ptr-union') THEN {sql.same_sizes('pu', 'qu', 7)} ELSE pc = qc END, false) AS same_layout FROM pair_sides),
records AS (SELECT b.entry_id, b.var, b.kind, b.pred, b.label, b.count, b.score, c.* EXCLUDE (pred, label), len(c.pd) > 0 AS pred_composite, len(c.qd) > 0 AS label_composite, v.label IS NOT NULL AS known,
  regexp_replace(b.pred, '\\s', '', 'g') = regexp_replace(b.label, '\\s', '', 'g') AS exact FROM best b JOIN compared c USING (pred, label) LEFT JOIN vocab v ON v.kind = b.kind AND v.label = b.label),
written AS (SELECT * FROM records WHERE NOT label_missing)""",
)
_REPORT_SQL = sql.chain(*_REPORT)


def _records(spark, sf_dir) -> DataFrame:
    return shared_table(spark, sf_dir, "records", lambda: metrics.records(*predictions(spark, sf_dir)))


def _report(name: str, oracle: str):
    def register(f):
        return query(name, _REPORT_SQL + oracle)(lambda spark, sf_dir: f(_records(spark, sf_dir)))

    return register


@_report("evaluation_records", "SELECT entry_id, var, kind, pred, label, round(score, 6) AS score, label_missing, pred_composite, label_composite, layout_cat, layout_match, fuzzy, same_layout, pred_fn, label_fn, known FROM records")
def evaluation_records(rows):
    """F-7 and the flags of every record."""
    return rows.select("entry_id", "var", "kind", "pred", "label", F.round("score", 6).alias("score"), "label_missing", "pred_composite", "label_composite", "layout_cat", "layout_match", "fuzzy", "same_layout", "pred_fn", "label_fn", "known")


@_report("accuracy", """
SELECT kind, n_records, n_written, n_correct, round(n_correct / n_written, 6) AS accuracy, round(n_written / n_records, 6) AS coverage, round(1 - n_correct / n_written, 6) AS selective_risk
FROM (SELECT kind, count(*) AS n_records, count(*) FILTER (NOT label_missing) AS n_written, count(*) FILTER (NOT label_missing AND exact) AS n_correct FROM records GROUP BY kind)""")
def accuracy(rows):
    """A-14."""
    return metrics.accuracy(rows)


@_report("threshold_stats", "SELECT kind, count(*) AS n_before, count(*) FILTER (score < 0.4) AS n_dropped, count(*) FILTER (score >= 0.4 AND NOT label_missing) AS n_after, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score FROM records GROUP BY kind")
def threshold_stats(rows):
    """A-15, F-8."""
    return metrics.threshold_stats(rows, 0.4)


_SWEEP = """, cutoffs AS (SELECT * FROM (VALUES ('none', -1.0), ('0.40', 0.4), ('0.65', 0.65), ('0.90', 0.9), ('0.95', 0.95)) AS t(cutoff, least)),
pre AS (SELECT count(*) FILTER (kind = 'variable') AS v, count(*) FILTER (kind = 'function') AS f FROM written),
swept AS (SELECT cutoff, count(*) FILTER (kind = 'variable') AS v, count(*) FILTER (kind = 'function') AS f, count(*) FILTER (kind = 'variable' AND pred = label) AS vo, count(*) FILTER (kind = 'function' AND pred = label) AS fo,
  count(*) FILTER (kind = 'variable' AND pc IN ('struct', 'ptr-struct')) AS a, count(*) FILTER (kind = 'variable' AND pc IN ('struct', 'ptr-struct') AND qc IN ('struct', 'ptr-struct') AND same_layout) AS ao FROM cutoffs JOIN written ON score >= least GROUP BY cutoff)
SELECT cutoff, round(CASE WHEN pre.v > 0 THEN s.v / pre.v ELSE 0 END, 6) AS var_coverage, round(CASE WHEN s.v > 0 THEN 1 - vo / s.v ELSE 0 END, 6) AS var_risk, round(CASE WHEN pre.f > 0 THEN s.f / pre.f ELSE 0 END, 6) AS fn_coverage, round(CASE WHEN s.f > 0 THEN 1 - fo / s.f ELSE 0 END, 6) AS fn_risk,
  round(CASE WHEN pre.v > 0 THEN a / pre.v ELSE 0 END, 6) AS struct_action, round(CASE WHEN a > 0 THEN 1 - ao / a ELSE 0 END, 6) AS struct_risk FROM swept s, pre"""


@_report("threshold_sweep", _SWEEP)
def threshold_sweep(rows):
    """A-16."""
    return metrics.threshold_sweep(rows)


_WRONG = "kind = 'variable' AND NOT exact AND NOT (label_composite AND fuzzy)"


@_report("ood_rate", f"SELECT n_wrong, n_unknown, round(CASE WHEN n_wrong > 0 THEN n_unknown / n_wrong ELSE 0 END, 6) AS unknown_rate FROM (SELECT count(*) FILTER ({_WRONG}) AS n_wrong, count(*) FILTER ({_WRONG} AND NOT known) AS n_unknown FROM written)")
def ood_rate(rows):
    """A-17, J-11."""
    return metrics.ood_rate(rows)


@_report("top_missing", f"SELECT label_name, count(*) AS count FROM written WHERE {_WRONG} AND NOT known GROUP BY label_name ORDER BY count DESC, label_name LIMIT 3")
def top_missing(rows):
    """A-17, O-7."""
    return metrics.top_missing(rows)


_ADDRESS = """, fns AS (SELECT *, nullif(regexp_extract(var, '(?s)\\A.*?sub_([0-9a-fA-F]*)', 1), '') AS addr FROM records WHERE kind = 'function'),
addr_labels AS (SELECT addr, arg_min(label_fn, {'e': entry_id, 'v': var}) AS label_fn FROM fns WHERE addr IS NOT NULL GROUP BY addr),
addr_sums AS (SELECT addr, pred_fn, round(sum(score), 9) AS total, count(*) AS n_votes FROM fns WHERE addr IS NOT NULL AND NOT label_missing GROUP BY ALL),
addr_best AS (SELECT addr, pred_fn AS best_fn, n_votes FROM addr_sums QUALIFY row_number() OVER (PARTITION BY addr ORDER BY total DESC, n_votes DESC, pred_fn) = 1),
by_address AS (SELECT addr, label_fn, best_fn, n_votes FROM addr_labels LEFT JOIN addr_best USING (addr))
"""


def _prf_sql(inner: str, tp: str, predicted: str, actual: str, names: str) -> str:
    p, r = f"(CASE WHEN {predicted} > 0 THEN {tp} / {predicted} ELSE 0 END)", f"(CASE WHEN {actual} > 0 THEN {tp} / {actual} ELSE 0 END)"
    return f"SELECT {names}, round({p}, 6) AS precision, round({r}, 6) AS recall, round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END, 6) AS f1 FROM ({inner})"


@_report("func_aggregate", _ADDRESS + "SELECT * FROM by_address")
def func_aggregate(rows):
    """A-18, J-12."""
    return metrics.functions_by_address(rows)


@_report("func_aggregate_prf", _ADDRESS + _prf_sql("SELECT count(best_fn) AS n_addresses, count(*) FILTER (label_fn = best_fn) AS n_correct, count(*) FILTER (starts_with(label_fn, 'HAL_')) AS n_labels, count(*) FILTER (starts_with(best_fn, 'HAL_')) AS n_predicted, count(*) FILTER (starts_with(label_fn, 'HAL_') AND label_fn = best_fn) AS tp FROM by_address", "tp", "n_predicted", "n_labels", "n_addresses, n_correct, n_labels, n_predicted, tp"))
def func_aggregate_prf(rows):
    """A-18, A-20."""
    return metrics.address_accuracy(metrics.functions_by_address(rows))


@_report("prefix_prf", _prf_sql("SELECT count(*) FILTER (l) AS n_labels, count(*) FILTER (p) AS n_predicted, count(*) FILTER (l AND e) AS tp, count(*) FILTER (p AND NOT (l AND e)) AS fp, count(*) FILTER (l AND NOT e) AS fn, count(*) FILTER (l AND NOT e AND NOT known) AS n_unknown FROM (SELECT starts_with(label_fn, 'HAL_') AS l, starts_with(pred_fn, 'HAL_') AS p, label_fn = pred_fn AS e, known FROM written WHERE kind = 'function')", "tp", "n_predicted", "n_labels", "n_labels, n_predicted, tp, fp, fn, n_unknown"))
def prefix_prf(rows):
    """A-19."""
    return metrics.prefix_prf(rows)


@_report("struct_metrics", """
SELECT *, round(n_exact / n_labels, 6) AS exact_rate, round((n_exact + n_fuzzy) / n_labels, 6) AS fuzzy_rate, round(false_negatives / n_labels, 6) AS fnr, round(false_positives / (n_variables - n_labels), 6) AS fpr FROM (
SELECT count(*) FILTER (label_composite) AS n_labels, count(*) FILTER (pred_composite) AS n_predicted, count(*) FILTER (v) AS n_variables, count(*) FILTER (v AND label_composite AND exact) AS n_exact, count(*) FILTER (v AND label_composite AND NOT exact AND fuzzy) AS n_fuzzy,
  count(*) FILTER (w) AS n_wrong, count(*) FILTER (w AND NOT known) AS n_unknown, count(*) FILTER (w AND label_composite) AS wrong_struct, count(*) FILTER (w AND NOT label_composite) AS not_struct, count(*) FILTER (pred_composite AND v AND NOT label_composite) AS false_positives, count(*) FILTER (NOT pred_composite AND v AND label_composite) AS false_negatives
FROM (SELECT *, kind = 'variable' AS v, pred_composite AND pred <> label AND kind = 'variable' AND NOT (label_composite AND fuzzy) AS w FROM written))""")
def struct_metrics(rows):
    """A-21, A-22."""
    return metrics.struct_metrics(rows)


@_report("layout_rates", "SELECT coalesce(layout_cat, 'total') AS category, count(*) AS n, count(*) FILTER (layout_match) AS n_match, round(count(*) FILTER (layout_match) / count(*), 6) AS rate FROM written WHERE kind = 'variable' AND layout_cat IS NOT NULL AND layout_cat <> 'array' GROUP BY ROLLUP (layout_cat)")
def layout_rates(rows):
    """A-23."""
    return metrics.layout_rates(rows)


@_report("field_micro_prf", f""", fw AS (SELECT rowid_, list_transform(ps, lambda dd: {sql.offset_widths('dd')}) AS pw, list_transform(qs, lambda dd: {sql.offset_widths('dd')}) AS qw FROM (SELECT row_number() OVER () AS rowid_, ps, qs FROM written WHERE kind = 'variable' AND layout_cat IN ('struct', 'ptr-struct'))),
fu AS (SELECT rowid_, qw, unnest(pw) AS a, unnest(range(len(pw))) AS i FROM fw), fb AS (SELECT rowid_, a, i, unnest(qw) AS b, unnest(range(len(qw))) AS j FROM fu),
fc AS (SELECT rowid_, i, j, len(list_intersect(a, b)) AS tp, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS fp, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS fn FROM fb WHERE len(a) > 0 AND len(b) > 0),
fbest AS (SELECT * FROM fc QUALIFY row_number() OVER (PARTITION BY rowid_ ORDER BY tp DESC, i, j) = 1)
""" + _prf_sql("SELECT coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn FROM fbest", "tp", "(tp + fp)", "(tp + fn)", "tp, fp, fn"))
def field_micro_prf(rows):
    """A-24."""
    return metrics.field_prf(rows)


_COMPOSITE = """, cv AS (SELECT replace(pc, 'ptr-', '') AS p, replace(qc, 'ptr-', '') AS q, coalesce(same_layout AND replace(pc, 'ptr-', '') = replace(qc, 'ptr-', ''), false) AS hit FROM written WHERE kind = 'variable'),
cp AS (SELECT p AS category, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fp FROM cv WHERE p IS NOT NULL GROUP BY p), cl AS (SELECT q AS category, count(*) AS n_labels, count(*) FILTER (NOT hit) AS fn FROM cv WHERE q IS NOT NULL GROUP BY q),
cj AS (SELECT category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(n_labels, 0) AS n_labels, coalesce(fn, 0) AS fn FROM cp FULL JOIN cl USING (category) WHERE category IN ('struct', 'union')),
by_category AS (""" + _prf_sql("SELECT * FROM cj", "tp", "(tp + fp)", "(tp + fn)", "category, tp, fp, n_labels, fn") + ")\n"


@_report("composite_prf", _COMPOSITE + "SELECT * FROM by_category")
def composite_prf(rows):
    """A-25."""
    return metrics.composite_prf(rows)


@_report("composite_average", _COMPOSITE + "SELECT sum(n_labels)::BIGINT AS n_labels, round(sum(precision * n_labels) / sum(n_labels), 6) AS precision, round(sum(recall * n_labels) / sum(n_labels), 6) AS recall, round(sum(f1 * n_labels) / sum(n_labels), 6) AS f1 FROM by_category")
def composite_average(rows):
    """A-25: weighted by prevalence."""
    return metrics.composite_average(metrics.composite_prf(rows))


for _kind, _n in (("function", 20), ("variable", 10)):
    _oracle = f"SELECT label, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM written WHERE kind = '{_kind}' AND exact GROUP BY label ORDER BY count DESC, label LIMIT {_n}"
    _report(f"top_labels_{_kind}", _oracle)(lambda rows, k=_kind, n=_n: metrics.top_correct(rows, k, n))


# A document has no braces: its whole sequence without marked functions stands for the body.
_BODY = "sha256(array_to_string(list_filter(tokens, lambda t: NOT starts_with(t, '@@sub_')), chr(1)))"


@query("train_membership", _REPORT_SQL + f""", bodies AS (SELECT DISTINCT {_BODY} AS body FROM entries JOIN split USING (entry_id) WHERE train),
flagged AS (SELECT entry_id, {_BODY} IN (SELECT body FROM bodies) AS in_train FROM entries JOIN split USING (entry_id) WHERE NOT train)
SELECT in_train, count(*) AS n_written, count(*) FILTER (exact) AS n_correct, round(count(*) FILTER (exact) / count(*), 6) AS accuracy FROM written JOIN flagged USING (entry_id) WHERE kind = 'variable' GROUP BY in_train""")
def train_membership(spark, sf_dir):
    """A-27, J-10."""
    train, test = divided(spark, sf_dir)
    body = lambda t: F.sha2(F.array_join(F.filter(t, lambda x: ~x.startswith("@@sub_")), "\x01"), 256)
    return metrics.train_membership(_records(spark, sf_dir), test, train, body)


# ---- data sets -----------------------------------------------------------------------------------------------------

_GROUPS = sql.chain(sql.ENTRIES, """
keyed AS (SELECT entry_id, lang, sha256(array_to_string(tokens, ' ')) AS group_key FROM entries),
groups AS (SELECT group_key, min(entry_id) AS first_id, count(*) AS n FROM keyed GROUP BY group_key),
ballots AS (SELECT group_key, var, label, count(*) AS n_votes FROM truth JOIN keyed USING (entry_id) GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER w AS r, lead(label) OVER w AS l2, lead(n_votes) OVER w AS n2, count(*) OVER (PARTITION BY group_key, var) AS n_labels FROM ballots WINDOW w AS (PARTITION BY group_key, var ORDER BY n_votes DESC, label)),
winners AS (SELECT group_key, var, CASE WHEN n_votes = n2 AND strlen(label) > 45 AND strlen(l2) > 45 AND left(label, 45) = left(l2, 45) AND NOT contains(label, '__anon_ty') AND strlen(l2) > strlen(label) THEN l2 ELSE label END AS label, n_labels FROM ordered WHERE r = 1)""")


@query("dedupe_groups", _GROUPS + "SELECT group_key, first_id, n FROM groups")
def dedupe_groups(spark, sf_dir):
    """A-11."""
    return dataset.duplicate_groups(document_entries(spark, sf_dir))


@query("majority_vote", _GROUPS + "SELECT group_key, var, label, n_labels FROM winners")
def majority_vote(spark, sf_dir):
    """A-12."""
    return dataset.majority(dataset.label_votes(document_entries(spark, sf_dir)))


@query("type_conflicts", _GROUPS + "SELECT count(DISTINCT group_key) AS n_conflicts FROM winners WHERE n_labels > 1 AND NOT contains(label, '__anon_ty')")
def type_conflicts(spark, sf_dir):
    """A-13."""
    return dataset.conflicts(dataset.majority(dataset.label_votes(document_entries(spark, sf_dir))))


@query("create_dataset", _GROUPS + """, firsts AS (SELECT first_id AS entry_id, group_key, n FROM groups),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(entry_id || ':42'), entry_id) <= floor(0.8 * (SELECT count(*) FROM firsts)) AS train FROM firsts),
named_labels AS (SELECT f.entry_id, w.var, w.label, true AS human FROM firsts f JOIN winners w USING (group_key) WHERE f.n > 1 UNION ALL SELECT f.entry_id, t.var, t.label, t.human FROM firsts f JOIN truth t USING (entry_id) WHERE f.n = 1),
summed AS (SELECT entry_id, count(*) AS n_labels, count(*) FILTER (human) AS n_human, md5(string_agg(var || '=' || label, '|' ORDER BY var)) AS labels_md5 FROM named_labels GROUP BY entry_id)
SELECT entry_id, train, n AS n_members, coalesce(n_labels, 0) AS n_labels, coalesce(n_human, 0) AS n_human, coalesce(labels_md5, md5('')) AS labels_md5 FROM ranked LEFT JOIN summed USING (entry_id)""")
def create_dataset(spark, sf_dir):
    """O-10, O-11."""
    rows = dataset.create_dataset(document_entries(spark, sf_dir))
    entries = F.map_entries(F.coalesce(F.try_element_at("labels", F.lit("type")), F.create_map().cast("map<string,struct<human:boolean,label:string>>")))
    pairs = F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"]["label"]))
    return rows.select("entry_id", "train", "n_members", F.size(entries).cast("long").alias("n_labels"), F.size(F.filter(entries, lambda e: e["value"]["human"])).cast("long").alias("n_human"), F.md5(F.array_join(pairs, "|")).alias("labels_md5"))


@query("hash_list_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def hash_list_semi(spark, sf_dir):
    """F-11, J-13: members whose key is listed."""
    listed = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return dataset.in_list(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"), listed, "o_custkey").select("o_orderkey", "o_custkey")


@query("sample_antijoin", """
WITH keys AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
chosen AS (SELECT o_custkey FROM keys ORDER BY md5(o_custkey || ':42'), o_custkey LIMIT 50) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM chosen)""")
def sample_antijoin(spark, sf_dir):
    """O-9: a sample of 50 unlisted keys (the operator's parameter) and all their members."""
    listed = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    members = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return dataset.sample_unlisted(members, listed, "o_custkey", 50).select("o_orderkey", "o_custkey")
