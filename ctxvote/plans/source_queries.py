"""Queries over sources and sinks: tables are written out in an exchange format and read back."""

from __future__ import annotations

import io
import lzma
import tarfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..lineage import checkpoint_folder, cut
from ..operators import dataset, metrics, model, predict, review
from ..sources import archive, corpus
from . import sql
from .adapters import decompiled, document_entries, table
from .queries import _DECOMPILED, divided, predictions, query, trained
from .type_queries import _REPORT_SQL, _records


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder, deleted when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(data))
    out.close()


# ---- corpora -------------------------------------------------------------------------------------------------------


def _written_corpus(spark, sf_dir) -> str:
    """The entries of `documents` as JSON lines, each with its id in its meta."""
    entries = document_entries(spark, sf_dir).withColumn("meta", F.map_concat("meta", F.create_map(F.lit("doc"), F.col("entry_id").cast("string"))))
    path = f"{_folder(spark, 'corpus')}/corpus.jsonl"
    corpus.write_entries(entries, path)
    return path


def _entry_digest(entries: DataFrame) -> DataFrame:
    names = F.array_sort(F.map_keys(F.try_element_at("labels", F.lit("type"))))
    human = F.size(F.filter(F.map_values(F.try_element_at("labels", F.lit("type"))), lambda x: x["human"]))
    return entries.select(F.col("meta")["doc"].cast("long").alias("doc_id"), F.col("meta")["lang"].alias("lang"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"), F.array_join(names, "|").alias("names"), human.cast("long").alias("n_human"))


_CORPUS_SQL = sql.chain(sql.ENTRIES, """
own AS (SELECT entry_id, string_agg(var, '|' ORDER BY var) AS names, count(*) FILTER (human) AS n_human FROM truth GROUP BY entry_id)""") + """
SELECT e.entry_id AS doc_id, lang, md5(array_to_string(tokens, ' ')) AS tokens_md5, coalesce(names, '') AS names, coalesce(n_human, 0) AS n_human FROM entries e LEFT JOIN own USING (entry_id)"""


@query("corpus_strict", _CORPUS_SQL)
def corpus_strict(spark, sf_dir):
    """S-1, S-4, K-5: written as JSON lines and read back, every line."""
    return _entry_digest(corpus.read_entries(spark, _written_corpus(spark, sf_dir), strict=True))


@query("corpus_lenient", _CORPUS_SQL + " WHERE e.entry_id % 7 <> 0")
def corpus_lenient(spark, sf_dir):
    """S-2: every seventh line is broken off; the others are read."""
    lines = spark.read.text(_written_corpus(spark, sf_dir))
    doc = F.get_json_object("value", "$.meta.doc").cast("long")
    path = f"{_folder(spark, 'broken')}/corpus.jsonl"
    lines.select(F.when(doc % 7 == 0, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")).alias("value")).write.text(path)
    return _entry_digest(corpus.read_entries(spark, path))


@query("corpus_length", "SELECT count(*) AS n FROM documents")
def corpus_length(spark, sf_dir):
    """S-3."""
    return spark.createDataFrame([(corpus.count_entries(spark, _written_corpus(spark, sf_dir)),)], "n long")


@query("raw_lines", """WITH k AS (SELECT doc_id, text, count(*) OVER (PARTITION BY coalesce(text, '')) AS n FROM documents)
SELECT doc_id, 'line ' || doc_id AS raw FROM k WHERE n = 1""")
def raw_lines(spark, sf_dir):
    """O-11: single entries keep the line that they came as."""
    docs = table(spark, sf_dir, "documents")
    entries = docs.select(F.col("doc_id").alias("entry_id"), F.array(F.coalesce("text", F.lit(""))).alias("tokens"), F.lit(None).cast(corpus.LABELS).alias("labels"), F.concat(F.lit("line "), F.col("doc_id")).alias("raw"))
    return dataset.create_dataset(entries).where("raw is not null").select(F.col("entry_id").alias("doc_id"), "raw")


@query("listing_entries", _DECOMPILED + """, found AS (SELECT entry_id, w, list_concat(['param1'], list_filter(w, lambda t: starts_with(t, 'sub_'))) AS names FROM raw)
SELECT entry_id, len(w) AS n_tokens, len(list_distinct(names)) AS n_types, len(list_distinct(names)) AS n_names, true AS placeholder FROM found""")
def listing_entries(spark, sf_dir):
    """S-5, S-6: entries of listings and named targets, with the placeholder label under both label types."""
    rows = corpus.entries_from_listings(decompiled(spark, sf_dir).withColumn("targets", F.array(F.lit("param1"))))
    kind = lambda k: F.try_element_at("labels", F.lit(k))
    good = F.forall(F.map_values(kind("name")), lambda x: x["human"] & (x["label"] == "type"))
    return rows.select("entry_id", F.size("tokens").cast("long").alias("n_tokens"), F.size(kind("type")).cast("long").alias("n_types"), F.size(kind("name")).cast("long").alias("n_names"), good.alias("placeholder"))


@query("listing_files", "SELECT n_name || '.txt' AS file, 'int ' || n_name || '(void) { return ' || n_regionkey || '; }' AS code FROM nation")
def listing_files(spark, sf_dir):
    """S-5: one function a file, read whole; a file for each nation."""
    folder = _folder(spark, "listings")
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows whatever the scale
        _put(spark, f"{folder}/{r.n_name}.txt", f"int {r.n_name}(void) {{ return {r.n_regionkey}; }}".encode())
    return corpus.read_listings(spark, folder).select(F.regexp_replace("file", "%20", " ").alias("file"), "code")


# ---- vocabularies --------------------------------------------------------------------------------------------------

_VOCAB_SQL = sql.chain(sql.ENTRIES, sql.VOCAB_ALL)


@query("vocab_json", _VOCAB_SQL + "SELECT kind, id, label, count FROM vocab WHERE kind = 'variable'")
def vocab_json(spark, sf_dir):
    """S-7, K-1: written as one JSON object and read back."""
    path = f"{_folder(spark, 'vocab')}/v.json"
    corpus.write_vocab_json(model.build_vocab(document_entries(spark, sf_dir)), "variable", path)
    return corpus.read_vocab_json(spark, path)


@query("vocab_tsv", _VOCAB_SQL + "SELECT kind, id, label, count FROM vocab WHERE kind = 'function'")
def vocab_tsv(spark, sf_dir):
    """S-8: a tab-separated vocabulary of the functions."""
    rows = model.build_vocab(document_entries(spark, sf_dir)).where("kind = 'function'")
    line = F.transform(F.array_sort(F.collect_list(F.struct("id", "label", "count"))), lambda x: F.concat_ws("\t", x["label"], x["count"].cast("string")))
    path = f"{_folder(spark, 'vocab')}/v.tsv"
    rows.agg(F.array_join(line, "\n").alias("value")).coalesce(1).write.text(path)
    return corpus.read_vocab_tsv(spark, path, "function")


@query("vocab_parquet", _VOCAB_SQL + "SELECT kind, id, label, count FROM vocab")
def vocab_parquet(spark, sf_dir):
    """K-1: both kinds."""
    path = _folder(spark, "vocab")
    corpus.write_vocab(model.build_vocab(document_entries(spark, sf_dir)), path)
    return corpus.read_vocab(spark, path)


@query("vocab_paths", "SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN 'x/' || p_partkey || '.fn.vocab' WHEN p_partkey % 3 = 1 THEN 'x.y/' || p_partkey || '.fn' ELSE p_partkey || '.a.fn.b' END AS path, p_partkey % 4 < 3 AS generic FROM part")
def vocab_paths(spark, sf_dir):
    """T-25, T-26 over a name for each part."""
    rows = table(spark, sf_dir, "part").select("p_partkey").toLocalIterator()
    made = []
    for r in rows:  # the paths are names of files: a driver's business
        k = r.p_partkey
        made.append((k, corpus.function_path((f"x/{k}.vocab", f"x.y/{k}", f"{k}.a.b")[k % 3]), ("var", "param", "stack", "myvar")[k % 4] + str(k)))
    return spark.createDataFrame(made, "key long, path string, name string").select("key", "path", text.has_generic_name(F.col("name")).alias("generic"))


# ---- models --------------------------------------------------------------------------------------------------------

_MODEL_SQL = sql.chain(*sql.BASE[:2], sql.VOCAB_ALL, sql.counts(False))


def _nested(spark, sf_dir, sizes) -> tuple[DataFrame, DataFrame]:
    entries = document_entries(spark, sf_dir)
    vocab = cut(model.build_vocab(entries))
    return model.nested(model.build_model(entries, vocab, sizes=sizes)), vocab


@query("model_files", _MODEL_SQL + "SELECT n, hash, kind, rank, vocab_id, label, count, total FROM model WHERE n IN (2, 4)")
def model_files(spark, sf_dir):
    """S-9, S-10, K-2, K-3, O-5: a model of two sizes, written sorted by hash and read back."""
    path, settings = _folder(spark, "model"), {"label_type": "type", "flanking": True}
    corpus.write_model(_nested(spark, sf_dir, (4, 2))[0], path, settings, placed=True)
    return model.flat(corpus.read_model(spark, path, settings)).select("n", "hash", "kind", F.col("rank").cast("int"), "vocab_id", "label", "count", "total")


@query("model_order", "SELECT true AS sorted")
def model_order(spark, sf_dir):
    """O-5: within each file of a written model, hashes ascend."""
    path = _folder(spark, "model")
    corpus.write_model(_nested(spark, sf_dir, (2,))[0], path, {}, placed=True)
    rows = spark.read.parquet(f"{path}/windows").select(F.input_file_name().alias("file"), "hash", F.monotonically_increasing_id().alias("place"))
    after = F.lead("hash").over(Window.partitionBy("file").orderBy("place"))
    return rows.select((F.coalesce(after, F.col("hash")) >= F.col("hash")).alias("ok")).agg(F.bool_and("ok").alias("sorted"))


@query("model_platform", _MODEL_SQL + "SELECT CASE n WHEN 2 THEN 32 ELSE 64 END AS arch_bits, n, kind, count(DISTINCT hash) AS n_windows, sum(count)::BIGINT AS n_counts FROM model WHERE n IN (2, 4) GROUP BY n, kind")
def model_platform(spark, sf_dir):
    """S-16: models for machines of 32 and 64 bits."""
    path = _folder(spark, "platform")
    corpus.write_platform({32: _nested(spark, sf_dir, (2,))[0], 64: _nested(spark, sf_dir, (4,))[0]}, path, {}, placed=True)
    rows = corpus.read_platform(spark, path)
    counts = F.aggregate("preds", F.lit(0).cast("long"), lambda a, p: a + p["count"])
    return rows.groupBy("arch_bits", "n", "kind").agg(F.countDistinct("hash").alias("n_windows"), F.sum(counts).alias("n_counts"))


@query("model_flat_arrays", _MODEL_SQL + "SELECT n, hash, kind, rank, vocab_id, label, count, total FROM model WHERE n = 2")
def model_flat_arrays(spark, sf_dir):
    """S-11, F-4: the older format of parallel, padded arrays and back, with labels from the vocabulary."""
    nested, vocab = _nested(spark, sf_dir, (2,))
    back = corpus.nested_from_flat_arrays(corpus.flat_arrays(nested, 5), 5, vocab)
    return model.flat(back).select("n", "hash", "kind", F.col("rank").cast("int"), "vocab_id", "label", "count", "total")


@query("zero_padding", "SELECT p_partkey AS key, p_size::BIGINT AS count FROM part WHERE p_size % 4 > 0")
def zero_padding(spark, sf_dir):
    """F-4: cells without a count go."""
    count = F.when(F.col("p_size") % 4 > 0, F.col("p_size")).otherwise(0).cast("long")
    cell = F.struct(F.lit(0).alias("vocab_id"), F.lit("x").alias("label"), count.alias("count"))
    rows = table(spark, sf_dir, "part").select(F.lit(2).alias("n"), F.col("p_partkey").cast("string").alias("hash"), F.lit("variable").alias("kind"), count.alias("total"), F.array(cell).alias("preds"))
    return model.flat(rows).select(F.col("hash").cast("long").alias("key"), "count")


@query("unknown_labels", sql.chain(*sql.TRAINED, """
known AS (SELECT w.n, w.hash, w.kind, t.label FROM windows w JOIN truth t USING (entry_id, var) WHERE t.human AND w.n = 2)""") + "SELECT k.kind, count(*) AS n_rows, count(*) FILTER (v.label IS NULL) AS n_dropped FROM known k LEFT JOIN vocab v USING (kind, label) GROUP BY k.kind")
def unknown_labels(spark, sf_dir):
    """F-14: windows of all entries against the vocabulary of the train entries: labels outside it leave the model."""
    _, _, vocab, _ = trained(spark, sf_dir)
    counts = model.window_counts(model.labelled_windows(document_entries(spark, sf_dir), sizes=(2,)))
    kept = model.top_labels(counts, vocab, k=1_000_000_000).groupBy("kind").agg(F.sum("count").alias("kept"))
    every = counts.groupBy("kind").agg(F.sum("count").alias("n_rows"))
    return every.join(kept, "kind", "left").select("kind", "n_rows", (F.col("n_rows") - F.coalesce("kept", F.lit(0))).alias("n_dropped"))


# ---- predictions ---------------------------------------------------------------------------------------------------


@query("prediction_lines", _REPORT_SQL + "SELECT w.var, w.pred, w.label, w.count, e.lang, w.layout_cat, w.layout_match, count(*) AS n FROM written w JOIN entries e USING (entry_id) GROUP BY ALL")
def prediction_lines(spark, sf_dir):
    """K-4: written records as JSON lines and read back."""
    _, test = divided(spark, sf_dir)
    path = _folder(spark, "predictions")
    corpus.write_predictions(metrics.output_records(_records(spark, sf_dir), test), path)
    rows = spark.read.text(path).select(F.from_json("value", "var string, pred string, label string, count long, meta map<string,string>, layout_category string, layout_match boolean").alias("r"))
    rows = rows.select("r.var", "r.pred", "r.label", "r.count", F.col("r.meta")["lang"].alias("lang"), F.col("r.layout_category").alias("layout_cat"), "r.layout_match")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


_RANKED = sql.chain(*sql.PREDICTED, sql.types("SELECT pred AS label FROM scored", "SELECT id, label FROM vocab WHERE kind = 'variable'"))


@query("one_primitive_parsed", _RANKED + """, flagged AS (SELECT s.*, coalesce(t.code = 3 AND len(t.structs) > 0, false) AS pointer FROM scored s JOIN type_table t ON t.label = s.pred),
passed AS (SELECT *, sum(CASE WHEN pointer THEN 0 ELSE 1 END) OVER (PARTITION BY entry_id, var, kind ORDER BY rank) AS others FROM flagged)
SELECT entry_id, var, kind, pred, row_number() OVER (PARTITION BY entry_id, var, kind ORDER BY rank) AS rank FROM passed WHERE kind = 'function' OR pointer OR others = 1""")
def one_primitive_parsed(spark, sf_dir):
    """F-6: the rule on parsed labels."""
    from ..operators import typesys
    from .queries import _solved

    _, _, vocab, _ = trained(spark, sf_dir)
    ranked = predict.scored(predict.votes(_solved(spark, sf_dir)))
    table_ = typesys.type_table(ranked.select(F.col("pred").alias("label")).distinct(), vocab)
    return review.one_primitive_parsed(ranked, table_).select("entry_id", "var", "kind", "pred", "rank")


#: What the text of the operator says of a few names, by hand: (name, primitive itself, a pointer to it is primitive).
_BY_HAND = [("int", True, True), ("unsigned char", True, False), ("char", True, False), ("bool", True, False), ("float", False, False), ("void", False, False), ("long long", True, True), ("uint16_t", True, True), ("_Bool", True, False), ("node", False, False), ("double", False, False), ("unsigned", True, True), ("short", True, True), ("const unsigned long", True, True), ("signed char", True, False)]


@query("primitive_types", "WITH h AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {b}, {p})" for i, (n, b, p) in enumerate(_BY_HAND)) + f""") AS t(i, name, base, pointer))
SELECT p_partkey AS key, name, base AS is_base, pointer AS is_pointer, false AS is_struct FROM part JOIN h ON p_partkey % {len(_BY_HAND)} = i""")
def primitive_types(spark, sf_dir):
    """T-29: a base type, a pointer and a struct for each part, against outcomes written by hand."""
    from ..functions.types import parse_type

    names = F.array(*[F.lit(n) for n, _, _ in _BY_HAND])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.get(names, (F.col("p_partkey") % len(_BY_HAND)).cast("int")).alias("name"))
    judged = lambda before, after: review.is_primitive(parse_type(F.concat(F.lit(before), F.col("name"), F.lit(after))))
    return rows.select("key", "name", judged('{"T": 1, "n": "', '", "s": 4}').alias("is_base"), judged('{"T": 3, "t": "', '"}').alias("is_pointer"), judged('{"T": 6, "n": "', '", "l": []}').alias("is_struct"))


_APPLICABLE = sql.chain(*sql.PREDICTED, sql.types("SELECT pred AS label FROM predictions", "SELECT id, label FROM vocab WHERE kind = 'variable'")) + """, tops AS (SELECT entry_id, CASE WHEN kind = 'variable' AND length(var) % 4 = 0 THEN 'var_' || var ELSE var END AS var, kind, pred, count, score FROM predictions WHERE rank = 1),
typed_tops AS (SELECT t.*, x.ok, coalesce(x.ok AND x.code = 1 AND x.n = 'int', false) AS primitive FROM tops t JOIN type_table x ON x.label = t.pred)
SELECT entry_id, var, kind, pred, count, round(score, 6) AS score FROM typed_tops WHERE (kind = 'function' AND count > 1 AND score > 0.6) OR (kind = 'variable' AND starts_with(var, 'var') AND ok AND score >= 0.3"""


def _applicable(skip: bool):
    def run(spark, sf_dir):
        """F-12 over the best predictions, half of the variables under generic names."""
        from ..operators import typesys

        found, vocab = predictions(spark, sf_dir)
        table_ = typesys.type_table(found.select(F.col("pred").alias("label")).distinct(), vocab)
        generic = F.when((F.col("kind") == "variable") & (F.length("var") % 4 == 0), F.concat(F.lit("var_"), F.col("var"))).otherwise(F.col("var"))
        rows = review.applicable(found.withColumn("var", generic), table_, skip_primitives=skip)
        return rows.select("entry_id", "var", "kind", "pred", "count", F.round("score", 6).alias("score"))

    return run


query("applicable", _APPLICABLE + " AND NOT primitive)")(_applicable(True))
query("applicable_all", _APPLICABLE + ")")(_applicable(False))


@query("retyped_worse", r"""
WITH b AS (SELECT conv_id, turn, coalesce(text, '') AS before FROM conversations),
a AS (SELECT *, CASE turn % 5 WHEN 0 THEN '  ' || replace(before, ' ', chr(10)) WHEN 1 THEN before || ' unaff_1' WHEN 2 THEN before || ' /* WARNING: x */' WHEN 3 THEN before || ' more' ELSE '' END AS after FROM b)
SELECT conv_id, turn, CASE turn % 5 WHEN 3 THEN contains(before, 'unaff') OR false WHEN 4 THEN regexp_replace(before, '\s', '', 'g') = '' ELSE true END AS worse FROM a""")
def retyped_worse(spark, sf_dir):
    """F-13: every turn beside a listing that is the same but for spaces, shows trouble, is longer, or empty."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("before"))
    k = F.col("turn") % 5
    after = F.when(k == 0, F.concat(F.lit("  "), F.replace("before", F.lit(" "), F.lit("\n")))).when(k == 1, F.concat("before", F.lit(" unaff_1"))).when(k == 2, F.concat("before", F.lit(" /* WARNING: x */"))).when(k == 3, F.concat("before", F.lit(" more"))).otherwise("")
    return rows.select("conv_id", "turn", review.worse(F.col("before"), after).alias("worse"))


@query("unknown_symbols", sql.chain(*sql.PREDICTED) + "SELECT entry_id, var, kind, rank, pred FROM predictions WHERE var NOT IN (SELECT var FROM named JOIN split USING (entry_id) WHERE train)")
def unknown_symbols(spark, sf_dir):
    """J-14: predictions for symbols that the train entries do not have."""
    from ..functions.windows import occurrences

    train, _ = divided(spark, sf_dir)
    return review.unknown_symbols(predictions(spark, sf_dir)[0], occurrences(train).select("var")).select("entry_id", "var", "kind", "rank", "pred")


# ---- archives, lists and files ---------------------------------------------------------------------------------------


def _archives(spark, sf_dir) -> str:
    """An archive for each region with two members for each of its nations, and two that do not count."""
    folder = _folder(spark, "archives")
    nations = table(spark, sf_dir, "nation").collect()  # 25 rows whatever the scale
    for region in sorted({n.n_regionkey for n in nations}):
        raw = io.BytesIO()
        with lzma.open(raw, "wb") as out, tarfile.open(fileobj=out, mode="w") as tar:
            for n in [x for x in nations if x.n_regionkey == region]:
                for name in (f"./bins/{region}/h{n.n_nationkey}.jsonl.gz", f"types/{region}/h{n.n_nationkey}.json.gz", f"types/{region}/h{n.n_nationkey}.jsonl.gz", f"notes/{n.n_nationkey}"):
                    info = tarfile.TarInfo(name)
                    info.size = len(n.n_name)
                    tar.addfile(info, io.BytesIO(n.n_name.encode()))
        _put(spark, f"{folder}/r{region}.tar.xz", raw.getvalue())
    return folder


_MEMBERS = """WITH m AS (SELECT n_regionkey, n_nationkey, n_name, unnest(['bins', 'types']) AS kind FROM nation)"""


@query("archive_members", _MEMBERS + " SELECT 'h' || n_nationkey AS key, kind, kind || '/h' || n_nationkey || CASE kind WHEN 'bins' THEN '.jsonl.gz' ELSE '.json.gz' END AS flat, strlen(n_name) AS size, n_name AS body FROM m")
def archive_members(spark, sf_dir):
    """S-13, T-27: the members of every archive."""
    return archive.read_members(spark, _archives(spark, sf_dir)).select("key", "kind", "flat", "size", F.col("content").cast("string").alias("body"))


@query("archive_files", "SELECT DISTINCT 'r' || n_regionkey || '.tar.xz' AS file FROM nation")
def archive_files(spark, sf_dir):
    """S-12."""
    return archive.find_archives(spark, _archives(spark, sf_dir)).select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("file"))


@query("archive_stats", _MEMBERS + " SELECT count(DISTINCT n_regionkey) AS archives, count(*) AS files, sum(strlen(n_name))::BIGINT AS bytes, count(DISTINCT n_nationkey) AS keys FROM m")
def archive_stats(spark, sf_dir):
    """A-30."""
    return archive.archive_stats(archive.read_members(spark, _archives(spark, sf_dir), content=False))


@query("archive_extract", _MEMBERS + """, rest AS (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1 ORDER BY md5('h' || n_nationkey || ':42'), 'h' || n_nationkey LIMIT 3)
SELECT 'h' || n_nationkey AS key, kind FROM m WHERE n_regionkey = 1 OR n_nationkey IN (SELECT n_nationkey FROM rest)""")
def archive_extract(spark, sf_dir):
    """F-11, O-9: the listed members and those of three sampled keys (the operator's parameter)."""
    listed = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("key"))
    members = cut(archive.read_members(spark, _archives(spark, sf_dir), content=False))
    return dataset.listed_and_sample(members, listed, "key", 3).select("key", "kind")


@query("hash_list_file", "SELECT DISTINCT md5(c_custkey::VARCHAR) AS key FROM customer")
def hash_list_file(spark, sf_dir):
    """S-14, K-6: distinct keys written as a list, with blanks around, and read back."""
    path = _folder(spark, "hashes")
    keys = table(spark, sf_dir, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("key"))
    archive.write_hash_list(keys.union(keys), path)
    spaced = _folder(spark, "hashes")
    spark.read.text(path).select(F.explode(F.array(F.concat(F.lit("  "), F.col("value"), F.lit(" ")), F.lit(""))).alias("value")).write.text(spaced)
    return archive.read_hash_list(spark, spaced)


def _files(spark, sf_dir) -> str:
    """A file for each nation: those with an even key begin as executables do."""
    folder = _folder(spark, "files")
    for n in table(spark, sf_dir, "nation").collect():  # 25 rows whatever the scale
        _put(spark, f"{folder}/{'sub/' if n.n_nationkey % 3 == 0 else ''}f{n.n_nationkey}", (b"\x7fELF" if n.n_nationkey % 2 == 0 else b"#!") + n.n_name.encode())
    return folder


@query("file_digests", "SELECT 'f' || n_nationkey AS file, strlen(n_name) + CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 2 END AS length, sha256(CASE WHEN n_nationkey % 2 = 0 THEN '\x7FELF'::BLOB ELSE '#!'::BLOB END || n_name::BLOB) AS digest FROM nation WHERE n_nationkey % 3 <> 0")
def file_digests(spark, sf_dir):
    """K-7, T-28."""
    return archive.file_digests(spark, _files(spark, sf_dir))


@query("executables", "SELECT sha256('\x7FELF'::BLOB || n_name::BLOB) || '_f' || n_nationkey AS file_id, strlen(n_name) + 4 AS length FROM nation WHERE n_nationkey % 2 = 0")
def executables(spark, sf_dir):
    """S-15, T-28: executables anywhere below a folder."""
    return archive.executables(spark, _files(spark, sf_dir)).select("file_id", "length")
