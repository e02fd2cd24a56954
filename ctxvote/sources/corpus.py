"""Corpora, vocabularies and models on storage (S-1 to S-10, S-16, K-1 to K-5)."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize_with_functions
from ..lineage import shuffles_go
from ..operators.model import BROADCAST_LABELS

LABELS = "map<string,map<string,struct<human:boolean,label:string>>>"
ENTRY = f"tokens array<string>, labels {LABELS}, meta map<string,string>"
MODEL = "hash string, kind string, total bigint, preds array<struct<vocab_id:int,label:string,count:bigint>>"


class CorpusError(ValueError):
    """A corpus, vocabulary or model that cannot be read."""


def read_entries(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """S-1, S-2, S-4: `entry_id, tokens, labels, meta, raw` of JSON lines; several files and folders are one corpus.

    Lines without tokens or labels are malformed: they are dropped, or stop the read with `strict`.  `entry_id` is
    a hash of file name, line and place in the read: stable for the same files and split size, unique for equal lines.
    """
    lines = _lines(spark, path).select(F.col("value").alias("raw"), F.input_file_name().alias("_file"))
    parsed = lines.where(F.trim("raw") != "").select("raw", "_file", F.from_json("raw", ENTRY, {"mode": "PERMISSIVE"}).alias("e"))
    good = F.col("e.tokens").isNotNull() & F.col("e.labels").isNotNull()
    if strict:
        failed = F.raise_error(F.concat(F.lit("malformed corpus line in "), F.col("_file"))).cast("boolean")
        parsed = parsed.where(F.when(good, F.lit(True)).otherwise(failed))
    else:
        parsed = parsed.where(good)
    identity = F.xxhash64("_file", "raw", F.monotonically_increasing_id())
    return parsed.select(identity.alias("entry_id"), "e.tokens", "e.labels", F.coalesce("e.meta", F.create_map().cast("map<string,string>")).alias("meta"), "raw")


def count_entries(spark: SparkSession, path: str) -> int:
    """S-3: the number of lines of a corpus."""
    return _lines(spark, path).count()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a corpus: one file, a folder that was written as one, or a folder of such files."""
    named = ".jsonl" in path.rstrip("/").rpartition("/")[2]
    return spark.read.text(path, pathGlobFilter=None if named else "*.jsonl*", recursiveFileLookup=True)


def write_entries(entries: DataFrame, path: str) -> None:
    """K-5, O-11: entries as JSON lines; a `raw` line goes out as it came in."""
    made = F.to_json(F.struct("tokens", "labels", "meta"))
    line = F.coalesce(F.col("raw"), made) if "raw" in entries.columns else made
    entries.select(line.alias("value")).write.text(path)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """S-5: `entry_id, code` of plain texts, one function a file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_file"), F.col("value").alias("code"))
    return files.select(F.xxhash64("_file").alias("entry_id"), F.regexp_extract("_file", r"([^/]*)\z", 1).alias("file"), "code")


def entries_from_listings(listings: DataFrame, targets: str = "targets") -> DataFrame:
    """S-5, S-6: entries of listings whose array column `targets` names the symbols; every target, functions too, has the
    human placeholder label `type` under both label types."""
    tokens, names = tokenize_with_functions(F.col("code"), F.col(targets))
    rows = listings.select("entry_id", tokens.alias("tokens"), names.alias("_names"))
    label = F.struct(F.lit(True).alias("human"), F.lit("type").alias("label"))
    of = F.map_from_arrays("_names", F.transform("_names", lambda _: label))
    return rows.select("entry_id", "tokens", F.create_map(F.lit("type"), of, F.lit("name"), of).alias("labels"), F.create_map().cast("map<string,string>").alias("meta"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """K-1: a vocabulary, both kinds, as Parquet."""
    vocab.write.partitionBy("kind").parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id int, label string, count bigint, kind string").parquet(path).select("kind", "id", "label", "count")


def read_vocab_json(spark: SparkSession, path: str, kind: str = "variable") -> DataFrame:
    """S-7: a vocabulary exchanged as one JSON object of parallel arrays."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "entries array<string>, counts array<bigint>", {"mode": "FAILFAST"}).alias("v"))
    rows = parsed.select(F.posexplode(F.arrays_zip("v.entries", "v.counts")).alias("id", "x"))
    return rows.select(F.lit(kind).alias("kind"), "id", F.col("x.entries").alias("label"), F.col("x.counts").alias("count"))


def write_vocab_json(vocab: DataFrame, kind: str, path: str) -> None:
    """K-1: one kind as one JSON object; a vocabulary is the size of its label set."""
    rows = vocab.where(F.col("kind") == kind).agg(F.array_sort(F.collect_list(F.struct("id", "label", "count"))).alias("r"))
    ids = F.map_from_arrays(F.transform("r", lambda x: x["label"]), F.transform("r", lambda x: x["id"]))
    made = F.struct(F.transform("r", lambda x: x["label"]).alias("entries"), F.transform("r", lambda x: x["count"]).alias("counts"), ids.alias("map"))
    rows.select(F.to_json(made).alias("value")).write.text(path)


def read_vocab_tsv(spark: SparkSession, path: str, kind: str = "variable") -> DataFrame:
    """S-8: the older tab-separated vocabulary; a missing or non-numeric count is an error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n+\z", ""), "\n")).alias("id", "line"))
    cells = F.split("line", "\t")
    count = F.when(F.size(cells) >= 2, F.try_element_at(cells, F.lit(2)).try_cast("bigint"))
    checked = F.coalesce(count, F.raise_error(F.concat(F.lit("no count in vocabulary line: "), F.col("line"))).cast("bigint"))
    return lines.select(F.lit(kind).alias("kind"), "id", cells[0].alias("label"), checked.alias("count"))


def function_path(path: str) -> str:
    """T-26: the function vocabulary's file beside the variables': `a.vocab` gives `a.fn.vocab`."""
    folder, _, name = path.rpartition("/")
    stem, dot, suffix = name.rpartition(".")
    made = f"{stem}.fn.{suffix}" if dot and stem else f"{name}.fn"
    return f"{folder}/{made}" if folder else made


def write_model(nested: DataFrame, path: str, settings: dict[str, object], placed: bool = False) -> None:
    """K-2, K-3, O-5: nested model rows, a folder for each size, sorted by hash so that row groups skip; `settings` (label type,
    flanking, full strip, k) are kept beside them and checked when the model is used.

    `placed` says that the rows come from a shuffle by window (as those of a new model do): they are sorted where they
    lie, and only what was counted has been on disk.
    """
    spark = nested.sparkSession
    rows = nested if placed else nested.repartition("n", F.substring("hash", 1, 2))
    with shuffles_go(spark):
        rows.sortWithinPartitions("n", "hash").write.option("compression", "zstd").partitionBy("n").parquet(f"{path}/windows")
    spark.createDataFrame([(k, str(v)) for k, v in sorted(settings.items())], "key string, value string").coalesce(1).write.parquet(f"{path}/settings")


def read_model(spark: SparkSession, path: str, settings: dict[str, object] | None = None) -> DataFrame:
    """S-9, S-10, O-6: the model's rows, sizes from its folders; other settings than those it was built with, and a model
    without any size, are errors."""
    known = {r.key: r.value for r in spark.read.parquet(f"{path}/settings").collect()}  # a handful of rows
    for k, v in (settings or {}).items():
        if known.get(k) != str(v):
            raise CorpusError(f"the model was built with {k}={known.get(k)}, not {v}")
    rows = spark.read.schema(f"{MODEL}, n int").parquet(f"{path}/windows")
    if rows.select("n").where("n > 0").isEmpty():
        raise CorpusError(f"the model at {path} has no sizes")
    return rows.select("n", "hash", "kind", "total", "preds")


#: Widths in bits of the machines that a platform has models for.
ARCHITECTURES = (32, 64)


def write_platform(models: dict[int, DataFrame], path: str, settings: dict[str, object], placed: bool = False) -> None:
    """S-16: one nested model for each width in bits, in folders of their own."""
    for bits, nested in models.items():
        if bits not in ARCHITECTURES:
            raise CorpusError(f"no machine is {bits} bits wide")
        write_model(nested, f"{path}/{bits}", settings, placed)


def read_platform(spark: SparkSession, path: str, settings: dict[str, object] | None = None) -> DataFrame:
    """S-16: `arch_bits` and the rows of the models of all widths that can be read; none at all is an error."""
    found, failed = [], []
    for bits in ARCHITECTURES:
        try:
            found.append(read_model(spark, f"{path}/{bits}", settings).select(F.lit(bits).alias("arch_bits"), "*"))
        except (CorpusError, AnalysisException) as error:  # a folder that is missing, empty or of other settings
            failed.append(f"{bits}: {error}")
    if not found:
        raise CorpusError(f"no model of {path} can be read ({'; '.join(failed)})")
    return reduce(DataFrame.unionByName, found)


def nested_from_flat_arrays(rows: DataFrame, k: int, vocab: DataFrame | None = None) -> DataFrame:
    """S-11: windows of an older exchange format, `n, hash, kind, total, typ array, counts array` with k cells a window, as
    nested rows.  Labels come from `vocab(kind, id, label)`; cells whose id it lacks go, and so does padding.  Cells are
    brought together by window as ids; a vocabulary that is small enough meets them where they land."""
    cell = F.arrays_zip("typ", "counts")
    flat = rows.select("n", "hash", "kind", "total", F.posexplode(F.slice(cell, 1, k)).alias("rank", "_c"))
    flat = flat.select("n", "hash", "kind", "total", "rank", F.col("_c.typ").cast("int").alias("vocab_id"), F.col("_c.counts").cast("bigint").alias("count")).where("count > 0")
    if vocab is not None:
        labels = vocab.select("kind", F.col("id").alias("vocab_id"), "label")
        if labels.count() <= BROADCAST_LABELS:
            flat, labels = flat.repartition("n", "hash", "kind"), F.broadcast(labels)
        flat = flat.join(labels, ["kind", "vocab_id"])
    else:
        flat = flat.withColumn("label", F.lit(None).cast("string"))
    preds = F.array_sort(F.collect_list(F.struct("rank", "vocab_id", "label", "count")))  # k cells at most
    nested = flat.groupBy("n", "hash", "kind").agg(F.first("total").alias("total"), preds.alias("_p"))
    return nested.select("n", "hash", "kind", "total", F.transform("_p", lambda p: F.struct(p["vocab_id"].alias("vocab_id"), p["label"].alias("label"), p["count"].alias("count"))).alias("preds"))


def flat_arrays(nested: DataFrame, k: int) -> DataFrame:
    """The older exchange format of a model: `typ` and `counts` of k cells, padded with zeros."""
    padded = lambda field, kind: F.slice(F.concat(F.transform("preds", lambda p: p[field].cast(kind)), F.array_repeat(F.lit(0).cast(kind), k)), 1, k)
    return nested.select("n", "hash", "kind", "total", padded("vocab_id", "bigint").alias("typ"), padded("count", "bigint").alias("counts"))


def write_predictions(lines: DataFrame, path: str) -> None:
    """K-4: a JSON object a line."""
    lines.select("value").write.text(path)
