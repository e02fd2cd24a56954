"""The test tables as labelled token sequences, whole texts and all rows (Spark side; `sql.py` has the DuckDB side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SEGMENT, is_marked, name_of

TARGET_LENGTH = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Input of fewer splits than cores over all cores: sequences are heavy, and a small file is one split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def mark_words(words: Column) -> Column:
    """Words of ten characters or more become targets; those of odd length functions."""
    name = lambda t: F.concat(F.when(F.length(t) % 2 == 1, "sub_").otherwise(""), t)
    return F.transform(words, lambda t: F.when(F.length(t) >= TARGET_LENGTH, F.concat(F.lit("@@"), name(t), F.lit("@@"))).otherwise(t))


def made_label(var: Column, lang: Column, key: Column) -> Column:
    """A type label that follows from a name, a language and an entry: JSON of several categories and plain text.

    Structs of one name differ in layout, copies of an entry disagree on some labels, and some labels are unique.
    """
    wide = F.when(F.length(var) % 4 == 0, "8").otherwise("4")
    k = (3 * F.length(var) + F.instr(var, "e")) % 8
    function = F.concat(F.lit('{"T": 9, "t": "'), F.when(k < 4, "HAL_").otherwise("run_"), lang, F.lit('"}'))
    forms = [
        F.concat(F.lit('{"T": 6, "n": "node_'), lang, F.lit('", "l": [{"T": 4, "n": "a", "t": "int", "s": '), wide, F.lit('}, {"T": 5, "s": 4}, {"T": 4, "n": "p", "t": "char *", "s": 8}], "s": 16}')),
        F.concat(F.lit('{"T": 3, "t": "const node_'), lang, F.lit('"}')),
        F.concat(F.lit('{"T": 7, "n": "u_'), lang, F.lit('", "l": [{"T": 4, "n": "i", "t": "int", "s": 4}, {"T": 4, "n": "d", "t": "double", "s": 8}]}')),
        F.concat(F.lit('{"T": 2, "n": '), F.length(lang).cast("string"), F.lit(', "s": 4, "t": "int"}')),
        F.lit('{"T": 1, "n": "int", "s": 4}'),
        F.lit('{"T": 10}'),
        F.when(F.length(var) % 8 == 2, F.concat(F.lit("ptr<"), var, F.lit(">"))).otherwise(F.concat(F.lit("ptr<v"), (key % 3).cast("string"), F.lit(">"))),
        F.concat(F.lit('{"T": 3, "t": "u_'), lang, F.lit('_0"}')),
    ]
    out = forms[-1]
    for i in range(len(forms) - 2, -1, -1):
        out = F.when(k == i, forms[i]).otherwise(out)
    return F.when(var.startswith("sub_"), function).otherwise(out)


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`entry_id, tokens, labels, meta` of `documents`."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0))
    df = docs.select(F.col("doc_id").alias("entry_id"), mark_words(words).alias("tokens"), "lang", "source")
    names = F.array_distinct(F.transform(F.filter("tokens", is_marked), name_of))
    label = lambda v: F.struct((F.length(v) % 7 != 0).alias("human"), made_label(v, F.col("lang"), F.col("entry_id")).alias("label"))
    labels = F.create_map(F.lit("type"), F.map_from_entries(F.transform(names, lambda v: F.struct(v.alias("key"), label(v).alias("value")))))
    return df.select("entry_id", "tokens", labels.alias("labels"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("meta"))


def conversation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`entry_id, tokens` of `conversations`: the turns in order with a segment border between any two."""
    rows = table(spark, sf_dir, "conversations")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\S+"), F.lit(0))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", mark_words(words).alias("t")))).alias("turns"))
    joined = F.flatten(F.transform("turns", lambda x, i: F.when(i > 0, F.concat(F.array(F.lit(SEGMENT)), x["t"])).otherwise(x["t"])))
    return turns.select(F.col("conv_id").alias("entry_id"), joined.alias("tokens"))


def odd_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`key, tokens`: tokens of every shape that normalisation knows, made from all rows of `orders`."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    code = F.lower(F.hex(k * 7919))
    eight = F.lpad(F.hex(k), 8, "0")
    made = [
        F.concat(F.lit("sub_"), code), F.concat(F.lit("0x"), code), F.concat(F.lit("0x00"), code), F.concat(F.lit("-"), text), F.concat(F.lit("+"), text), (k % 300).cast("string"), F.concat(F.lit("iVar"), text), F.concat(F.lit("puStack_"), text),
        F.concat(F.lit("s_abc_"), eight), F.concat(F.lit("PTR_x"), eight), F.concat(F.lit('"'), text, F.lit('"')), F.concat(F.lit("@@a0x"), text, F.lit("@@")), F.concat(F.lit("LAB_0x"), code), F.concat(F.lit("x0x"), code), F.concat(F.lit("0x"), code, F.lit("ffffffffffff")), F.concat(text, F.lit("99999999999999999")),
        F.lit("thunk_FUN_1"), F.lit("FUN_00"), F.lit("return"), F.lit("->"), F.lit("<<="), F.lit("void"), F.lit('"'), F.concat(F.lit("0x"), text, F.lit("u")), F.concat(F.lit("uRam"), eight), F.lit("0x8000000000000000"), F.lit("-0"),
    ]
    return table(spark, sf_dir, "orders").select(k.alias("key"), F.array(*made).alias("tokens"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`entry_id, code`: every page's html as a listing."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("entry_id"), F.coalesce("html", F.lit("")).alias("code"))


def decompiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`entry_id, code`: a listing for each row of `part` with made-up symbols of all kinds."""
    k = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    code = F.concat(
        F.lit("int sub_"), F.lower(F.hex("p_partkey")), F.lit("(char *param1, int param"), size, F.lit(") {\n  int iVar"), k, F.lit(" = sub_40"), size, F.lit("(var"), k, F.lit(", \"s "), F.col("p_name"), F.lit(" \\\" x\");\n  if (iVar"),
        k, F.lit(" <= 0x"), k, F.lit(" && local_Stack_"), size, F.lit("[stack"), size, F.lit("] != -"), k, F.lit(") return "), F.col("p_type"), F.lit(";\n  *"), F.lit("variable += 1; goto LAB_"), k, F.lit("; }"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_id"), code.alias("code"))


def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`key, label`: a type label for each row of `part`: all categories, definitions that vary, and malformed ones."""
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 11
    brand = F.regexp_replace("p_brand", "#", "_")
    low = (F.col("p_size") % 5).cast("string")
    fields = F.concat(F.lit('[{"T": 4, "n": "a", "t": "int", "s": 4}, {"T": 5, "s": '), low, F.lit('}, {"T": 4, "n": "b", "t": "long", "s": '), F.when(F.col("p_size") % 3 == 0, "8").otherwise("4"), F.lit("}]"))
    forms = [
        F.concat(F.lit('{"T": 6, "n": "'), brand, F.lit('", "l": '), fields, F.lit(', "s": 16}')),
        F.concat(F.lit('{"T": 6, "n": "'), brand, F.lit('_t", "l": '), fields, F.lit(', "s": '), size, F.lit("}")),
        F.concat(F.lit('{"T": 7, "n": "U_'), brand, F.lit('", "l": '), fields, F.lit("}")),
        F.concat(F.lit('{"T": 3, "t": "const '), brand, F.lit('"}')),
        F.concat(F.lit('{"T": 3, "t": "* volatile U_'), brand, F.lit('_'), low, F.lit('"}')),
        F.concat(F.lit('{"T": 2, "n": '), low, F.lit(', "s": 4, "t": "int"}')),
        F.concat(F.lit('{"T": 6, "n": '), size, F.lit(', "l": []}')),
        F.concat(F.lit('{"T": 6, "n": "x", "l": [{"n": "a", "s": 4}], "s": 4}')),
        F.concat(F.lit("ptr<"), brand, F.lit(">")),
        F.concat(F.lit('{"T": 9, "t": "HAL_'), brand, F.lit('"}')),
        F.concat(F.lit('{"T": 6, "n": "'), brand, F.lit('", "l": [{"T": 4, "n": "a", "t": "int"}, {"T": 4, "n": "z", "t": "$q", "s": '), size, F.lit('}], "s": 8}')),
    ]
    out = forms[-1]
    for i in range(len(forms) - 2, -1, -1):
        out = F.when(k == i, forms[i]).otherwise(out)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), out.alias("label"))
