from pyspark.sql import functions as F

from ctxvote.functions.types import parse_type
from ctxvote.operators import predict, review


def test_primitive_types(spark):
    rows = [
        ('{"T": 1, "n": "int", "s": 4}', True), ('{"T": 1, "n": "float", "s": 4}', False), ('{"T": 1, "n": "void"}', False), ('{"T": 1, "n": "bool", "s": 1}', True), ('{"T": 1, "n": "unsigned char", "s": 1}', True), ('{"T": 3, "t": "unsigned int"}', True),
        ('{"T": 3, "t": "short *"}', True), ('{"T": 3, "t": "char"}', False), ('{"T": 3, "t": "const unsigned char"}', False), ('{"T": 3, "t": "float"}', False), ('{"T": 3, "t": "bool"}', False), ('{"T": 3, "t": "node"}', False), ('{"T": 6, "n": "int", "l": []}', False), ('{"T": 2, "n": 4, "s": 4, "t": "int"}', False), ("int", False), ('{"T": 3}', False), ('{"T": 1}', False),
    ]
    got = spark.createDataFrame(rows, "label string, want boolean").select("label", "want", review.is_primitive(parse_type(F.col("label"))).alias("got")).collect()
    assert [(r.label, r.got) for r in got] == rows


def test_contexts_count_whether_known_or_not(spark):
    rows = [(1, "a", 3, False), (1, "a", 3, True), (1, "a", 9, False), (1, "a", 9, True), (1, "b", 5, False), (1, "b", 5, True)]
    twice = [(*r, n) for r in rows for n in (2, 4)]
    got = predict.context_counts(spark.createDataFrame(twice, "entry_id long, var string, pos int, flank boolean, n int")).collect()
    assert {r["var"]: r.contexts for r in got} == {"a": 4, "b": 2}


def test_application_filters(spark):
    kinds = [('{"T": 6, "n": "s", "l": []}', "x"), ('{"T": 1, "n": "int", "s": 4}', "x"), ("no type", "x")]
    table = spark.createDataFrame(kinds, "label string, _ string").select("label", parse_type(F.col("label")).alias("parsed"))
    struct, integer, text = (k for k, _ in kinds)
    rows = [
        ("var1", "variable", struct, 1, 0.5), ("var2", "variable", integer, 1, 0.9), ("var3", "variable", text, 1, 0.9), ("name", "variable", struct, 1, 0.9), ("param4", "variable", struct, 1, 0.2), ("sub_1", "function", text, 2, 0.7), ("sub_2", "function", text, 1, 0.9), ("sub_3", "function", text, 5, 0.6),
    ]
    found = spark.createDataFrame([(1, *r, 1) for r in rows], "entry_id long, var string, kind string, pred string, count long, score double, rank int")
    names = lambda **k: {r["var"] for r in review.applicable(found, table, **k).collect()}
    assert names() == {"var1", "sub_1"}
    assert names(skip_primitives=False) == {"var1", "var2", "sub_1"}
    assert names(threshold=0.0) == {"var1", "param4", "sub_1"}


def test_discards_and_known_symbols(spark):
    rows = [("a b", "ab ", True), ("a", "a unaff", True), ("a", "a /* WARNING", True), ("/* WARNING", "x /* WARNING", False), ("a", "b", False)]
    got = spark.createDataFrame(rows, "before string, after string, want boolean").select("want", review.worse(F.col("before"), F.col("after")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    left = review.unknown_symbols(spark.createDataFrame([("a",), ("b",)], "var string"), spark.createDataFrame([("b",), ("b",)], "var string"))
    assert [r["var"] for r in left.collect()] == ["a"]


def test_one_primitive_by_parsed_types(spark):
    ranked = spark.createDataFrame([(1, "v", "variable", r, p, 0.5) for r, p in ((1, "int"), (2, "ptr"), (3, "char"), (4, "ptr2"))] + [(1, "f", "function", r, p, 0.5) for r, p in ((1, "int"), (2, "char"))], "entry_id long, var string, kind string, rank int, pred string, score double")
    definition = "array<struct<code:int,n:string,l:array<struct<code:int,n:string,t:string,s:bigint>>,s:bigint,t:string>>"
    table = spark.createDataFrame([("int", (1, None), []), ("ptr", (3, "s"), [(6, "s", [], 4, None)]), ("char", (3, "c"), []), ("ptr2", (3, "s"), [(6, "s", [], 4, None)])], f"label string, head struct<code:int,t:string>, defs {definition}")
    got = sorted((r["var"], r["rank"], r.pred) for r in review.one_primitive_parsed(ranked, table).collect())
    assert got == [("f", 1, "int"), ("f", 2, "char"), ("v", 1, "int"), ("v", 2, "ptr"), ("v", 3, "ptr2")]
