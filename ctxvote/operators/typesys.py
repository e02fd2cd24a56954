"""Type dimension, pointer resolution and comparators (A-29, J-8, J-9, C-1 to C-7).

Labels repeat a great deal, so everything here works on distinct labels and distinct (prediction, label) pairs, with
definitions as arrays beside them; predictions join the outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, types
from ..functions.types import ARRAY, MISSING, POINTER, STRUCT, UNION


def parsed_labels(labels: DataFrame) -> DataFrame:
    """`label, head, parsed, arr` of distinct labels."""
    distinct = labels.select("label").distinct()
    return distinct.select("label", types.header(F.col("label")).alias("head"), types.parse_type(F.col("label")).alias("parsed"), types.parse_array(F.col("label")).alias("arr"))


def type_definitions(vocab: DataFrame) -> DataFrame:
    """`name, defs` of the structs and unions that the variables' vocabulary names, in vocabulary order."""
    parsed = vocab.where("kind = 'variable'").select("id", types.parse_type(F.col("label")).alias("d"))
    named = parsed.where(F.col("d.code").isin(STRUCT, UNION) & F.col("d.n").isNotNull())
    rows = named.groupBy(F.col("d.n").alias("name")).agg(F.array_sort(F.collect_list(F.struct("id", "d"))).alias("_d"))
    return rows.select("name", F.transform("_d", lambda x: x["d"]).alias("defs"))


def definition_stats(vocab: DataFrame) -> DataFrame:
    """A-29: labels that do not parse, names with several definitions, and definitions beyond the first."""
    parsed = vocab.where("kind = 'variable'").select(types.parse_type(F.col("label")).alias("d"))
    errors = parsed.select(F.count_if(F.col("d").isNull()).alias("parse_errors"))
    sizes = type_definitions(vocab).select(F.size("defs").alias("n"))
    return errors.crossJoin(sizes.select(F.count_if(F.col("n") > 1).alias("multi_names"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")))  # one row each


def resolve(parsed: DataFrame, definitions: DataFrame) -> DataFrame:
    """J-8: `parsed` with `defs`: a struct's or union's own definition, or those of the first candidate name that a pointer's
    target is defined under; an empty array where there is none."""
    pointers = parsed.where((F.col("parsed.code") == POINTER) & F.col("parsed.t").isNotNull())
    tried = pointers.select("label", F.posexplode(names.type_name_candidates(F.col("parsed.t"))).alias("nth", "name"))
    first = tried.join(definitions, "name").groupBy("label").agg(F.min_by("defs", "nth").alias("_pointed"))
    none = F.array().cast(f"array<{types.TYPE}>")
    own = F.when(F.col("parsed.code").isin(STRUCT, UNION), F.array("parsed"))
    return parsed.join(first, "label", "left").select("label", "head", "parsed", "arr", F.coalesce(own, "_pointed", none).alias("defs"))


def structs(defs: Column) -> Column:
    return F.filter(defs, lambda d: d["code"] == STRUCT)


def unions(defs: Column) -> Column:
    return F.filter(defs, lambda d: d["code"] == UNION)


def category(head: Column, defs: Column) -> Column:
    """C-3: struct, union, array, ptr-struct, ptr-union or null."""
    pointer = F.when(F.size(structs(defs)) > 0, "ptr-struct").when(F.size(unions(defs)) > 0, "ptr-union")
    return F.when(head["code"] == STRUCT, "struct").when(head["code"] == UNION, "union").when(head["code"] == ARRAY, "array").when(head["code"] == POINTER, pointer)


def merged(category: Column) -> Column:
    """A category without the difference of a pointer."""
    return F.regexp_replace(category, r"\Aptr-", "")


def is_missing(parsed: Column) -> Column:
    """C-6: category 10."""
    return F.coalesce(parsed["code"] == MISSING, F.lit(False))


def type_table(labels: DataFrame, vocab: DataFrame) -> DataFrame:
    """`label, head, parsed, arr, defs, cat, missing, composite` of distinct labels."""
    rows = resolve(parsed_labels(labels), type_definitions(vocab))
    return rows.select("*", category(F.col("head"), F.col("defs")).alias("cat"), is_missing(F.col("parsed")).alias("missing"), (F.size("defs") > 0).alias("composite"))


def _any_pair(a: Column, b: Column, test) -> Column:
    """J-9: whether some pair of two short arrays passes."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.coalesce(test(x, y), F.lit(False))))


def _same_sizes(a: Column, b: Column, code: int) -> Column:
    return _any_pair(a, b, lambda x, y: types.member_sizes(x, code) == types.member_sizes(y, code))


def layout(p: str, q: str) -> tuple[Column, Column]:
    """C-1: (category, match) of a prediction's and a label's columns (structs with the fields of `type_table`)."""
    head, parsed, arr, defs = (F.col(f"{p}.{c}") for c in ("head", "parsed", "arr", "defs"))
    lhead, larr, ldefs = (F.col(f"{q}.{c}") for c in ("head", "arr", "defs"))
    code = head["code"]
    ls, lu = structs(ldefs), unions(ldefs)
    own_struct = (code == STRUCT) & types.member_sizes(parsed, STRUCT).isNotNull() & (F.size(ls) > 0)
    own_union = (code == UNION) & types.member_sizes(parsed, UNION).isNotNull() & (F.size(lu) > 0)
    to_struct = (code == POINTER) & (F.size(structs(defs)) > 0)
    to_union = (code == POINTER) & (F.size(structs(defs)) == 0) & (F.size(unions(defs)) > 0)
    arrays = (code == ARRAY) & arr.isNotNull() & (lhead["code"] == ARRAY) & larr.isNotNull()
    cat = F.when(own_struct, "struct").when(own_union, "union").when(to_struct & (F.size(ls) > 0), "ptr-struct").when(to_union & (F.size(lu) > 0), "ptr-union").when(arrays, "array")
    same_array = (arr["n"] == larr["n"]) & (arr["n"] * arr["s"] == larr["n"] * larr["s"])
    match = F.when(cat.isin("struct", "ptr-struct"), _same_sizes(structs(defs), ls, STRUCT)).when(cat.isin("union", "ptr-union"), _same_sizes(unions(defs), lu, UNION)).when(cat == "array", same_array)
    return cat, match


def field_result(p: str, q: str) -> Column:
    """C-2: `struct<tp, fp, fn>` of the pair of definitions with the most common (offset, width); the first of those."""
    none = F.array().cast("array<array<struct<off:bigint,width:bigint>>>")
    sets = lambda c: F.filter(F.coalesce(F.transform(structs(F.col(f"{c}.defs")), types.offset_widths), none), lambda x: x.isNotNull())

    def compare(a: Column, i: Column) -> Column:
        def one(b: Column, j: Column) -> Column:
            tp = F.size(F.array_intersect(a, b))
            return F.struct((-tp).alias("order"), i.alias("i"), j.alias("j"), tp.alias("tp"), F.size(F.array_except(a, b)).alias("fp"), F.size(F.array_except(b, a)).alias("fn"))

        return F.transform(sets(q), one)

    best = F.array_min(F.flatten(F.transform(sets(p), compare)))
    return F.when(best.isNotNull(), F.struct(best["tp"].alias("tp"), best["fp"].alias("fp"), best["fn"].alias("fn")))


def structs_fuzzy(a: Column, b: Column) -> Column:
    """C-4: equal definitions, or similar names and mostly equal offsets; true where no offsets can be compared."""
    x, y = types.named_offsets(a), types.named_offsets(b)
    none = F.array().cast("array<bigint>")
    off = lambda c: F.coalesce(F.transform(c, lambda m: m["off"]), none)
    total = F.least(F.size(off(x)), F.size(off(y)))
    hits = F.size(F.filter(off(x), lambda o: F.array_contains(off(y), o)))
    fields = F.when(a["l"].isNull() | b["l"].isNull(), True).when(F.abs(F.size(a["l"]) - F.size(b["l"])) > 2, False).when(total > 0, hits / total >= 0.8).otherwise(True)
    similar = F.coalesce(names.names_similar(a["n"], b["n"]), F.lit(False))
    equal = F.coalesce(types.signature(a) == types.signature(b), F.lit(False))
    return (a["code"] == STRUCT) & (b["code"] == STRUCT) & (equal | (similar & fields))


def fuzzy(p: str, q: str) -> Column:
    """C-5: whether any pair of definitions is fuzzily equal."""
    return _any_pair(F.col(f"{p}.defs"), F.col(f"{q}.defs"), structs_fuzzy)


def same_composite(p: str, q: str) -> Column:
    """C-7: whether a prediction and a label of the same merged category have the same layout."""
    cat = merged(F.col(f"{p}.cat"))
    defs, ldefs = F.col(f"{p}.defs"), F.col(f"{q}.defs")
    same = F.when(cat == "struct", _same_sizes(defs, ldefs, STRUCT)).when(cat == "union", _same_sizes(unions(defs), unions(ldefs), UNION)).otherwise(F.col(f"{p}.cat") == F.col(f"{q}.cat"))
    return (cat == merged(F.col(f"{q}.cat"))) & same


def compare_pairs(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Distinct `pred, label` with their types and comparisons.

    `p` and `q` are the rows of `type_table` of prediction and label; `layout_cat`, `layout_match`, `fields`, `fuzzy`,
    `same_layout` compare them.
    """
    distinct = pairs.select("pred", "label").distinct()
    fields = F.struct("label", "head", "parsed", "arr", "defs", "cat", "missing", "composite")
    own = table.select(F.col("label").alias("pred"), fields.alias("p"))
    other = table.select("label", fields.alias("q"))
    rows = distinct.join(own, "pred").join(other, "label")
    cat, match = layout("p", "q")
    rows = rows.select("pred", "label", "p", "q", cat.alias("layout_cat"), match.alias("layout_match"))
    return rows.select("*", field_result("p", "q").alias("fields"), fuzzy("p", "q").alias("fuzzy"), F.coalesce(same_composite("p", "q"), F.lit(False)).alias("same_layout"))
