"""Composite types in JSON labels (T-8 to T-12, T-17 to T-20, C-6).

Labels are parsed strictly: a field of the wrong kind anywhere makes the whole label no type, so numeric names (as
arrays have) or members without a code do not slip through.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type codes.
ARRAY, POINTER, PADDING, STRUCT, UNION, FUNCTION, MISSING = 2, 3, 5, 6, 7, 9, 10

FIELD = "struct<code:int,n:string,t:string,s:bigint>"
TYPE = f"struct<code:int,n:string,l:array<{FIELD}>,s:bigint,t:string>"


def _kind(v: Column, path: str) -> Column:
    """The kind of a member: `VOID` for an explicit null, SQL null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is(v: Column, path: str, *kinds: str, absent: bool) -> Column:
    kind = _kind(v, path)
    return F.when(kind.isNull(), F.lit(absent)).otherwise(kind.isin(*kinds, *(["VOID"] if absent else [])))


def _code_ok(v: Column) -> Column:
    code = F.try_variant_get(v, "$.T", "bigint")
    return _is(v, "$.T", "BIGINT", absent=False) & F.coalesce(code.between(0, 255), F.lit(False))


def _size_ok(v: Column) -> Column:
    return _is(v, "$.s", "BIGINT", absent=True) & F.coalesce(F.try_variant_get(v, "$.s", "bigint") >= 0, F.lit(True))


def _texts_ok(v: Column) -> Column:
    return _is(v, "$.n", "STRING", absent=True) & _is(v, "$.t", "STRING", absent=True)


def header(label: Column) -> Column:
    """T-8: `struct<T, t>` of any label with a code and, if any, a textual `t`."""
    v = F.try_parse_json(label)
    good = v.isNotNull() & _code_ok(v) & _is(v, "$.t", "STRING", absent=True)
    return F.when(good, F.struct(F.try_variant_get(v, "$.T", "int").alias("code"), F.try_variant_get(v, "$.t", "string").alias("t")))


def parse_type(label: Column) -> Column:
    """T-9: a label as `TYPE`, null where it is none."""
    v = F.try_parse_json(label)
    members = F.try_variant_get(v, "$.l", "array<variant>")
    members_ok = F.when(_kind(v, "$.l").isNull() | (_kind(v, "$.l") == "VOID"), F.lit(True)).otherwise(
        F.coalesce(F.forall(members, lambda m: _code_ok(m) & _texts_ok(m) & _size_ok(m)), F.lit(False))
    )
    good = v.isNotNull() & _code_ok(v) & _texts_ok(v) & _size_ok(v) & members_ok
    field = lambda m: F.struct(F.try_variant_get(m, "$.T", "int").alias("code"), F.try_variant_get(m, "$.n", "string").alias("n"), F.try_variant_get(m, "$.t", "string").alias("t"), F.try_variant_get(m, "$.s", "bigint").alias("s"))
    made = F.struct(F.try_variant_get(v, "$.T", "int").alias("code"), F.try_variant_get(v, "$.n", "string").alias("n"), F.transform(members, field).alias("l"), F.try_variant_get(v, "$.s", "bigint").alias("s"), F.try_variant_get(v, "$.t", "string").alias("t"))
    return F.when(good, made)


def parse_array(label: Column) -> Column:
    """T-10: `struct<n, s>` of an array label: number of elements and size of one."""
    v = F.try_parse_json(label)
    good = v.isNotNull() & _code_ok(v) & _is(v, "$.n", "BIGINT", absent=False) & _is(v, "$.s", "BIGINT", absent=False)
    return F.when(good, F.struct(F.try_variant_get(v, "$.n", "bigint").alias("n"), F.try_variant_get(v, "$.s", "bigint").alias("s")))


def type_name(label: Column, parsed: Column) -> Column:
    """T-11: the name of a type, else the label itself."""
    return F.coalesce(parsed["n"], label)


def function_name(head: Column) -> Column:
    """T-12: the name that a function's label gives."""
    return F.when(head["code"] == FUNCTION, head["t"])


def members_of(parsed: Column) -> Column:
    """The members of a struct or union that are not padding."""
    return F.filter(parsed["l"], lambda m: m["code"] != PADDING)


def member_sizes(parsed: Column, code: int) -> Column:
    """T-17: the sizes of the members of a struct (in order) or union (sorted); null where one has none."""
    members = members_of(parsed)
    sizes = F.transform(members, lambda m: m["s"])
    sizes = F.array_sort(sizes) if code == UNION else sizes
    return F.when((parsed["code"] == code) & ~F.exists(members, lambda m: m["s"].isNull()), sizes)


def offset_widths(parsed: Column) -> Column:
    """T-19: the distinct (offset, width) of a struct's members; padding and nothing advance; null where there is none."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<off:bigint,width:bigint>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        size = F.coalesce(m["s"], F.lit(0))
        item = F.array(F.struct(acc["at"].alias("off"), size.alias("width")))
        out = F.when((m["code"] != PADDING) & (size > 0), F.concat(acc["out"], item)).otherwise(acc["out"])
        return F.struct((acc["at"] + size).cast("bigint").alias("at"), out.alias("out"))

    found = F.array_distinct(F.aggregate(parsed["l"], start, step, lambda acc: acc["out"]))
    return F.when((parsed["code"] == STRUCT) & (F.size(found) > 0), found)


def named_offsets(parsed: Column) -> Column:
    """T-18: offsets of a struct's named, sized members that are no padding (the last of a name counts), null where a named, sized
    member's type starts with `$`."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<n:string,off:bigint>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        named = m["s"].isNotNull() & m["n"].isNotNull() & (m["code"] != PADDING)
        item = F.array(F.struct(m["n"].alias("n"), acc["at"].alias("off")))
        kept = F.filter(acc["out"], lambda x: x["n"] != m["n"])
        return F.struct((acc["at"] + F.coalesce(m["s"], F.lit(0))).cast("bigint").alias("at"), F.when(named, F.concat(kept, item)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parsed["l"], start, step, lambda acc: acc["out"])
    opaque = F.exists(parsed["l"], lambda m: m["s"].isNotNull() & m["n"].isNotNull() & F.coalesce(m["t"].startswith("$"), F.lit(False)))
    return F.when((parsed["code"] == STRUCT) & ~opaque, found)


def signature(parsed: Column) -> Column:
    """T-20: what makes two struct definitions equal whatever their names."""
    return F.when((parsed["code"] == STRUCT) & parsed["l"].isNotNull(), F.struct(parsed["s"].alias("s"), F.transform(parsed["l"], lambda m: F.struct(m["code"].alias("code"), m["t"].alias("t"), m["s"].alias("s"))).alias("l")))
