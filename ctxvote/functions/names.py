"""Names of functions, addresses and types (T-11 to T-16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sub_address(text: Column) -> Column:
    """T-13: the hexadecimal run after the first `sub_`; null where there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\A.*?sub_([0-9a-fA-F]*)", 1), F.lit(""))


def normalize_name(name: Column) -> Column:
    """T-14: a struct name without pointer marks, qualifiers and the usual affixes, in lower case."""
    out = F.regexp_replace(F.lower(name), r"\A\s+", "")
    for pattern in (r"\A(?:[*&]\s*)+", r"\A(?:(?:const|volatile|mut) \s*)+", r"\A_+", r"\A(?:struct_)+", r"\A(?:struct)+", r"(?:_t)+\z", r"(?:_struct)+\z", r"\A(?:lp)+", r"\Ap+"):
        out = F.regexp_replace(out, pattern, "")
    return out


def names_similar(a: Column, b: Column) -> Column:
    """T-15: equal, equal after normalisation, or one begins with the other and is at most three bytes longer."""
    x, y = normalize_name(a), normalize_name(b)
    near = F.abs(F.octet_length(x) - F.octet_length(y)) <= 3
    return (a == b) | (x == y) | ((x.startswith(y) | y.startswith(x)) & near)


def type_name_candidates(name: Column) -> Column:
    """T-16: the names under which a pointed-to type may be defined, first choice first."""
    trimmed = F.regexp_replace(name, r"\A\s+|\s+\z", "")
    bare = F.regexp_replace(trimmed, r"\A\*+\s*", "")
    plain = F.regexp_replace(bare, r"\A(?:(?:const|mut|volatile) \s*)+", "")
    stem = F.regexp_replace(plain, r"_[0-9]+\z", "")
    return F.array_distinct(F.array(trimmed, bare, plain, stem))
