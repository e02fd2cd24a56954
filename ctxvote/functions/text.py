"""Tokens and their normalisation (T-1 to T-4, T-7, T-21, T-22, T-24, T-25, F-9)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A marked token stands for a target: `@@name@@`.
MARK = "@@"
#: Separates segments of a sequence; arrives in tokenised corpora only.
SEGMENT = "/*ipc*/"

#: One token of a listing: a string literal, a two-character operator, a single mark, or anything between those.
TOKEN_PATTERN = r"""(?s)"(?:\\.|[^"\\])*(?:"|\\?\z)|==|>=|<=|!=|&&|\|\||->|<<|>>|::|##|\^=|\|=|%=|&=|\*=|/=|\+=|-=|\+\+|--|[=><!&|\-+:^#%/*(){},;\[\]]|[^\s"=><!&|\-+:^#%/*(){},;\[\]]+"""

#: The prefixes of address-like names, in order.
PREFIXES = ["sub_", "loc_", "unk_", "off_", "asc_", "stru_", "funcs_", "byte_", "word_", "dword_", "qword_", "xmmword_", "ymmword_", "LABEL_", "FUN_", "thunk_FUN_", "LAB_", "joined_r0x", "DAT_", "_DAT_", "code_r0x", "uRam", "switchD_", "switchdataD_", "caseD_"]
#: The tokens that full stripping keeps.
KEPT_TOKENS = ["?", "Number", "String", "L", "__int8", "__int16", "__int32", "__int64", "LODWORD", "const", "_BYTE", "_WORD", "_DWORD", "_QWORD", "char", "float", "double", "__fastcall", "unsigned", "void", "break", "if", "else", "while", "int", "goto", "[", "]", "(", ")", "{", "}", "+", "-", ",", ";", "*", "*=", "<", ">", "=", "<=", ">=", "==", "!=", "++", "--", "+=", "-=", "<<", ">>", "<<=", ">>=", "!", "|", "||", "|=", "&", "&&", "&=", "/", "/=", "^", "^=", "%", "%="]
#: Words that are never recovery targets.
KEYWORDS = ["const", "return", "if", "else", "while", "for", "switch", "case", "break", "continue", "do", "goto", "int", "char", "float", "double", "void", "unsigned", "signed", "short", "long", "struct", "union", "enum", "sizeof"]


def raw_tokens(code: Column) -> Column:
    """T-1 without marks: the tokens of a listing."""
    return F.regexp_extract_all(code, F.lit(TOKEN_PATTERN), F.lit(0))


def marked(token: Column) -> Column:
    return F.concat(F.lit(MARK), token, F.lit(MARK))


def tokenize(code: Column, targets: Column) -> Column:
    """T-1: tokens, those in the array `targets` marked."""
    return F.transform(raw_tokens(code), lambda t: F.when(F.array_contains(targets, t), marked(t)).otherwise(t))


def tokenize_with_functions(code: Column, targets: Column) -> tuple[Column, Column]:
    """T-2: (tokens with targets and `sub_` names marked, targets and those names in order of first appearance)."""
    tokens = raw_tokens(code)
    all_targets = F.array_distinct(F.concat(targets, F.filter(tokens, lambda t: t.startswith("sub_"))))
    return F.transform(tokens, lambda t: F.when(F.array_contains(targets, t) | t.startswith("sub_"), marked(t)).otherwise(t)), all_targets


def is_marked(token: Column) -> Column:
    """Whether a token is a target; `@@` and `@@@` have no name inside and are none."""
    return token.startswith(MARK) & token.endswith(MARK) & (F.octet_length(token) >= 4)


def name_of(token: Column) -> Column:
    """The name inside a marked token."""
    return F.substring(token, F.lit(3), F.length(token) - 4)


def kind_of(name: Column) -> Column:
    """T-7: `function` for names that start with `sub_`, else `variable`."""
    return F.when(name.startswith("sub_"), "function").otherwise("variable")


def normalize_token(token: Column, full_strip: bool = False) -> Column:
    """T-3: names that carry addresses lose them, literals become classes, small numbers a canonical form.

    The prefix rule gives a default that the first matching shape overwrites.  A token that holds a hexadecimal
    literal is settled by it: unless it is one in whole and fits 63 bits, the default stays.
    """
    default = token
    for prefix in reversed(PREFIXES):
        default = F.when(token.startswith(prefix), f"{prefix}XXX").otherwise(default)

    def number(digits: Column) -> Column:
        return F.when(F.length(digits) > 2, F.concat(F.lit("<NUM_"), F.length(digits).cast("string"), F.lit(">"))).when(digits == "", "0x0").otherwise(F.concat(F.lit("0x"), digits))

    hexadecimal = F.lower(F.regexp_extract(token, r"\A0x0*([0-9a-fA-F]*)\z", 1))
    fits = token.rlike(r"\A0x[0-9a-fA-F]+\z") & ((F.length(hexadecimal) < 16) | ((F.length(hexadecimal) == 16) & (hexadecimal < "8")))
    decimal = F.when(token.rlike(r"\A[+-]?[0-9]+\z"), token.try_cast("bigint"))
    negative = F.lower(F.hex(decimal))
    decimal_form = F.when(decimal < 0, F.concat(F.lit("0x"), negative)).otherwise(number(F.when(decimal == 0, "").otherwise(negative)))
    out = (
        F.when(token.startswith('"') & token.endswith('"'), "<STRING>")
        .when(token.rlike(r"\A[a-z]*Stack_[0-9]+\z"), "<ghidra_stack>")
        .when(token.rlike(r"\A[a-z]*Var[0-9]+\z"), "<ghidra_var>")
        .when(token.rlike(r"\A(?:s_|PTR_)[a-zA-Z0-9_]+[a-fA-F0-9]{8}\z"), F.substring(token, F.lit(1), F.length(token) - 8))
        .when(token.rlike(r"0x[0-9a-fA-F]+"), F.when(fits, number(hexadecimal)).otherwise(default))
        .when(decimal.isNotNull(), decimal_form)
        .otherwise(default)
    )
    if full_strip:
        return F.when(out.isin(KEPT_TOKENS), out).otherwise("?")
    return out


def strip_tokens(tokens: Column, full_strip: bool = False) -> Column:
    """T-3 over a sequence (T-4: compute it once, before windows fan out)."""
    return F.transform(tokens, lambda t: normalize_token(t, full_strip))


_STACK, _VAR, _ADDRESS, _HEX, _WHOLE_HEX, _DECIMAL = (re.compile(p) for p in (r"[a-z]*Stack_[0-9]+", r"[a-z]*Var[0-9]+", r"(?:s_|PTR_)[a-zA-Z0-9_]+[a-fA-F0-9]{8}", r"0x[0-9a-fA-F]+", r"0x0*([0-9a-fA-F]*)", r"[+-]?[0-9]+"))
_STRIPPED_FIRST, _KEPT = tuple(PREFIXES), frozenset(KEPT_TOKENS)


def normalized(token: str, full_strip: bool = False) -> str:
    """T-3 for one token in a worker: what `normalize_token` makes of it."""
    out = token
    if token.startswith(_STRIPPED_FIRST):
        out = next(p for p in PREFIXES if token.startswith(p)) + "XXX"
    number = lambda digits: f"<NUM_{len(digits)}>" if len(digits) > 2 else "0x" + (digits or "0")
    if token.startswith('"') and token.endswith('"'):
        out = "<STRING>"
    elif _STACK.fullmatch(token):
        out = "<ghidra_stack>"
    elif _VAR.fullmatch(token):
        out = "<ghidra_var>"
    elif _ADDRESS.fullmatch(token):
        out = token[:-8]
    elif _HEX.search(token):
        if _HEX.fullmatch(token):
            digits = _WHOLE_HEX.fullmatch(token)[1].lower()
            if len(digits) < 16 or (len(digits) == 16 and digits < "8"):
                out = number(digits)
    elif _DECIMAL.fullmatch(token) and len(token.lstrip("+-").lstrip("0")) < 20 and -(2**63) <= (value := int(token)) < 2**63:
        out = f"0x{value + 2**64:x}" if value < 0 else number(f"{value:x}" if value else "")
    return out if not full_strip or out in _KEPT else "?"


def is_candidate(token: Column) -> Column:
    """F-9, T-24: whether an identifier looks like a symbol that a decompiler made up."""
    word = token.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*\z") & ~token.isin(KEYWORDS)
    made_up = token.rlike(r"\Asub_[0-9a-fA-F]+\z") | token.rlike(r"\A(?:var|param|stack)[A-Za-z0-9_]*[0-9][A-Za-z0-9_]*\z")
    return word & (made_up | ((F.contains(token, F.lit("Stack_")) | F.contains(token, F.lit("Var"))) & token.rlike("[0-9]")))


def discover_targets(code: Column) -> Column:
    """F-9: the distinct candidate symbols of a listing, in order of first appearance."""
    return F.array_distinct(F.filter(raw_tokens(code), is_candidate))


def has_generic_name(name: Column) -> Column:
    """T-25."""
    return name.rlike(r"\A(?:var|param|stack)")


def body_tokens(tokens: Column) -> Column:
    """T-21: the tokens strictly between the first `{` and the last `}` without marked functions, null where there is no body."""
    first = F.array_position(tokens, "{")
    last = F.size(tokens) + 1 - F.array_position(F.reverse(tokens), "}")
    body = F.filter(F.slice(tokens, first + 1, F.greatest(last - first - 1, F.lit(0))), lambda t: ~t.startswith("@@sub_"))
    return F.when(F.array_contains(tokens, "{") & F.array_contains(tokens, "}") & (first < last), body)


def body_hash(tokens: Column) -> Column:
    """T-21: a hash of the body's token sequence."""
    return F.sha2(F.array_join(body_tokens(tokens), "\x01"), 256)


def without_space(text: Column) -> Column:
    """T-22: a text without white space, for comparisons that ignore it."""
    return F.regexp_replace(text, r"(?U)\s", "")
