import random
import re

import pytest
from pyspark.sql import functions as F

from ctxvote.functions import names, text

TWO = {"==", ">=", "<=", "!=", "&&", "||", "->", "<<", ">>", "::", "##", "^=", "|=", "%=", "&=", "*=", "/=", "+=", "-=", "++", "--"}
ONE = set("=><!&|-+:^#%/*(){},;[]")


def model_tokens(code):
    out, pending, i = [], "", 0

    def flush():
        nonlocal pending
        if pending:
            out.append(pending)
        pending = ""

    while i < len(code):
        c = code[i]
        if c == '"':
            flush()
            j = i + 1
            while j < len(code) and code[j] != '"':
                j += 2 if code[j] == "\\" else 1
            out.append(code[i : j + 1])
            i = j + 1
        elif c.isspace():
            flush()
            i += 1
        elif code[i : i + 2] in TWO:
            flush()
            out.append(code[i : i + 2])
            i += 2
        elif c in ONE:
            flush()
            out.append(c)
            i += 1
        else:
            pending += c
            i += 1
    flush()
    return out


def test_tokenizer_against_a_state_machine(spark):
    rng = random.Random(7)
    parts = ["a", "x1", " ", "\n", '"', "\\", "=", "<", ">", "*", "+", "-", "&", "|", "(", "]", ".", "?", "sub_1", "0x1F", "/", ":", "#"]
    codes = ["", '"open', '"a\\"b" c', "a<<=b", "x->y*=2"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(codes)), "i int, code string")
    got = {r.i: r.t for r in df.select("i", text.raw_tokens(F.col("code")).alias("t")).collect()}
    for i, code in enumerate(codes):
        assert got[i] == model_tokens(code), code


def test_targets_are_marked(spark):
    df = spark.createDataFrame([("int sub_401000(param1) { var2 = sub_401100(iVar3); return var2; }",)], "code string")
    tokens, targets = text.tokenize_with_functions(F.col("code"), F.array(F.lit("param1"), F.lit("var2")))
    row = df.select(tokens.alias("t"), targets.alias("v")).first()
    assert row.t[:5] == ["int", "@@sub_401000@@", "(", "@@param1@@", ")"]
    assert row.v == ["param1", "var2", "sub_401000", "sub_401100"]


def test_common_symbols_are_discovered(spark):
    code = "int sub_401000(int param1) {\n  int var2 = sub_401100(param1);\n  int iVar3 = var2 + 1;\n  return iVar3;\n}"
    found = spark.createDataFrame([(code,)], "code string").select(text.discover_targets(F.col("code")).alias("t")).first().t
    assert {"sub_401000", "sub_401100", "param1", "var2", "iVar3"} <= set(found) and "return" not in found


@pytest.mark.parametrize(
    "token,expected",
    [
        ("sub_41", "sub_XXX"), ("thunk_FUN_9", "thunk_FUN_XXX"), ('"s"', "<STRING>"), ('"', "<STRING>"), ("auStack_12", "<ghidra_stack>"), ("iVar3", "<ghidra_var>"), ("s_abc_0012ABCD", "s_abc_"), ("PTR_x_0012abcd", "PTR_x_"),
        ("0x10", "0x10"), ("0x100", "<NUM_3>"), ("0x000", "0x0"), ("0x00FF", "0xff"), ("0x7fffffffffffffff", "<NUM_16>"), ("0x8000000000000000", "0x8000000000000000"), ("LAB_0x12", "LAB_XXX"), ("255", "0xff"), ("256", "<NUM_3>"), ("-1", "0xffffffffffffffff"),
        ("+7", "0x7"), ("99999999999999999999", "99999999999999999999"), ("@@a0x1@@", "@@a0x1@@"), ("x", "x"), ("-0", "0x0"),
    ],
)
def test_normalisation_cases(spark, token, expected):
    row = spark.createDataFrame([(token,)], "t string").select(text.normalize_token(F.col("t")).alias("n"), text.normalize_token(F.col("t"), True).alias("f")).first()
    assert row.n == expected
    assert row.f == (expected if expected in text.KEPT_TOKENS else "?")


def test_names(spark):
    rows = [("struct_foo_t", "foo"), ("  *& const bar_struct", "bar"), ("LPSTR", "str"), ("ppthing", "thing"), ("__node", "node")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("b", names.normalize_name(F.col("a")).alias("n"), names.names_similar(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.n == r.b and r.s
    got = spark.createDataFrame([("call sub_1fz", "* const mut node_12 ")], "x string, y string").select(names.sub_address(F.col("x")).alias("a"), names.type_name_candidates(F.col("y")).alias("c")).first()
    assert got.a == "1f" and got.c == ["* const mut node_12", "const mut node_12", "node_12", "node"]


def test_body(spark):
    df = spark.createDataFrame([(["f", "{", "a", "@@sub_1@@", "}", "b", "}"],), (["a"],), (["}", "{"],)], "t array<string>")
    assert [r.b for r in df.select(text.body_tokens(F.col("t")).alias("b")).collect()] == [["a", "}", "b"], None, None]
