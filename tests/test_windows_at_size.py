"""Windows are normalised and hashed from Arrow blocks: against the column functions."""

from ctxvote.functions import windows
from ctxvote.functions.text import KEPT_TOKENS, PREFIXES, normalize_token, normalized
from ctxvote.operators import model
from pyspark.sql import functions as F

ODD = [
    "", "@@", "@@@", "@@@@", "@@a@@", "??", "/*ipc*/", '"', '"x"', '"x', "Stack_1", "puStack_12", "PStack_1", "Stack_1x", "iVar3", "Var", "Var9\n", "s_abc_0badf00d", "PTR_x00000001", "s_00000001", "s__00000001",
    "0x", "0x0", "0x00", "0x12", "0x123", "0xAbC", "x0x12", "0x7fffffffffffffff", "0x8000000000000000", "0x000000000000000000001", "0x12g", "0x1\n", "-1", "+1", "-0", "00", "0", "255", "256", "-9223372036854775808", "-9223372036854775809",
    "9223372036854775807", "9223372036854775808", "00000000000000000000000000012", "+-1", "1_0", "١٢", "é", "😀", "1" * 5000, "int", "void", *KEPT_TOKENS, *PREFIXES, *[p + "12" for p in PREFIXES], "iVar3é", "LABEL_0x12", "K", "0X12", " 12", "12 ",
]


def test_one_token_is_normalised_as_columns_do(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for full in (False, True):
        rows = df.select("t", normalize_token(F.col("t"), full).alias("x")).collect()
        assert [(r.t, r.x) for r in rows] == [(r.t, normalized(r.t, full)) for r in rows]


def test_hashes_are_those_of_the_spans_and_keys_hold_them(spark):
    tokens = [*ODD[:40], *["@@abc@@", "x", "@@sub_1@@", "@@abc@@"] * 300, "/*ipc*/", "@@a@@", "y", "@@a@@"]
    plain = [t for t in tokens if t != "/*ipc*/"] * 2
    df = spark.createDataFrame([(1, tokens), (2, plain), (3, ["@@z@@"]), (4, [])], "entry_id long, tokens array<string>")
    for flanking in (True, False):
        rows = windows.context_windows(df, sizes=(48, 3), flanking=flanking, spans=True)
        fn = F.when(F.col("kind") == "function", "fn").otherwise("var")
        side = F.when(F.col("flank"), "right_").when(~F.col("flank"), "left_").otherwise("")
        got = rows.select("entry_id", "pos", "n", "flank", "hash", windows.span_hash(F.col("span"), F.concat(side, fn)).alias("own")).collect()
        assert got and all(r.hash == r.own for r in got)
        bare = {(r.entry_id, r.pos, r.n, r.flank): r.hash for r in windows.context_windows(df, sizes=(48, 3), flanking=flanking).collect()}
        assert bare == {(r.entry_id, r.pos, r.n, r.flank): r.hash for r in got}
        keyed = windows.context_windows(df, sizes=(48, 3), flanking=flanking, keyed=True)
        own = windows.context_windows(df, sizes=(48, 3), flanking=flanking).select(model.window_key().alias("_key"))
        assert sorted(bytes(r._key) for r in keyed.select("_key").collect()) == sorted(bytes(r._key) for r in own.collect())
