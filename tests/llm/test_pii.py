import hashlib
import re

from ctxvote.llm.pii import find_pii, redact, written
from ctxvote.llm.queries import op6_pii
from pyspark.sql import functions as F

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    text, found = text or "", []
    for order, (kind, rx) in enumerate([("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)]):
        for m in rx.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


TEXTS = [
    None, "", "none here", "a@b.c%d@e.f.g", "x.y+z@mail1.example.com, 1.2.3.4.5.6.7.8", "999.1.1.1 0001.02.003.4 256.1.1.1",
    "😀é 4574119703904108 and 4574-1197-0390 4108 45741197039041081", "+1 (918) 555-4181. +44 20 7946 0958 +1 2", "a@@b.c @x.y a@b a@b.",
    "1" * 3000 + " " + "a" * 3000 + "@", "é@b.co über.a@b.c", "12-34 5678 9012 3456 7 8 9", "+1" * 50, "a@b.c " * 700 + "1.2.3.4 " * 130,
    "1.1.1.1" + ".1" * 40, "10.0.0.1:4574119703904108+1 (918) 555-4181@x.com",
]


def test_base_spans_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id int, text string, spans string")
    rows = find_pii(df).select("doc_id", written(F.filter("spans", lambda s: s["ord"] < 4)).alias("w")).collect()
    got = {r.doc_id: r.w for r in rows}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(t), (i, t and t[:80])


def test_checksums_and_context_decide_the_other_kinds(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00 here", "IBAN DE88 3704 0044 0532 0130 00", "SSN 123-45-6789", "no 123-45-6789", "call (212) 555-0199 now", "x 212 555 0199"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r.w for r in find_pii(df).select("doc_id", written(F.col("spans")).alias("w")).orderBy("doc_id").collect()]
    assert got == ["iban:5:32", "", "ssn:4:15", "", "phone_local:5:19", ""]


def test_redact_and_empty_table(spark):
    df = spark.createDataFrame([(1, "to a@b.c, 1.2.3.4 end"), (2, None)], "doc_id int, text string")
    out = df.join(find_pii(df), "doc_id").select("doc_id", redact(F.coalesce("text", F.lit("")), F.col("spans")).alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in out] == ["to [email], [ip] end", ""]
    assert find_pii(df.limit(0)).collect() == []


def test_query_counts_each_base_kind(spark, tmp_path):
    texts = [*TEXTS, "1.2.3.4 5.6.7.8 9.10.11.12", "a@b.c and 4574119703904108", "+1 (918) 555-4181 ssn 123-45-6789"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op6_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        kinds = [x.split(":")[0] for x in want.split(",")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in ("email", "ip", "card", "phone")], r
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), r
