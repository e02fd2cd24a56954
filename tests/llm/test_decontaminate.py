import random
import re

import pytest
from pyspark.sql import functions as F

from ctxvote.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    lengths = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(6)
    word = lambda: rng.choice(["a", "B", "é", "x1", "中", "the"]) * rng.randint(1, 2)
    items = [(i, " ".join(word() for _ in range(rng.randint(0, 25)))) for i in range(12)] + [(12, "one two"), (13, "!!"), (14, None), (None, "Solo"), (15, "one two")]
    docs = []
    for i in range(80):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.3 else " ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(4)]
        docs.append((i, rng.choice([", ", "\n", " "]).join(parts).upper() if i % 9 == 0 else " ".join(parts)))
    return docs + [(5, "one"), (5, "ONE-two"), (None, "solo"), (90, None), (91, ""), (92, "a " * 150_000)], items


@pytest.mark.parametrize("block", [16_000_000, 120])
def test_against_brute_force(spark, monkeypatch, block):
    docs, items = corpus()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, hits int")
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    found = decontaminate.find_contamination(d, b)
    got = [(r.doc_id, r.n_words, r.n, r["items"]) for r in found.withColumn("n", decontaminate.n_hit(F.col("hits"))).collect()]
    want = brute(docs, items)
    assert sorted(got, key=repr) == want
    kept = decontaminate.keep_clean(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not x[2] for x in want)


def test_spans_are_removed(spark):
    d = spark.createDataFrame([(1, "Keep é. One, TWO! and more"), (2, "none")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    rows = decontaminate.remove_spans(decontaminate.find_contamination(d, b)).collect()
    assert {r.doc_id: r.text for r in rows} == {1: "Keep é. ! and more", 2: "none"}
    assert decontaminate.find_contamination(d.limit(0), b.limit(0)).collect() == []
