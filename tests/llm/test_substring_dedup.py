import random

import numpy as np
import pytest

from ctxvote.llm import substring_dedup
from ctxvote.llm.substring_dedup import LENGTH, remove_repeats, suffix_buckets


def brute(rows):
    first = {}
    big = 1 << 62
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - LENGTH + 1):
            s = b[k : k + LENGTH]
            first[s] = min(first.get(s, big), big if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - LENGTH + 1):
            if first[b[k : k + LENGTH]] < (big if i is None else i):
                gone[k : k + LENGTH] = True
        change = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        out.append((i, len(b), list(zip(change[::2].tolist(), change[1::2].tolist())), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["th", "er", "on", "é", "ß", "\x00", "a" * 9, "zz z", "\n"]
    text = lambda n: "".join(rng.choice(words) for _ in range(n))
    passages = [text(rng.randint(10, 60)) for _ in range(6)] + ["a" * 120, "\x00" * 90, "ab" * 70, "x" * 49, "y" * 50]
    rows = []
    for i in range(90):
        parts = [rng.choice(passages) if rng.random() < 0.5 else text(rng.randint(0, 40)) for _ in range(rng.randint(0, 6))]
        t = "".join(parts)
        if rng.random() < 0.3 and rows:
            base = rows[rng.randrange(len(rows))][1] or ""
            k = rng.randint(0, len(base))
            t = base[:k] + rng.choice(["", "#", "é"]) + base[k:]
        rows.append((i, t))
    return rows + [(5, "y" * 50), (5, "y" * 50), (None, passages[0] * 2), (None, passages[0] * 2), (200, None), (201, "")]


@pytest.mark.parametrize("seed,batch", [(1, 2_000_000), (2, 1500), (3, 400)])
def test_against_brute_force(spark, seed, batch):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, batch int, spans string").repartition(3)
    got = [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in remove_repeats(df, batch_bytes=batch).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_long_text_and_empty_table(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    df = spark.createDataFrame([(1, long), (2, "x" + long[1000:300_000] + "y")], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans]) for r in remove_repeats(df).collect()}
    assert got == {1: (400_000, []), 2: (299_002, [(1, 299_001)])}
    assert remove_repeats(df.limit(0)).collect() == []


def test_refined_buckets_are_those_of_whole_strings():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, (40, 84)).astype(np.uint8)
    text[20:] = text[:20]
    text[20:, 40] ^= 1
    for length in (8, 16, 17, 32, 50, 64):
        got = suffix_buckets(text, length)
        strings = {}
        for r in range(40):
            for p in range(84 - length + 1):
                strings.setdefault(bytes(text[r, p : p + length]), set()).add(int(got[r, p]))
        assert all(len(x) == 1 for x in strings.values()) and len(set.union(*strings.values())) == len(strings)


def test_anchors_are_refined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_AT_ONCE", 3)
    rows = corpus(5)
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in remove_repeats(df, batch_bytes=900).collect()]
    assert sorted(got, key=repr) == brute(rows)
