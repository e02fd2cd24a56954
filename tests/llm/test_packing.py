import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ctxvote.llm.packing import best_fill, pack, plan
from ctxvote.llm.tokens import Encoder, tokenizer_json


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_best_fill_is_optimal(counts, capacity):
    used = best_fill(counts, capacity)
    assert all(0 < used[k] <= counts[k] for k in used)
    sums = {0}
    for k, n in counts.items():
        sums = {s + i * k for s in sums for i in range(n + 1)}
    assert sum(k * v for k, v in used.items()) == max(s for s in sums if s <= capacity)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 40), max_size=40))
def test_plan_places_every_id_once(histogram):
    window, spots, items = 64, defaultdict(list), defaultdict(list)
    for left_over, lo, hi, at, length, phase, per, first, offset in plan(histogram, window):
        for r in range(lo, hi):
            k = phase + r - lo
            spots[first + k // per].append((offset + k % per * length, length))
            items[left_over, r].append((at, length))
    assert set(items) == {(x, r) for x, n in histogram.items() for r in range(n)}
    for (left_over, _), pieces in items.items():
        at = 0
        for a, length in sorted(pieces):
            assert a == at
            at += length
        assert at == left_over
    short = 0
    for places in spots.values():
        at = 0
        for a, length in sorted(places):
            assert a == at
            at += length
        assert at <= window
        short += at < window
    assert short <= 1 and sorted(spots) == list(range(len(spots)))


def test_pack_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(3, "repeated id"), (3, "repeated id"), (None, "none"), (500, None), (501, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row long").repartition(3)
    got = pack(df, window=32, end_id=1).collect()
    enc = Encoder(tokenizer_json())
    want = sorted(np.append(np.frombuffer(enc.whole(t or ""), "<u4"), 1).astype("<u4").tobytes() for _, t in rows)
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for places in sequences.values():
        at = 0
        for a, length in sorted(places):
            assert a == at
            at += length
        assert at <= 32
    assert sum(sum(x for _, x in p) < 32 for p in sequences.values()) <= 1
    texts = []
    for doc_id, pieces in docs.items():
        if doc_id == 3:
            continue
        pieces.sort(key=lambda r: r.start)
        texts.append(b"".join(bytes(r.ids) for r in pieces))
        assert len(texts[-1]) == 4 * pieces[0].doc_tokens
    assert all(t in want for t in texts) and sum(map(len, want)) == 4 * sum(r.length for r in got)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
