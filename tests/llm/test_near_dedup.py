import random
import re

import numpy as np
import pytest

import ctxvote.llm.near_dedup as near_dedup_module
from ctxvote.llm.near_dedup import dart_minhash, near_dedup
from ctxvote.llm.components import components


def sets(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def brute(rows, similarity=0.8):
    shingled = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(shingled):
        for j in range(i):
            b = shingled[j]
            if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    key = lambda x: (x is None, x or 0)
    return sorted(((rows[i][0], min(groups[find(i)], key=key), len(groups[find(i)])) for i in range(len(rows))), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 5)))
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.randint(3, 200))]
        rows.append((3 * i, " ".join(base)))
        for j in range(rng.randint(0, 4)):  # a chain of small edits
            for _ in range(rng.randint(0, 4)):
                base[rng.randrange(len(base))] = word()
            rows.append((3000 + 10 * i + j, " ".join(base).upper() if j == 1 else ", ".join(base)))
    return rows + [(None, "a b c d e f"), (1, ""), (2, None), (4, "!!"), (7, "one"), (8, "One!"), (8, "One!"), (9, "two words")]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, root int")
    got = near_dedup(df).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=repr) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == sum(1 / r.class_size for r in got) and all(r.doc_id == r.class_id for r in kept)


def test_pairs_in_a_large_family_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near_dedup_module, "BLOCK", 100, raising=False)  # buckets of up to 187 members: several cells
    rng = random.Random(11)
    pool = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(40)]
    rows = []
    for i in range(400):  # all of one pool of passages, most of them below the threshold to each other
        chosen = set(rng.sample(range(40), 34))
        rows.append((2 * i, " ".join(pool[k] for k in sorted(chosen))))
        if i < 150:  # one passage for another: above it
            chosen ^= {rng.choice(sorted(chosen)), rng.choice(sorted(set(range(40)) - chosen))}
            rows.append((2 * i + 1, " ".join(pool[k] for k in sorted(chosen))))
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=repr) == brute(rows)


def satellites(seed, families=4, members=60, each=15):
    """Families of near copies, and satellites of theirs that are similar enough to one member alone."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    rows = []
    for f in range(families):
        base = [word() for _ in range(220)]
        near = []
        for _ in range(members):
            w = list(base)
            at = rng.randrange(200)
            w[at : at + 8] = [word() for _ in range(8)]
            near.append(w)
        for m in rng.sample(range(members), each):
            w = list(near[m])
            at = rng.randrange(170)
            w[at : at + 18] = [word() for _ in range(18)]
            near.append(w)
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate(near)]
    return [(i, t) for i, (_, t) in enumerate(rows)]


def test_satellites_of_large_families_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(near_dedup_module, "SALT", 7)  # a pivot's partners in several parts
    rows = satellites(21)
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=repr) == brute(rows)


def test_counts_as_weights(spark):
    rows = [(1, "a b c d e " * 40), (2, "a b c d e " * 41), (3, "a b c d e " * 80), (4, "x " + "a b c d e " * 39)]
    got = {r.doc_id: r.class_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), weights="counts").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_very_long_texts_and_repeated_rows(spark):
    long = " ".join(f"w{i % 50_021}" for i in range(120_000))
    rows = [(5, long), (6, long + " more words at its end"), (5, long), (7, long[: len(long) // 2]), (8, "")]
    got = near_dedup(spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, packed string")).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got) == brute(rows)
    assert sum(r.kept for r in got) == len({r.class_id for r in got})


def test_components_after_more_links(spark):
    from ctxvote.llm.components import joined_components

    frame = lambda x: spark.createDataFrame(x, "u long, v long")
    first = [(1, 2), (2, 3), (10, 11), (20, 21)]
    more = [(3, 11), (11, 30), (40, 41), (21, 20)]
    got = {r.node: r.root for r in joined_components(components(frame(first)), frame(more)).collect()}
    assert got == {r.node: r.root for r in components(frame(first + more)).collect()}


def test_empty_table(spark):
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    names = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    a, b = rng.integers(0, 6, 400).astype(float), rng.integers(0, 6, 400).astype(float)
    b[:250] = a[:250]
    elements = np.concatenate([names[a > 0], names[b > 0]])
    weights = np.concatenate([a[a > 0], b[b > 0]])
    doc = np.concatenate([np.zeros((a > 0).sum(), np.int64), np.ones((b > 0).sum(), np.int64)])
    s = dart_minhash(elements, weights, doc, 2, 2000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 0.04


def test_signature_does_not_depend_on_the_company():
    names = np.arange(1, 4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    alone = dart_minhash(names[:1], np.ones(1), np.zeros(1, np.int64), 1, 168)
    both = dart_minhash(names[[0, 1, 2]], np.ones(3), np.array([0, 1, 1]), 3, 168)
    assert (alone[0] == both[0]).all() and (both[2] == 0).all() and (both[1] != 0).all()


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
