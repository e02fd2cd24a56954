import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from ctxvote.llm import toxicity


def corpus(n=500):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(3, 8)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(15, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zorgel", "quaxil"]) + rng.choice(["", "en", "ist"])
        docs.append((i, " ".join(words), "x", 1.0))
        labels.append((i, int(toxic)))
    return docs + [(9001, None, "x", 1.0), (9002, "", "x", 1.0), (None, "no id", "x", 1.0), (3, "a second row", "x", 1.0)], labels + [(77777, 1), (8, None), (None, 1)]


def test_held_out_rows_and_filter(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, held_out double")
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = toxicity.score(d, model).withColumn("held", ~toxicity.training_rows(F.col("doc_id"))).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held and r.doc_id is not None and r.doc_id < 500]
    assert len(held) > 100
    assert sum((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert all(r.score < 0.7 for r in rows if r.doc_id in (9001, 9002))
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and kept.count() == sum(r.score < 0.7 for r in rows)


def test_without_labels_nothing_is_toxic(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(d, model).first().score < 0.5
    assert toxicity.score(d.limit(0), model).collect() == []


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    vote = lambda p: np.where(rng.random(4000) < p, np.where(y, 1, -1), np.where(y, -1, 1))
    a, b, c, d = vote(0.95), vote(0.8), vote(0.7), vote(0.75)
    votes = np.stack([a, b, c, c, c, d], axis=1)  # three voters are one
    model = toxicity.fit_label_model(list("abcdef"), votes, np.ones(4000), np.where(b + d > 0, 0.8, 0.2), belief=0.9)
    found = model.accuracies()
    assert abs(found["a"] - 0.95) < 0.05 and abs(found["b"] - 0.8) < 0.08
    assert model.information[2, 3] > 10 * model.information[1, 2]
    assert sum({k, p} <= {2, 3, 4} for k, p in enumerate(model.parents)) == 2  # the three hang together
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.94
    # Voters that repeat another add nothing: the posterior is that of the model without them.
    once = toxicity.fit_label_model(list("abcf"), votes[:, [0, 1, 2, 5]], np.ones(4000), np.where(b + d > 0, 0.8, 0.2), belief=0.9)
    assert np.abs(once.posterior(votes[:, [0, 1, 2, 5]]) - model.posterior(votes)).mean() < 0.01


def test_posterior_is_that_of_the_enumerated_joint():
    rng = np.random.default_rng(7)
    votes = rng.integers(-1, 2, (500, 4))
    votes[:, 2] = np.where(rng.random(500) < 0.7, votes[:, 1], votes[:, 2])
    model = toxicity.fit_label_model(list("abcd"), votes, rng.random(500) + 0.5, rng.random(500), rounds=4)
    every = np.array(list(itertools.product((-1, 0, 1), repeat=4)))
    joint = np.empty((81, 2))
    for i, v in enumerate(every):
        for y in (0, 1):
            p = model.prior if y else 1 - model.prior
            for k, parent in enumerate(model.parents):
                p *= model.tables[k, y, v[parent] + 1 if parent >= 0 else 0, v[k] + 1]
            joint[i, y] = p
    assert abs(joint.sum() - 1) < 1e-9  # a distribution over all votes and both classes
    assert np.allclose(model.posterior(every), joint[:, 1] / joint.sum(axis=1))
    # The tree is the best of all trees.
    edges = list(itertools.combinations(range(4), 2))
    trees = [t for t in itertools.combinations(edges, 3) if len({x for e in t for x in e}) == 4 and not any(len({x for e in s for x in e}) < 3 or len(s) == 3 and len({x for e in s for x in e}) == 3 for s in itertools.combinations(t, 3))]
    best = max(sum(model.information[a, b] for a, b in t) for t in trees)
    own = toxicity.dependency_tree(model.information)
    assert abs(sum(model.information[k, p] for k, p in enumerate(own) if p >= 0) - best) < 1e-12


def test_label_noise_is_outvoted_and_reported(spark):
    docs, labels = corpus(900)
    flipped = [(i, y if i is None or y is None or i % 31 or i > 900 else 1 - y) for i, y in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, held_out double")
    model = toxicity.fit(d, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert 0.9 < model.label_model.agreement < 1.0
    rows = [r for r in toxicity.score(d, model).collect() if r.doc_id is not None and r.doc_id < 900]
    assert sum((r.score >= 0.5) == (r.doc_id % 5 == 0) for r in rows) >= 0.96 * len(rows)


def test_very_long_texts_ties_and_repeated_rows(spark):
    docs, labels = corpus()
    long = "aeiou " * 300_000
    more = [(9100, long, "x", 1.0), (9101, long + "zorgel zorgelen quaxil quaxilist zorgelist", "x", 1.0)]
    d = spark.createDataFrame([*docs, *more, *more, docs[0]], "doc_id long, text string, score string, held_out double")
    model = toxicity.fit(d, spark.createDataFrame([*labels, labels[0], (0, 0)], "doc_id long, toxic int"))
    again = toxicity.fit(d.repartition(7), spark.createDataFrame([*labels, labels[0], (0, 0)], "doc_id long, toxic int").repartition(5))
    assert set(model.weights) == set(again.weights)
    got = {}
    for r in toxicity.score(d, model).collect():
        assert got.setdefault((r.doc_id, r.score)) is None
    scores = dict(got)
    assert {i for i, s in scores if s >= 0.7} >= {9101} and 9100 not in {i for i, s in scores if s >= 0.7}
