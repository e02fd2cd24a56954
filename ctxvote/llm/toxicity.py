"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Voters.  Lexicons are induced from labelled rows: words and word beginnings that stand out in toxic texts, split by
kind and strength into lists that vote apart.  Rows are dealt to two halves, copies together, and the lists that vote
on a row come from the labels of the other half, never from its own.  Pattern voters look at shouting, exclamation runs
and masked letters.  The annotators' label is one more voter, and an imperfect one.

Label model.  A latent class generates the votes along a tree: within a class, each voter depends on one other, the
pairs being those with the largest mutual information given the class.  Expectation-maximisation estimates the tree, the
tables P(vote | vote of its parent, class) and the prior, starting from the lexicon voters alone; no voter is taken for
the truth (a prior on the annotators' accuracy names the class), and lists that always agree add their evidence once.

Classifier.  A logistic regression over the induced features and patterns is fitted to the posteriors.  It alone
scores texts, whole ones, and needs no label.

The fit uses at most `FIT_ROWS` labelled rows, chosen by a hash of their ids; everything else covers all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import lowered, window_hashes, word_hashes
from ._shared import byte_slices, cut, own_rows, text_runs

#: Labelled rows that a fit uses at most, and induced features it keeps at most.
FIT_ROWS = 12_000
FEATURES = 800
THRESHOLD = 0.7
#: How often the annotators are believed to be right before the votes are seen, and how much that belief counts beside
#: the fitted rows: lists that stay silent on a mildly toxic text must not outvote a label together.
ANNOTATOR, BELIEF_WEIGHT = 0.998, 4.0

#: Lengths in bytes of word beginnings that are features; each is written with a leading star.
_BEGINNINGS = (4, 5, 6, 7)
#: Fixed values of the pattern voters: shares of letters or characters above which they fire.
_SHOUT, _SYMBOLS, _EXCLAIM = 0.5, 0.12, 0.02
_PATTERNS = ("shout", "symbols", "exclaim")
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_MARKS = b"*#$%&@^~"


def training_rows(doc_id: Column) -> Column:
    """Rows whose labels may be learnt: crc32 of the id as text modulo 3 is not 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(True))


def features_of(text: bytes) -> set[bytes]:
    """The distinct words of a text and the beginnings of those that are longer."""
    words = set(lowered(text).split())
    out = set(words)
    for n in _BEGINNINGS:
        out.update(b"*" + w[:n] for w in words if len(w) > n)
    return out


def patterns_of(text: bytes) -> tuple[bool, ...]:
    """Whether each pattern voter fires."""
    n = len(text)
    if n < 20:
        return (False,) * len(_PATTERNS)
    upper, lower = n - len(text.translate(None, _UPPER)), n - len(text.translate(None, _LOWER))
    marks = n - len(text.translate(None, _MARKS))
    return upper > _SHOUT * (upper + lower + 1), marks > _SYMBOLS * n, text.count(b"!") > _EXCLAIM * n


def kin_key(text: bytes) -> int:
    """The smallest hash of three consecutive words: copies and near copies mostly share it."""
    words = word_hashes(lowered(text))[0]
    grams = window_hashes(words, 3)
    return int((grams if len(grams) else words).min().view(np.int64)) if len(words) else 0


@dataclass
class LabelModel:
    """A class prior and, by class, a tree of voters: the tables P(vote | vote of the parent, class)."""

    names: list[str]
    prior: float
    parents: list[int]  # -1 for the root
    tables: np.ndarray  # voters x classes x votes of the parent x votes (-1, 0, 1); a root's rows are equal
    alone: np.ndarray  # voters x classes x votes: the marginals
    information: np.ndarray  # voters x voters: mutual information given the class
    agreement: float = math.nan

    def log_likelihood(self, votes: np.ndarray) -> np.ndarray:
        """log P(votes | class) of rows, for both classes."""
        own, logs = votes + 1, np.log(self.tables)
        out = np.zeros((len(votes), 2))
        for k, parent in enumerate(self.parents):
            out += logs[k][:, own[:, parent] if parent >= 0 else np.zeros(len(votes), int), own[:, k]].T
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of rows."""
        logs = self.log_likelihood(votes)
        z = math.log(self.prior / (1 - self.prior)) + logs[:, 1] - logs[:, 0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def accuracies(self) -> dict[str, float]:
        """How often each voter that does not abstain is right."""
        right = self.prior * self.alone[:, 1, 2] + (1 - self.prior) * self.alone[:, 0, 0]
        speaks = right + self.prior * self.alone[:, 1, 0] + (1 - self.prior) * self.alone[:, 0, 2]
        return dict(zip(self.names, (right / speaks).tolist(), strict=True))


def dependency_tree(information: np.ndarray) -> list[int]:
    """The parents in the tree of the largest total information, from voter 0 on; -1 for the root."""
    n = len(information)
    parents, best, inside = [-1] * n, information[0].copy(), np.zeros(n, bool)
    inside[0] = True
    nearest = np.zeros(n, int)
    for _ in range(n - 1):
        k = int(np.argmax(np.where(inside, -1.0, best)))
        parents[k], inside[k] = int(nearest[k]), True
        closer = information[k] > best
        best, nearest = np.where(closer, information[k], best), np.where(closer, k, nearest)
    return parents


def fit_label_model(names: list[str], votes: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = 25, settled: int = 10, belief: float | None = None) -> LabelModel:
    """Expectation-maximisation from the posteriors `start`; rows count by `weight`.  The tree is chosen anew in the
    first `settled` rounds, and then kept.  With `belief`, voter 0 (the root) is believed beforehand to be right so
    often, with the weight of `BELIEF_WEIGHT` times the rows: it names the latent class; many voters can still outvote it."""
    n, q, parents = len(names), start, []
    one_hot = np.concatenate([votes == v for v in (-1, 0, 1)], axis=1).astype(float).reshape(len(votes), 3, n).transpose(0, 2, 1).reshape(len(votes), 3 * n)
    for r in range(rounds):
        prior = float(np.clip((weight * q).sum() / weight.sum(), 0.005, 0.5))
        pairs = np.stack([(one_hot * (weight * share)[:, None]).T @ one_hot for share in (1 - q, q)]).reshape(2, n, 3, n, 3)
        alone = np.einsum("yjaja->yja", pairs) + 0.5
        alone /= alone.sum(axis=2, keepdims=True)
        if belief is not None:
            alone[:, 0] = (alone[:, 0] + BELIEF_WEIGHT * np.array([[belief, 0, 1 - belief], [1 - belief, 0, belief]])) / (1 + BELIEF_WEIGHT)
        # Joint tables of two voters in a class, drawn towards independence by two rows' weight.
        total = np.array([(weight * (1 - q)).sum(), (weight * q).sum()])[:, None, None, None, None]
        apart = alone[:, :, :, None, None] * alone[:, None, None, :, :]
        joint = (pairs + 2 * apart) / (total + 2)
        shares = np.array([1 - prior, prior])[:, None, None]
        information = (shares * (joint * np.log(joint / apart)).sum(axis=(2, 4))).sum(axis=0)
        if r < settled:
            parents = dependency_tree(information)
        tables = np.empty((n, 2, 3, 3))
        for k, parent in enumerate(parents):
            given = alone[:, k][:, None, :].repeat(3, axis=1) if parent < 0 else joint[:, parent, :, k, :]
            tables[k] = given / given.sum(axis=2, keepdims=True)
        model = LabelModel(names, prior, parents, tables, alone.transpose(1, 0, 2), information)
        q = model.posterior(votes)
    return model


def fit_linear(x: np.ndarray, q: np.ndarray, weight: np.ndarray, l2: float = 0.1, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression of posteriors by accelerated gradient descent; the bias is not shrunk."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    decay = np.append(np.full(x.shape[1] - 1, l2 / weight.sum()), 0).astype(np.float32)
    share = (weight / weight.sum()).astype(np.float32)
    top = np.ones(x.shape[1], np.float32)
    for _ in range(15):  # the largest curvature
        top = x.T @ (share * (x @ top))
        size = float(np.linalg.norm(top))
        top /= size
    rate = 1 / (0.25 * size + float(decay.max()))
    w = look = np.zeros(x.shape[1], np.float32)
    w[-1] = look[-1] = math.log((weight * q).sum() / weight.sum() + 1e-6)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -30, 30)))
        new = look - rate * (x.T @ (share * (p - q).astype(np.float32)) + decay * look)
        look, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


@dataclass
class ToxicityModel:
    """A linear classifier over words, beginnings and patterns."""

    weights: dict[bytes, float] = field(default_factory=dict)
    patterns: tuple[float, ...] = (0.0,) * len(_PATTERNS)
    bias: float = -3.0
    label_model: LabelModel | None = None

    def scorer(self):
        """A function from a text's bytes to its score."""
        words = {w: x for w, x in self.weights.items() if not w.startswith(b"*")}
        heads = {w[1:]: x for w, x in self.weights.items() if w.startswith(b"*")}
        roots = {w[:4] for w in (*words, *heads)}

        def score(text: bytes) -> float:
            z = self.bias
            likely = {w for w in set(lowered(text).split()) if w[:4] in roots}
            if likely:
                z += sum(words[w] for w in likely if w in words)
                for n in _BEGINNINGS:
                    z += sum(heads[h] for h in {w[:n] for w in likely if len(w) > n} if h in heads)
            z += sum(x for x, fires in zip(self.patterns, patterns_of(text), strict=True) if fires)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


_COUNTED = "feature binary, half int, toxic double, other double"


def _count(batches):
    """Weighted document counts of features, by half and label, of a task's rows."""
    sides: dict[tuple[int, int], dict[bytes, float]] = {(h, y): {} for h in (0, 1) for y in (0, 1)}
    for batch in batches:
        for text, label, weight, half in zip(byte_slices(batch.column("text")), *(batch.column(c).to_pylist() for c in ("toxic", "weight", "half")), strict=True):
            side = sides[half, 1 if label else 0]
            for f in features_of(bytes(text)):
                side[f] = side.get(f, 0.0) + weight
    for half in (0, 1):
        other, toxic = sides[half, 0], sides[half, 1]
        found = [*toxic, *(f for f in other if f not in toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([half] * len(found), pa.int32()), pa.array([toxic.get(f, 0.0) for f in found], pa.float64()), pa.array([other.get(f, 0.0) for f in found], pa.float64())], ["feature", "half", "toxic", "other"])


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """`(text, toxic, weight, half)` of the labelled training rows of a fit; copies share the weight of one row and
    stand in the same half."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training_rows(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = own_rows(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def key(batches):
        for batch in text_runs(batches):
            kin = pa.array([kin_key(bytes(t)) for t in byte_slices(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("toxic"), kin], ["doc_id", "text", "toxic", "kin"])

    rows = cut(rows.select("doc_id", "text", "toxic").mapInArrow(key, "doc_id long, text string, toxic int, kin long"))
    sizes = rows.groupBy("kin", "toxic").agg((1 / F.count(F.lit(1))).alias("weight"))
    rows = rows.join(F.broadcast(sizes), ["kin", "toxic"])  # as many rows as the sample at most
    return rows.withColumn("half", F.pmod(F.xxhash64("kin"), F.lit(2)).cast("int"))


def _lexicons(counts: list, toxic: float, other: float, limit: int) -> list[tuple[bytes, float]]:
    """Features that stand out in toxic texts, with their z-scores, the strongest first."""
    found = []
    for f, a, b in counts:
        odds = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (other + 1))
        z = odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if z > 2.2 and a >= 0.5 * (a + b):
            found.append((f, z))
    return sorted(found, key=lambda x: (-x[1], x[0]))[:limit]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FEATURES) -> ToxicityModel:
    """Fit on labelled rows of `docs` whose labels may be learnt.  `labels(doc_id, toxic)`: null labels do not count,
    of several labels of an id the largest does.  Without a toxic and another row, a model that finds nothing toxic.
    Ties among features go to the smaller one; rows without an id are not learnt from; very long texts are read whole."""
    sample = cut(_sample(docs, labels, fit_rows).select("text", "toxic", "weight", "half"))
    sizes = {(r.half, r.toxic): r.w for r in sample.groupBy("half", "toxic").agg(F.sum("weight").alias("w")).collect()}
    totals = {y: sizes.get((0, y), 0.0) + sizes.get((1, y), 0.0) for y in (0, 1)}
    if not totals[1] or not totals[0]:
        return ToxicityModel()
    counted = sample.mapInArrow(_count, _COUNTED).groupBy("feature").agg(*[F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0.0)).alias(f"{c}{h}") for h in (0, 1) for c in ("toxic", "other")])
    counted = counted.withColumns({c: F.col(f"{c}0") + F.col(f"{c}1") for c in ("toxic", "other")})
    bar = (F.col("toxic") >= 2.5) & (F.col("toxic") >= F.col("other"))
    best = counted.where(bar).orderBy(F.desc(F.col("toxic") / F.sqrt(F.col("other") + 1)), "feature").limit(8 * features).collect()
    lexicon = _lexicons([(bytes(r.feature), r.toxic, r.other) for r in best], totals[1], totals[0], features)
    names = [f for f, _ in lexicon]
    # The lists that vote on a half: features that stand out in the other one.
    halves = [_lists(_lexicons([(bytes(r.feature), r[f"toxic{1 - h}"], r[f"other{1 - h}"]) for r in best], sizes.get((1 - h, 1), 0.0), sizes.get((1 - h, 0), 0.0), features)) for h in (0, 1)]
    list_names = sorted({n for own in halves for n in own.values()})
    index = {f: k for k, f in enumerate(names)}

    def describe(batches):
        for batch in text_runs(batches):
            texts = [bytes(t) for t in byte_slices(batch.column("text"))]
            found = [features_of(t) for t in texts]
            hits = [sorted(index[f] for f in own if f in index) for own in found]
            voices = [sorted({list_names.index(lists[f]) for f in own if f in lists}) for own, lists in zip(found, (halves[h] for h in batch.column("half").to_pylist()), strict=True)]
            n_words = [len(lowered(t).split()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), pa.array(voices, pa.list_(pa.int32())), pa.array([list(patterns_of(t)) for t in texts], pa.list_(pa.bool_())), pa.array(n_words, pa.int64()), batch.column("toxic"), batch.column("weight")], ["hits", "voices", "patterns", "n_words", "toxic", "weight"])

    rows = sample.mapInArrow(describe, "hits array<int>, voices array<int>, patterns array<boolean>, n_words long, toxic int, weight double").collect()  # at most fit_rows
    x = np.zeros((len(rows), len(names) + len(_PATTERNS)), np.float32)
    said = np.zeros((len(rows), len(list_names)), bool)
    for i, r in enumerate(rows):
        x[i, r.hits] = 1
        x[i, len(names) :] = r.patterns
        said[i, r.voices] = True
    weight = np.array([r.weight for r in rows])
    label = np.array([r.toxic for r in rows])
    long_enough = np.array([r.n_words for r in rows]) >= 10
    lists = np.where(said, 1, np.where(long_enough[:, None], -1, 0))
    marks = np.where(x[:, len(names) :] > 0, 1, 0)
    votes = np.concatenate([np.where(label == 1, 1, -1)[:, None], lists, marks], axis=1)
    label_model = fit_label_model(["annotator", *list_names, *_PATTERNS], votes, weight, first_guess(lists, label), belief=ANNOTATOR)
    posterior = label_model.posterior(votes)
    label_model.agreement = float((weight * ((posterior >= 0.5) == (label == 1))).sum() / weight.sum())
    w, bias = fit_linear(x, posterior, weight)
    return ToxicityModel(dict(zip(names, w[: len(names)].tolist(), strict=True)), tuple(w[len(names) :].tolist()), bias, label_model)


def _lists(lexicon: list[tuple[bytes, float]]) -> dict[bytes, str]:
    """The list of each feature: by kind, strong or weak, even or odd places."""
    out = {}
    for k, (f, _) in enumerate(lexicon):
        kind = f"begins{len(f) - 1}" if f.startswith(b"*") else "word"
        out[f] = f"{kind}-{'strong' if k < len(lexicon) / 2 else 'weak'}-{'ab'[k % 2]}"
    return out


def first_guess(lists: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Posteriors to start from: the share of the lists that speak for toxicity.  Without any list, the label."""
    if not lists.shape[1] or not (lists > 0).any():
        return np.where(label == 1, 0.9, 0.1)
    share = (lists > 0).sum(axis=1) / np.maximum((lists != 0).sum(axis=1), 1)
    return 0.05 + 0.9 * np.minimum(1.0, 2 * share)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, score)` of every row: the whole text's score from 0 to 1; null and empty texts score by the bias."""
    shared = docs.sparkSession.sparkContext.broadcast(ToxicityModel(model.weights, model.patterns, model.bias))  # FEATURES entries

    def run(batches):
        rate = shared.value.scorer()
        for batch in text_runs(batches):
            scores = pa.array([rate(bytes(t)) for t in byte_slices(batch.column("text"))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    return own_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score below `threshold`, with all their columns."""
    from ._shared import keep_rows

    shared = docs.sparkSession.sparkContext.broadcast(ToxicityModel(model.weights, model.patterns, model.bias))

    def clean(texts: list[bytes]) -> list[bool]:
        rate = shared.value.scorer()
        return [rate(t) < threshold for t in texts]

    return keep_rows(docs, clean, text_col)
