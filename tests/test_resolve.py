"""Look-up and back-off in one exchange: against windows that are joined by their hash, and what is shuffled for it."""

import random

from ctxvote.functions import windows
from ctxvote.functions.text import SEGMENT
from ctxvote.operators import model, predict, resolve
from ctxvote.plans.queries import QUERIES
from pyspark.sql import functions as F

SCHEMA = "entry_id string, tokens array<string>, labels map<string,map<string,struct<human:boolean,label:string>>>, train boolean"
COLUMNS = ("entry_id", "pos", "var", "kind", "flank", "n", "label", "count")


def _entries(spark):
    """Entries of few words, so that windows of all sizes meet: copies under other names, borders, bare marks, long ones."""
    rnd, rows = random.Random(7), []
    words = ["a", "b", "??", "0x12", "@@@@", "@@x1@@", "@@y22@@", "@@sub_1@@", "@@sub_2@@", "left_", "é", SEGMENT]
    for i in range(60):
        tokens = [rnd.choice(words[: rnd.choice((6, 9, 12))]) for _ in range(rnd.choice((0, 1, 3, 40, 200)))]
        tokens += ["@@"] if i % 9 == 0 else []
        rows.append((f"e{i}", tokens))
        rows.append((f"f{i}", [t.replace("y22", "zz") for t in tokens]))
        rows.append((f"g{i}", ["left_", *tokens[5:30], f"q{i}", *tokens[60:80]]))
    rows += [(f"long{i}", ["a", "@@x1@@", "b", "@@y22@@", "c"] * 500) for i in range(2)]
    names = ["", "x1", "y22", "zz", "sub_1", "sub_2"]
    labels = lambda i: {"type": {n: (rnd.random() < 0.8, f"t{rnd.randrange(9)}") for n in names if rnd.random() < 0.9}}
    return spark.createDataFrame([(e, t, labels(i), i % 4 != 0) for i, (e, t) in enumerate(rows)], SCHEMA)


def test_contexts_are_those_of_joined_windows(spark):
    entries = _entries(spark).cache()
    train, test = entries.where("train"), entries.where("not train")
    vocab = model.build_vocab(train).cache()
    for sizes, k, full in ((windows.SIZES, 5, False), ((5, 1), 2, True)):
        found = predict.matches(windows.context_windows(test, sizes, full_strip=full), model.build_model(train, vocab, sizes=sizes, k=k, full_strip=full))
        want = predict.back_off(found).select(*COLUMNS).collect()
        got = resolve.contexts(resolve.resolved(entries, vocab, sizes=sizes, k=k, full_strip=full), vocab)
        assert want and sorted(map(str, got.select(*COLUMNS).collect())) == sorted(map(str, want))
        votes = [predict.votes(x).select("entry_id", "var", "name", F.round("sum_p", 9).alias("p"), "hits") for x in (got, predict.back_off(found))]
        assert sorted(map(str, votes[0].collect())) == sorted(map(str, votes[1].collect()))


def test_nothing_known_and_nothing_asked(spark):
    entries = _entries(spark)
    vocab = model.build_vocab(entries)
    for kept in (entries.where("train"), entries.where("not train"), entries.limit(0)):
        assert resolve.contexts(resolve.resolved(kept, vocab), vocab).collect() == []


def test_windows_are_not_shuffled_one_by_one(spark, tmp_path):
    """Before, each of ten windows of a target was a row of its own in the shuffle files."""
    rows = [(i, " ".join(f"word{i % 7} considerable{(i * k) % 11} of the {k}" for k in range(150)), "en", "s") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("resolve", "resolve")
    try:
        QUERIES["backoff"](spark, str(tmp_path)).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup("resolve") for s in tracker.getJobInfo(job).stageIds}
    records = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert 0 < records < 60 * 150 * 10 / 2
