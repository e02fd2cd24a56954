import hashlib

from pyspark.sql import functions as F

from ctxvote import lineage
from ctxvote.functions.windows import context_windows, occurrences
from ctxvote.operators import dataset, model, predict
from ctxvote.plans.adapters import document_entries  # noqa: F401

LABELS = "map<string,map<string,struct<human:boolean,label:string>>>"


def digest(span, disc):
    seen, out = {}, []
    for t in span:
        if t.startswith("@@") and t.endswith("@@") and len(t.encode()) > 4:
            out.append(f"@@var_{seen.setdefault(t, len(seen))}@@")
        else:
            out.append(t)
    return hashlib.sha256(b"\xff".join(t.encode() for t in out) + disc.encode()).hexdigest()[:24]


def test_windows_against_a_model(spark):
    seqs = [["@@a@@", "x", "/*ipc*/", "é", "@@sub_1@@", "@@a@@", "@@@@"], [], ["@@", "y"], [f"t{i}" if i % 7 else f"@@v{i % 3}@@" for i in range(2500)]]
    df = spark.createDataFrame(list(enumerate(seqs)), "entry_id long, tokens array<string>")
    got = {(r.entry_id, r.pos, r.n, r.flank): (r.var, r.kind, r.hash) for r in context_windows(df, sizes=(3, 1)).collect()}
    want = {}
    for e, tokens in enumerate(seqs):
        for pos, t in enumerate(tokens):
            if not (t.startswith("@@") and t.endswith("@@") and len(t) >= 4):
                continue
            kind = "function" if t[2:].startswith("sub_") else "variable"
            short = "fn" if kind == "function" else "var"
            borders = [i for i, x in enumerate(tokens) if x == "/*ipc*/"]
            lo, hi = max([i for i in borders if i < pos], default=-1), min([i for i in borders if i > pos], default=len(tokens))
            at = lambda i: tokens[i] if lo < i < hi else "??"  # noqa: B023, E731
            for n in (3, 1):
                want[e, pos, n, False] = (t[2:-2], kind, digest([at(i) for i in range(pos - n, pos)], f"left_{short}"))
                want[e, pos, n, True] = (t[2:-2], kind, digest([at(i) for i in range(pos + 1, pos + n + 1)], f"right_{short}"))
    assert got == want
    assert {r.entry_id for r in occurrences(df).collect()} == {0, 3}  # a bare mark spoils its entry


def entry(i, tokens, label="L", human=True):
    names = {t[2:-2] for t in tokens if t.startswith("@@")}
    return (i, tokens, {"type": {n: (human, label) for n in names}})


def test_train_back_off_and_score(spark):
    train = [entry(1, ["p", "q", "@@a@@", "r"], "A"), entry(2, ["p", "q", "@@b@@", "r"], "A"), entry(3, ["z", "q", "@@c@@", "r"], "B"), entry(4, ["p", "q", "@@d@@", "s"], "C", human=False)]
    test = [entry(9, ["p", "q", "@@x@@", "r"], "A"), entry(10, ["n", "q", "@@x@@", "m"], "B"), entry(11, ["n", "n", "@@x@@", "n"], "B")]
    schema = f"entry_id long, tokens array<string>, labels {LABELS}"
    train, test = spark.createDataFrame(train, schema), spark.createDataFrame(test, schema)
    vocab = model.build_vocab(train)
    assert {(r.kind, r.id, r.label, r["count"]) for r in vocab.collect()} == {("variable", 0, "A", 2), ("variable", 1, "B", 1)}
    counts = model.build_model(train, vocab, sizes=(2, 1))
    assert {tuple(r) for r in model.flat(model.nested(counts)).collect()} == {tuple(r) for r in counts.select("n", "hash", "kind", "rank", "vocab_id", "label", "count", "total").collect()}
    got = {(r.entry_id, r["rank"]): (r.pred, round(r.score, 6)) for r in predict.predict(test, counts, sizes=(2, 1), primitives=True).collect()}
    # 9: left pair "p q" says A twice; right "r ??" says A twice, B once.
    assert got[9, 1] == ("A", round((1 + 2 / 3) / 2, 6)) and got[9, 2] == ("B", round(1 / 3, 6))
    # 10: only the left single "q" is known: A twice, B once.
    assert got[10, 1] == ("A", round(2 / 3, 6)) and (11, 1) not in got


def test_threshold_filters_and_sorts(spark):
    rows = [("var2", 1, "X", 0.61), ("var2", 2, "Y", 0.58), ("param1", 1, "X", 0.9), ("stack3", 1, "Z", 0.4)]
    ranked = spark.createDataFrame([(1, v, "variable", r, p, s) for v, r, p, s in rows], "entry_id long, var string, kind string, rank int, pred string, score double")
    kept = ranked.where("score >= 0.6").groupBy("var").agg(F.max("score").alias("best"), F.count("*").alias("n")).orderBy(F.desc("best"), "var").collect()
    assert [(r["var"], r.n) for r in kept] == [("param1", 1), ("var2", 1)]


def test_one_primitive(spark):
    labels = ["int", '{"T": 6, "n": "a"}', "long", '{"T": 3, "t": "b"}']
    ranked = spark.createDataFrame([(1, "v", k, i + 1, p, 0.5) for k in ("variable", "function") for i, p in enumerate(labels)], "entry_id long, var string, kind string, rank int, pred string, score double")
    got = predict.one_primitive(ranked).orderBy("kind", "rank").collect()
    assert [r.pred for r in got if r.kind == "variable"] == [labels[0], labels[1], labels[3]]
    assert [r.pred for r in got if r.kind == "function"] == labels


def test_split_is_exact_and_stable(spark):
    df = spark.range(101).withColumnRenamed("id", "entry_id")
    a = {r.entry_id for r in dataset.split_exact(df).where("train").collect()}
    b = {r.entry_id for r in dataset.split_exact(df.repartition(7)).where("train").collect()}
    assert len(a) == 80 and a == b


def test_majority_prefers_the_longer_of_tied_namesakes(spark):
    head = "x" * 45
    votes = spark.createDataFrame([("g", "a", head + "1", 2), ("g", "a", head + "22", 2), ("g", "b", "m", 1), ("g", "b", "k", 1)], "group_key string, var string, label string, n_votes long")
    assert {(r["var"], r.label) for r in dataset.majority(votes).collect()} == {("a", head + "22"), ("b", "k")}


def exchanged(df):
    """How many shuffles by a key a plan has, and the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan


def test_split_shuffles_no_rows_and_cuts_within_equal_keys(spark):
    df = spark.range(101).select(F.col("id").alias("entry_id"), F.array(F.lit("a")).alias("tokens"))
    assert exchanged(dataset.split_exact(df))[0] == 0
    hashed = sorted((hashlib.md5(f"{i}:42".encode()).hexdigest(), i) for i in range(101))
    assert {r.entry_id for r in dataset.split_exact(df).where("train").collect()} == {i for _, i in hashed[:80]}
    for rows in ([7] * 9, [1] * 3 + [2] * 4 + [3] * 3, [], [5]):
        twins = spark.createDataFrame([(i,) for i in rows], "entry_id long")
        got = [r.train for r in dataset.split_exact(twins).collect()]
        assert len(got) == len(rows) and sum(got) == int(0.8 * len(rows))


def test_vocabulary_shuffles_labels_only(spark):
    df = spark.createDataFrame([entry(1, ["@@a@@", "x", "@@a@@", "@@sub_b@@"], "L"), entry(2, ["@@a@@"], "M"), entry(3, ["@@@", "@@a@@"], "M")], f"entry_id long, tokens array<string>, labels {LABELS}")
    vocab = model.build_vocab(df)
    assert {(r.kind, r.label, r["count"]) for r in vocab.collect()} == {("variable", "L", 2), ("variable", "M", 1), ("function", "L", 1)}
    assert "map_sort" not in exchanged(vocab)[1].lower() and "mapsort" not in exchanged(vocab)[1].lower()


def test_contexts_are_counted_once_a_place(spark):
    df = spark.createDataFrame([(1, ["@@a@@", "x", "@@a@@"], None)], f"entry_id long, tokens array<string>, labels {LABELS}")
    counted = predict.context_counts(context_windows(df, sizes=(4, 2)))
    assert [tuple(r) for r in counted.collect()] == [(1, "a", 4)]
    assert "hashpartitioning(entry_id" in exchanged(counted)[1] and ", pos#" not in exchanged(counted)[1].split("Exchange hashpartitioning")[-1].split("\n")[0]


def test_windows_are_shuffled_once_as_keys(spark):
    rows = [entry(i, ["p", "q", f"@@{v}@@", "r", "@@sub_x@@"], label) for i, (v, label) in enumerate([("a", "A"), ("b", "A"), ("c", "B"), ("d", "C")])]
    df = spark.createDataFrame(rows, f"entry_id long, tokens array<string>, labels {LABELS}")
    vocab = model.build_vocab(df).localCheckpoint()
    made = model.build_model(df, vocab, sizes=(4, 2), k=2)
    plan = exchanged(made)[1]
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(_key") == 1
    old = model.top_labels(model.window_counts(model.labelled_windows(df, sizes=(4, 2))), vocab, 2)
    columns = ["n", "hash", "kind", "rank", "vocab_id", "label", "count", "total"]
    assert {tuple(r) for r in made.select(columns).collect()} == {tuple(r) for r in old.select(columns).collect()}


def test_stored_tables_leave_their_rows_and_the_settings_alone(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    kept = lineage.stored(spark.range(100).repartition("id").groupBy((F.col("id") % 7).alias("k")).count())
    assert sum(r["count"] for r in kept.collect()) == 100 and spark.conf.get(name) == before
