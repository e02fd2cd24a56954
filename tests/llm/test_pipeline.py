import random

from pyspark.sql import functions as F

import corpus_pipeline
from ctxvote.llm import toxicity
from ctxvote.llm.tokens import Encoder, tokenizer_json
from test_decontaminate import brute as leak_brute
from test_near_dedup import brute as near_brute


def build(spark, folder):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(rng.randint(3, 8)))
    text = lambda n=60: [word() for _ in range(n)]
    rows, labels, bench = [], [], text(30)
    for i in range(200):
        w = text()
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(60)] = "zorgel" + rng.choice(["", "en"])
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        rows.append((i, " ".join(w)))
    near = rows[1][1].split()
    near[0] = "changed"
    leak = text(40) + bench[5:20] + text(10)
    rows += [(300, rows[1][1]), (301, " ".join(near)), (302, " ".join(leak)), (303, None), (304, ""), (305, rows[2][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(bench))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    docs = build(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    clean = {i for i in range(200) if i % 4}
    # 1 and 300 are copies (the larger id stays), 301 is near them (the smallest id of the class stays); 2 and 305 are copies.
    want = (clean - {1, 2}) | {300, 305, 304}
    assert got >= want - {303, 304} and not got & {1, 2, 301, 302} and not got & {i for i in range(0, 200, 4)}
    assert len(got & {303, 304}) == 1
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    docs = build(spark, str(tmp_path))
    twice = docs.where("doc_id in (5, 6)").union(docs.where("doc_id = 5"))
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        assert sorted(r.doc_id for r in stage(spark, twice, str(tmp_path)).collect()) == [5, 6]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_clashing_columns_are_carried_as_they_are(spark, tmp_path):
    docs = build(spark, str(tmp_path))
    names = ["_id", "_NONE", "_key", "__id", "text_key", "kept", "run", "digest", "score", "row"]
    wide = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names]).where("doc_id < 40 or doc_id >= 300")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide_out = stage(spark, wide, str(tmp_path))
        assert wide_out.columns == wide.columns
        for r in wide_out.collect():
            assert all(r[n] == f"{n}-{r.doc_id}" for n in names)


def test_very_long_texts_pass_whole(spark, tmp_path):
    docs = build(spark, str(tmp_path))
    long = " ".join(f"w{i}" for i in range(200_000))
    few = docs.where("doc_id in (1, 2)").union(spark.createDataFrame([(900, long, "en", "s", len(long)), (901, long + " end", "en", "s", len(long) + 4)], docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        few = stage(spark, few, str(tmp_path))
    assert {r.doc_id for r in few.collect()} == {1, 2, 900}  # 901 is near 900
    pieces = corpus_pipeline.pack(spark, few, str(tmp_path)).collect()
    for doc_id in (1, 2, 900):
        own = sorted((r.start, r.length) for r in pieces if r.doc_id == doc_id)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert own[-1][0] + own[-1][1] == next(r.doc_tokens for r in pieces if r.doc_id == doc_id)


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on what the one before it kept, against plain Python."""
    docs = build(spark, str(tmp_path))
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    scores = {(r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    before = {(r.doc_id, r.text) for r in docs.collect()}
    got = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, str(tmp_path))
        kept = {(r.doc_id, r.text) for r in got.collect()}
        if name == "toxicity":
            want = {(i, t) for i, t in before if (i, max(s for j, s in scores if j == i)) in {x for x in scores if x[1] < toxicity.THRESHOLD}}
        elif name == "exact_dedup":
            want = {(i, t) for i, t in before if i == max(j for j, u in before if (u or "") == (t or ""))}
        elif name == "near_dedup":
            want = {(i, t) for i, t in before if i in {c for _, c, _ in near_brute(sorted(before, key=lambda r: r[0]))}}
        else:
            want = {(i, t) for i, t in before if i in {d for d, _, hit, _ in leak_brute(sorted(before, key=lambda r: r[0]), benchmark) if not hit}}
        assert kept == want, name
        before = kept
    enc = Encoder(tokenizer_json())
    pieces = sorted((r.doc_id, r.start, bytes(r.ids)) for r in corpus_pipeline.pack(spark, got, str(tmp_path)).collect())
    for doc_id, text in before:
        ids = enc.whole(text or "") + (1).to_bytes(4, "little")
        assert b"".join(x for i, _, x in pieces if i == doc_id) == ids
