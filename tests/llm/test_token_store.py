import random
import zlib

import numpy as np
import pytest

from ctxvote.llm import token_store, tokens
from ctxvote.llm.tokens import Encoder, tokenizer_json


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(3000))
    rows = [(i, rng.choice(["", passage + " ", "x\n"]) + " ".join(word() for _ in range(rng.randint(0, 300)))) for i in range(0, 120, 2)]
    return rows + [(7, None), (9, ""), (9, ""), (9, "a b"), (None, "no id"), (11, "zz" * 40_000), (400, passage), (401, passage)]


def expected(rows, end_id):
    enc = Encoder(tokenizer_json())
    ids = [(i, enc.whole(t or "") + np.asarray([end_id], "<u4").tobytes()) for i, t in rows]
    return ids


def test_round_trip_and_digests(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start long").repartition(3)
    path = str(tmp_path / "store")
    top = token_store.write_store(df, path, end_id=0)
    assert len(top) == 64
    want = expected(rows, 0)
    docs = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert sorted((repr(r.doc_id), bytes(r.ids)) for r in docs) == sorted((repr(i), b) for i, b in want)
    assert [r.doc_id for r in docs] == sorted((i for i, _ in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in docs:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_digests(spark, path, top).collect())
    assert got == [(r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in docs]
    chunks = spark.read.parquet(f"{path}/staged/kind=chunk")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert chunks.agg({"n_ids": "sum"}).first()[0] < 0.6 * at  # the passage is stored once


def test_a_changed_chunk_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "some text here"), (2, "other")], "doc_id long, text string")
    path = str(tmp_path / "store")
    token_store.write_store(df, path)
    at = f"{path}/staged/kind=chunk"
    rows = spark.read.parquet(at).collect()
    broken = [(bytes(r.digest), bytes(r.ids)[::-1], r.width, r.n_ids) for r in rows]
    spark.createDataFrame(broken, "digest binary, ids binary, width int, n_ids int").write.mode("overwrite").parquet(at)
    with pytest.raises(Exception, match="does not fit its digest"):
        token_store.read_digests(spark, path).collect()


def test_a_lost_recipe_is_found(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    path = str(tmp_path / "store")
    top = token_store.write_store(df, path)
    at = f"{path}/recipes"
    rows = spark.read.schema(token_store._RECIPE).parquet(at).orderBy("part", "inside").collect()
    spark.createDataFrame(rows[:-1], token_store._RECIPE).write.mode("overwrite").parquet(at)
    with pytest.raises(Exception, match="do not fit the manifest"):
        token_store.read_digests(spark, path, top).collect()
    renamed = [r if i else type(r)(**(r.asDict() | {"doc_id": 77})) for i, r in enumerate(rows)]
    spark.createDataFrame(renamed, token_store._RECIPE).write.mode("overwrite").parquet(at)
    with pytest.raises(Exception, match="do not fit the manifest"):
        token_store.read_digests(spark, path, top).collect()


def test_folding_gives_the_merkle_root():
    for n in range(40):
        leaves = [bytes([i]) * 32 for i in range(n)]
        state = token_store._Fold()
        for leaf in leaves:
            state.add(leaf)
        assert state.root() == token_store.merkle_root(leaves)


def test_hot_chunks_join_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "HOT_PLACES", 5)
    df = spark.createDataFrame([(i, "the same short text" if i % 2 else f"text {i}") for i in range(60)], "doc_id long, text string")
    path = str(tmp_path / "store")
    top = token_store.write_store(df, path)
    docs = {r.doc_id: zlib.crc32(bytes(r.ids)) for r in token_store.read_documents(spark, path, top).collect()}
    assert {r.doc_id: r.ids_crc32 for r in token_store.read_digests(spark, path, top).collect()} == docs


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_store.read_digests(spark, path).collect() == []


def test_crc_moves():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randint(0, 300)), rng.randbytes(rng.randint(0, 5000))
        moved = token_store.moved_crc(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]
        assert int(moved) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_writing_chunks_gives_up_the_encoders_of_earlier_tasks():
    tokens._ENCODERS[0] = object()
    assert list(token_store._unique(iter([]))) == [] and not tokens._ENCODERS
