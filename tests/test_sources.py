import gzip
import io
import json
import lzma
import tarfile

import pytest
from pyspark.sql import functions as F

from ctxvote import cli
from ctxvote.sources import archive, corpus
from ctxvote.streaming.counter import stream_counts

MEMBER = gzip.compress(b"abc\nd\n", mtime=0)
LINE = {"tokens": ["void", "@@sub_1@@", "(", "@@p1@@", ")", "{", "@@p1@@", "=", "0x10", "}"], "labels": {"type": {"p1": {"human": True, "label": "ptr<void>"}, "sub_1": {"human": True, "label": "fn"}}}}


def write_corpus(folder, n=6):
    folder.mkdir()
    for f in range(2):
        lines = []
        for i in range(n):
            line = json.loads(json.dumps(LINE))
            line["tokens"][0] = f"t{i % 3}"
            line["meta"] = {"i": str(i)}
            lines.append(json.dumps(line))
        (folder / f"part{f}.jsonl").write_text("\n".join([*lines, "{broken", ""]))


def test_corpus_reads_and_rejects(spark, tmp_path):
    write_corpus(tmp_path / "c")
    entries = corpus.read_entries(spark, str(tmp_path / "c"))
    assert entries.count() == 12 == entries.select("entry_id").distinct().count()
    assert corpus.count_entries(spark, str(tmp_path / "c")) == 14
    with pytest.raises(Exception, match="malformed corpus line"):
        corpus.read_entries(spark, str(tmp_path / "c"), strict=True).collect()


def test_vocabularies(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"entries": ["a", "b"], "counts": [3, 1], "map": {"a": 0, "b": 1}}))
    (tmp_path / "v.tsv").write_text("a\t3\nb\t1\n")
    (tmp_path / "bad.tsv").write_text("a\t3\nb\n")
    rows = [tuple(r) for r in corpus.read_vocab_json(spark, str(tmp_path / "v.json")).collect()]
    assert rows == [("variable", 0, "a", 3), ("variable", 1, "b", 1)] == [tuple(r) for r in corpus.read_vocab_tsv(spark, str(tmp_path / "v.tsv")).collect()]
    with pytest.raises(Exception, match="no count"):
        corpus.read_vocab_tsv(spark, str(tmp_path / "bad.tsv")).collect()
    vocab = corpus.read_vocab_json(spark, str(tmp_path / "v.json"))
    corpus.write_vocab_json(vocab, "variable", str(tmp_path / "out"))
    assert corpus.read_vocab_json(spark, str(tmp_path / "out")).collect() == vocab.collect()
    assert corpus.function_path("x/a.vocab") == "x/a.fn.vocab" and corpus.function_path("a") == "a.fn"


def test_command_line_end_to_end(spark, tmp_path, capsys):
    write_corpus(tmp_path / "raw")
    for f in (tmp_path / "raw").glob("*.jsonl"):
        f.write_text("\n".join(x for x in f.read_text().split("\n") if x != "{broken"))
    run = lambda *a: cli.main([str(x) for x in a], spark)
    run("create-dataset", "-i", tmp_path / "raw", "-o", tmp_path / "set")
    run("build-vocab", tmp_path / "raw", tmp_path / "vocab")
    run("build-all-dbs", tmp_path / "raw", tmp_path / "vocab", "-o", tmp_path / "model", "-f")
    run("evaluate", tmp_path / "raw", tmp_path / "vocab", tmp_path / "out", "-d", tmp_path / "model", "-f", "--threshold-sweep", "--aggregate-funcs", "--consider-train", tmp_path / "raw")
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines and all(x["pred"] == x["label"] for x in lines) and {x["var"] for x in lines} == {"p1", "sub_1"}
    with pytest.raises(corpus.CorpusError):
        run("evaluate", tmp_path / "raw", tmp_path / "vocab", tmp_path / "out2", "-d", tmp_path / "model")
    (tmp_path / "code.txt").write_text("t0 sub_1(param1){param1=0x10}")
    run("recover", tmp_path / "code.txt", "-d", tmp_path / "model", "-f")
    assert "param1" in capsys.readouterr().out
    run("recover", tmp_path / "code.txt", "-d", tmp_path / "model", "-f", "--vocab", tmp_path / "vocab")
    assert "param1" in capsys.readouterr().out
    older = corpus.flat_arrays(corpus.read_model(spark, str(tmp_path / "model")), 5)
    older.write.parquet(str(tmp_path / "older"))
    run("convert-dbs", tmp_path / "older", tmp_path / "vocab", tmp_path / "converted", "-f")
    same = lambda p: {(r.n, r.hash, r.kind, r.total, tuple(map(tuple, r.preds))) for r in corpus.read_model(spark, str(p)).collect()}
    assert same(tmp_path / "converted") == same(tmp_path / "model")
    corpus.write_vocab_json(corpus.read_vocab(spark, str(tmp_path / "vocab")), "function", str(tmp_path / "fn.json"))
    run("build-db", tmp_path / "raw", tmp_path / "vocab", tmp_path / "one", "-f", "-s", "2", "--fn-vocab", tmp_path / "fn.json")
    assert {r.n for r in corpus.read_model(spark, str(tmp_path / "one")).collect()} == {2}
    assert corpus.read_entries(spark, str(tmp_path / "set" / "converted_train.jsonl")).count() > 0
    run("print-db-hashes", tmp_path / "code.txt")


def test_archives(spark, tmp_path):
    for a in range(2):
        with lzma.open(tmp_path / f"{a}.tar.xz", "wb") as out, tarfile.open(fileobj=out, mode="w") as tar:
            for name in (f"./bins/x/h{a}.jsonl.gz", f"types/x/h{a}.json.gz", "bins/x/deep/h.jsonl.gz", "types/x/h9.jsonl.gz", "readme"):
                info = tarfile.TarInfo(name)
                info.size = len(MEMBER)
                tar.addfile(info, io.BytesIO(MEMBER))
    assert archive.find_archives(spark, str(tmp_path)).count() == 2
    members = archive.read_members(spark, str(tmp_path))
    assert {(r.key, r.flat) for r in members.collect()} == {("h0", "bins/h0.jsonl.gz"), ("h0", "types/h0.json.gz"), ("h1", "bins/h1.jsonl.gz"), ("h1", "types/h1.json.gz")}
    assert archive.archive_stats(members).first().asDict() == {"archives": 2, "files": 4, "bytes": 4 * len(MEMBER), "keys": 2}
    (tmp_path / "list.txt").write_text(" h1 \n\n")
    (tmp_path / "none.txt").write_text("\n")
    assert [r.key for r in archive.read_hash_list(spark, str(tmp_path / "list.txt")).collect()] == ["h1"]
    with pytest.raises(ValueError):
        archive.read_hash_list(spark, str(tmp_path / "none.txt"))
    cli.main(["extract", "-d", str(tmp_path), "-o", str(tmp_path / "ex"), "-f", str(tmp_path / "list.txt")], spark)
    assert {r.flat for r in spark.read.parquet(str(tmp_path / "ex")).collect()} == {"bins/h1.jsonl.gz", "types/h1.json.gz"}
    assert {(r.flat, r.line) for r in spark.read.parquet(str(tmp_path / "ex_unpacked")).collect()} == {(f, x) for f in ("bins/h1.jsonl", "types/h1.json") for x in ("abc", "d")}
    cli.main(["extract", "--directory", str(tmp_path), "-o", str(tmp_path / "more"), "-f", str(tmp_path / "list.txt"), "-a", "1", "-v", "-t", "2"], spark)
    assert spark.read.parquet(str(tmp_path / "more")).count() == 4  # the listed key and a sampled one


def test_models_without_sizes_and_platforms(spark, tmp_path):
    empty = spark.createDataFrame([], f"{corpus.MODEL}, n int")
    corpus.write_model(empty, str(tmp_path / "p" / "32"), {})
    with pytest.raises(corpus.CorpusError, match="no sizes"):
        corpus.read_model(spark, str(tmp_path / "p" / "32"))
    with pytest.raises(corpus.CorpusError, match="no model"):
        corpus.read_platform(spark, str(tmp_path / "p"))
    one = spark.createDataFrame([("a" * 24, "variable", 3, [(0, "x", 3)], 2)], f"{corpus.MODEL}, n int")
    corpus.write_model(one, str(tmp_path / "p" / "64"), {})
    assert [(r.arch_bits, r.n) for r in corpus.read_platform(spark, str(tmp_path / "p")).collect()] == [(64, 2)]
    with pytest.raises(corpus.CorpusError):
        corpus.write_platform({16: one}, str(tmp_path / "q"), {})


def test_reports_print_every_row(spark, capsys):
    cli._print(spark.range(1500).selectExpr("id", "concat('x', repeat('y', 50), id) as t"))
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 1501 and out[-1].endswith("1499") and out[0] == "id | t"


def test_throughput():
    from ctxvote.operators.metrics import throughput

    assert throughput(200, 4.0, 5.5).asDict() == {"ms_per_entry": 20.0, "entries_per_second": 50.0, "inference_seconds": 4.0, "total_seconds": 5.5}
    assert throughput(0, 1.0, 1.0).ms_per_entry == 0.0


def test_executables(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a").write_bytes(b"\x7fELFxx")
    (tmp_path / "b").write_bytes(b"#!/bin/sh")
    assert [r.file_id[-2:] for r in archive.executables(spark, str(tmp_path)).collect()] == ["_a"]


def test_streaming_counts_equal_batch_counts(spark, tmp_path):
    write_corpus(tmp_path / "c")
    entries = corpus.read_entries(spark, str(tmp_path / "c")).select("entry_id", "tokens", "labels")
    entries.write.parquet(str(tmp_path / "e"))
    from ctxvote.operators.model import labelled_windows, window_counts

    want = {tuple(r) for r in window_counts(labelled_windows(spark.read.parquet(str(tmp_path / "e")), sizes=(2,))).collect()}
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    query = stream_counts(stream, sizes=(2,)).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == want
