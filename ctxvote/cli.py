"""Command line: `python -m ctxvote.cli VERB ...`."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import discover_targets
from .functions.types import function_name  # noqa: F401  part of the public surface
from .functions.windows import SIZES
from .operators import dataset, metrics, model, predict
from .sources import archive, corpus


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="ctxvote")
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name: str, *positional: str) -> argparse.ArgumentParser:
        made = verbs.add_parser(name)
        for p in positional:
            made.add_argument(p)
        return made

    def shared(p: argparse.ArgumentParser) -> None:
        p.add_argument("-t", "--type", default="type", choices=["type", "name"], type=str.lower)
        p.add_argument("-f", "--flanking", action="store_true")
        p.add_argument("--strip", action="store_true")

    verb("build-vocab", "input", "output").add_argument("-t", "--type", default="type", choices=["type", "name"], type=str.lower)
    one = verb("build-db", "input", "vocab", "output")
    shared(one)
    one.add_argument("--fn-vocab")
    one.add_argument("-s", "--size", type=int, default=10)
    one.add_argument("-k", "--topk", type=int, default=5)
    every = verb("build-all-dbs", "input", "vocab")
    shared(every)
    every.add_argument("--fn-vocab")
    every.add_argument("-o", "--output", required=True)
    every.add_argument("-k", "--topk", type=int, default=5)
    evaluate = verb("evaluate", "input", "vocab", "output")
    shared(evaluate)
    evaluate.add_argument("-d", "--db", required=True)
    evaluate.add_argument("--consider-train")
    evaluate.add_argument("--aggregate-funcs", action="store_true")
    evaluate.add_argument("--threshold", type=float, default=1.0)
    evaluate.add_argument("--threshold-debug", action="store_true")
    evaluate.add_argument("--threshold-sweep", action="store_true")
    create = verb("create-dataset")
    create.add_argument("-i", "--input", required=True)
    create.add_argument("-o", "--output", required=True)
    verb("print-db-hashes", "input")
    recover = verb("recover", "input")
    shared(recover)
    recover.add_argument("-d", "--db", "--db-dir", required=True)
    recover.add_argument("--vocab", help="names of the model's label ids, in place of those kept with it")
    recover.add_argument("--fn-vocab")
    recover.add_argument("--threshold", type=float, default=1.0)
    recover.add_argument("--top-k", type=int, default=5)
    convert = verb("convert-dbs", "input", "vocab", "output")
    convert.add_argument("--fn-vocab")
    shared(convert)
    convert.add_argument("-k", "--topk", type=int, default=5)
    extract = verb("extract")
    extract.add_argument("-d", "--directory", "--dir", dest="dir", default=".")
    extract.add_argument("-o", "--output", default="extracted")
    extract.add_argument("-t", "--threads", type=int, help="archives that are read at once")
    extract.add_argument("-s", "--skip-extraction", action="store_true", help="unpack the members of an earlier run only")
    extract.add_argument("-v", "--verbose", action="store_true")
    extract.add_argument("-f", "--hash-file")
    extract.add_argument("-a", "--add", type=int, help="keys to sample beyond those of the hash file")
    return parser


def _vocab(spark: SparkSession, path: str, functions: str | None) -> DataFrame:
    """The vocabulary of both kinds; with `functions` that of functions comes from a file of its own."""
    read = lambda p, kind: corpus.read_vocab_json(spark, p, kind) if p.endswith(".json") else corpus.read_vocab_tsv(spark, p, kind) if p.endswith((".tsv", ".txt")) else corpus.read_vocab(spark, p)
    vocab = read(path, "variable")
    if functions is None:
        return vocab
    own = read(functions, "function").withColumn("kind", F.lit("function"))
    return vocab.where("kind = 'variable'").unionByName(own.dropDuplicates(["id"]))


def _print(rows: DataFrame) -> None:
    """Every row and whole cells, as they arrive from the cluster."""
    print(" | ".join(rows.columns))
    for row in rows.toLocalIterator():
        print(" | ".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ctxvote").getOrCreate()
    settings = {"label_type": getattr(args, "type", "type"), "flanking": getattr(args, "flanking", False), "full_strip": getattr(args, "strip", False)}
    if args.verb == "build-vocab":
        corpus.write_vocab(model.build_vocab(corpus.read_entries(spark, args.input, strict=True), args.type), args.output)
    elif args.verb in ("build-db", "build-all-dbs"):
        sizes = (args.size,) if args.verb == "build-db" else SIZES
        made = model.build_model(corpus.read_entries(spark, args.input), _vocab(spark, args.vocab, args.fn_vocab), args.type, sizes, args.topk, args.flanking, args.strip)
        corpus.write_model(model.nested(made), args.output, settings | {"topk": args.topk, "sizes": ",".join(map(str, sizes))})
    elif args.verb == "evaluate":
        _evaluate(spark, args, settings)
    elif args.verb == "create-dataset":
        made = dataset.create_dataset(corpus.read_entries(spark, args.input))
        corpus.write_entries(made.where("train"), f"{args.output}/converted_train.jsonl")
        corpus.write_entries(made.where("not train"), f"{args.output}/converted_test.jsonl")
    elif args.verb == "print-db-hashes":
        _print(archive.file_digests(spark, args.input))
    elif args.verb == "convert-dbs":
        rows = spark.read.parquet(args.input)
        made = corpus.nested_from_flat_arrays(rows, args.topk, _vocab(spark, args.vocab, args.fn_vocab))
        corpus.write_model(made, args.output, settings | {"topk": args.topk})
    elif args.verb == "recover":
        return _recover(spark, args, settings)
    elif args.verb == "extract":
        _extract(spark, args)
    return 0


def _model(spark, args, settings):
    nested = corpus.read_model(spark, args.db, settings)
    sizes = tuple(r.n for r in nested.select("n").distinct().orderBy(F.desc("n")).collect())  # a handful
    return model.flat(nested), sizes


def _evaluate(spark, args, settings) -> None:
    start = time.perf_counter()
    entries, vocab = corpus.read_entries(spark, args.input), corpus.read_vocab(spark, args.vocab)
    counts, sizes = _model(spark, args, settings)
    n_entries, loaded = entries.count(), time.perf_counter()
    found = predict.predict(entries, counts, args.type, 5, sizes, args.flanking, args.strip).cache()
    found.count()
    inference = time.perf_counter() - loaded
    rows = metrics.records(found, vocab).cache()
    reports = [metrics.accuracy(rows, args.threshold), metrics.ood_rate(rows), metrics.top_missing(rows), metrics.prefix_prf(rows), metrics.struct_metrics(rows), metrics.layout_rates(rows), metrics.field_prf(rows), metrics.composite_prf(rows), metrics.top_correct(rows, "function", 20), metrics.top_correct(rows, "variable", 10)]
    if args.threshold_debug:
        reports.append(metrics.threshold_stats(rows, args.threshold))
    if args.threshold_sweep:
        reports.append(metrics.threshold_sweep(rows))
    if args.aggregate_funcs:
        reports.append(metrics.address_accuracy(metrics.functions_by_address(rows)))
    if args.consider_train:
        reports.append(metrics.train_membership(rows, entries, corpus.read_entries(spark, args.consider_train)))
    for report in reports:
        _print(report)
    corpus.write_predictions(metrics.output_records(rows, entries), args.output)
    _print(spark.createDataFrame([metrics.throughput(n_entries, inference, time.perf_counter() - start)]))


def _recover(spark, args, settings) -> int:
    if args.top_k < 1:
        raise SystemExit("--top-k must be at least 1")
    listings = corpus.read_listings(spark, args.input).withColumn("targets", discover_targets(F.col("code")))
    if listings.where(F.size("targets") > 0).isEmpty():
        raise SystemExit("no recoverable symbols in the input")
    counts, sizes = _model(spark, args, settings)
    if args.vocab:
        named = _vocab(spark, args.vocab, args.fn_vocab)
        counts = model.lookup_labels(counts.drop("label").withColumnRenamed("vocab_id", "id"), named).withColumnRenamed("id", "vocab_id").where("label is not null")
    _print(predict.recover(corpus.entries_from_listings(listings), counts, args.top_k, args.threshold, sizes, args.flanking, args.strip, small=listings.count() == 1))
    return 0


def _extract(spark, args) -> None:
    start = time.perf_counter()
    if not args.skip_extraction:
        members = archive.read_members(spark, args.dir)
        if args.threads:
            members = members.coalesce(args.threads)
        if args.hash_file:
            members = dataset.listed_and_sample(members, archive.read_hash_list(spark, args.hash_file), "key", args.add or 0)
        members.select("archive", "key", "kind", "size", "flat", "content").write.parquet(args.output)
        archive.write_hash_list(spark.read.parquet(args.output), f"{args.output}_hashes")
    found = spark.read.parquet(args.output)
    archive.unpacked(found).write.parquet(f"{args.output}_unpacked")
    if args.verbose:
        stats = archive.archive_stats(found).first()
        _print(spark.createDataFrame([(*stats, round(time.perf_counter() - start, 3))], [*stats.asDict(), "seconds"]))


if __name__ == "__main__":
    raise SystemExit(main())
