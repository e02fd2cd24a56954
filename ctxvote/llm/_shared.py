"""Helpers that the training-data operators share: lineage cuts, size-checked joins, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ensure_package

#: Identifier rows (8 to 16 bytes each) up to this count may be broadcast; beyond it the join shuffles.
BROADCAST_IDS = 400_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ctxvote-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_join(big: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join `big` with the materialised `ids`; broadcast `ids` only when its counted rows prove it small."""
    small = ids.count() <= BROADCAST_IDS
    return big.join(F.broadcast(ids) if small else ids, on, how)


def own_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`(doc_id, text)` alone, so that extra columns with clashing names never matter; null text is empty."""
    ensure_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def byte_slices(column: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 bytes of each string of an Arrow column without decoding them."""
    column = column.cast(pa.large_binary())
    offsets = memoryview(column.buffers()[1]).cast("q")[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]]


def release_memory(encoders: bool = True) -> None:
    """Give back what a worker has kept from earlier tasks: freed Arrow and heap pages, and other operators' encoders."""
    tokens = sys.modules.get("ctxvote.llm.tokens")
    if encoders and tokens is not None:
        tokens._ENCODERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def text_runs(batches: Iterator[pa.RecordBatch], limit: int = 1 << 21, encoders: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose `text` holds at most about `limit` bytes; a longer text is a run.

    Workers outlive tasks: memory of earlier ones is released first, encoders too unless the caller uses them.
    """
    release_memory(not encoders)
    for batch in batches:
        column = batch.column("text")
        start = held = 0
        for i, x in enumerate(byte_slices(column)):
            if held and held + len(x) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += len(x)
        if start < batch.num_rows:
            yield batch.slice(start)


def keep_rows(docs: DataFrame, wanted, text_col: str) -> DataFrame:
    """The rows of `docs`, all columns as they are, for whose texts (bytes; null is empty) `wanted` says so."""
    ensure_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_string()).fill_null("")
            sizes = [len(t) for t in byte_slices(texts)]
            start = 0
            while start < batch.num_rows:  # about 2 MB of text at a time
                stop, held = start, 0
                while stop < batch.num_rows and (stop == start or held + sizes[stop] <= 1 << 21):
                    held += sizes[stop]
                    stop += 1
                flags = wanted([bytes(t) for t in byte_slices(texts.slice(start, stop - start))])
                yield batch.slice(start, stop - start).filter(pa.array(flags, pa.bool_()))
                start = stop

    return docs.mapInArrow(run, docs.schema)


def kept_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that `decided(doc_id, text_key, kept)` keeps.

    Rows are told apart by id and `xxhash64` of the text.  Of rows that agree in both, one stays if one is kept.
    """
    rows = cut(decided.groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    on = free_names(docs.columns, "id", "none", "key")
    make = lambda doc_id, key: dict(zip(on, (F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), key), strict=True))
    own = make(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    there = rows.select("kept", "n", *[c.alias(x) for x, c in make(F.col("doc_id"), F.col("text_key")).items()])
    out = sized_join(docs.withColumns(own), there.where(~F.col("kept")).select(*on), on, "left_anti")
    again = there.where("kept and n > 1").select(*on)
    if not again.isEmpty():
        out = sized_join(out, again, on, "left_anti").unionByName(sized_join(out, again, on, "left_semi").dropDuplicates(on))
    return out.select(*[out[f"`{c}`"] for c in docs.columns])


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names that no column of `taken` has, whatever its case."""
    mark, lower = "_", {c.lower() for c in taken}
    while any(f"{mark}{w}" in lower for w in wanted):
        mark += "_"
    return [f"{mark}{w}" for w in wanted]
