"""Streaming count models: windows of arriving entries, counted as they come (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.windows import SIZES
from ..operators.model import labelled_windows, window_counts


def stream_counts(entries: DataFrame, label_type: str = "type", sizes=SIZES, flanking: bool = True) -> DataFrame:
    """A-5 over a stream of entries.  The state is the count table itself; use update or complete mode."""
    return window_counts(labelled_windows(entries, label_type, sizes, flanking))


def upsert_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's updated counts to a folder of its own; the last row of a key counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()
