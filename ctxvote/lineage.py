"""Materialised intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only in local mode without it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ctxvote-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, its lineage cut there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go as soon as it is done."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder as compressed columns, for tables that are large; they are deleted
    when the application ends.  The shuffle files of the write go as soon as it is done."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    with shuffles_go(spark):
        df.select("*").write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def shared_table(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` over the inputs at `sf_dir`, built once for each application: reports share one set of
    predictions instead of training again."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT:
        _KEPT[key] = stored(build())
    return _KEPT[key]
