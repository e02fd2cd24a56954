"""Archives, hash lists and file inventories (S-12 to S-15, K-6, K-7, T-27, T-28, A-30)."""

from __future__ import annotations

import gzip
import io
import tarfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ensure_package

MEMBER = r"\A(?:\./)?(bins|types)/([^/]+)/([^/]+?)\.(jsonl|json)\.gz\z"


def find_archives(spark: SparkSession, folder: str) -> DataFrame:
    """S-12: `path, length` of the `.tar.xz` files of a folder, not of its subfolders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.xz").load(folder)
    return files.select("path", "length").orderBy("path")


def member_key(path: Column) -> Column:
    """T-27: the hash in a member's path, null for other paths."""
    right = (F.regexp_extract(path, MEMBER, 1) == "bins") & (F.regexp_extract(path, MEMBER, 4) == "jsonl") | (F.regexp_extract(path, MEMBER, 1) == "types") & (F.regexp_extract(path, MEMBER, 4) == "json")
    return F.when(right, F.regexp_extract(path, MEMBER, 3))


def flat_name(path: Column) -> Column:
    """T-27: where a member goes when folders are flattened: `bins/<hash>.jsonl.gz` or `types/<hash>.json.gz`."""
    return F.when(member_key(path).isNotNull(), F.concat(F.regexp_extract(path, MEMBER, 1), F.lit("/"), F.regexp_extract(path, MEMBER, 3), F.lit("."), F.regexp_extract(path, MEMBER, 4), F.lit(".gz")))


def _opened(path: str):
    """A stream of a file by its URI, wherever the executors can reach it."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_stream(place)


def read_members(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """S-13: `archive, member, key, kind, size, flat, content` of all archives.

    An xz stream cannot be split, so an archive is a task; it is streamed, and its members leave it one by one.
    """
    ensure_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.xz").load(folder).select("path")
    files = files.repartition(max(1, files.count()), "path")  # archives are few and large

    def extract(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _opened(path) as stream, tarfile.open(fileobj=stream, mode="r|xz") as archive:
                    for member in archive:
                        if member.isfile():
                            body = archive.extractfile(member).read() if content else None
                            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([member.name]), pa.array([member.size], pa.int64()), pa.array([body], pa.binary())], ["archive", "member", "size", "content"])

    rows = files.mapInArrow(extract, "archive string, member string, size long, content binary")
    rows = rows.withColumn("key", member_key(F.col("member"))).where("key is not null")
    return rows.select("archive", "member", "key", F.regexp_extract("member", MEMBER, 1).alias("kind"), "size", flat_name(F.col("member")).alias("flat"), *(["content"] if content else []))


def unpacked(members: DataFrame) -> DataFrame:
    """`flat, line` of the gzipped members, one row a line of each; a member that is no gzip stream is an error."""
    ensure_package(members.sparkSession)

    def unpack(batches):
        for batch in batches:
            for name, data in zip(batch.column("flat").to_pylist(), batch.column("content"), strict=True):
                lines, size = [], 0
                for line in io.TextIOWrapper(gzip.GzipFile(fileobj=io.BytesIO(data.as_py())), encoding="utf-8", errors="replace"):
                    lines.append(line.rstrip("\n"))
                    size += len(line)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(lines, pa.string())], ["flat", "line"])
                        lines, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(lines, pa.string())], ["flat", "line"])

    return members.select(F.regexp_replace("flat", r"\.gz\z", "").alias("flat"), "content").mapInArrow(unpack, "flat string, line string")


def archive_stats(members: DataFrame) -> DataFrame:
    """A-30."""
    return members.agg(F.countDistinct("archive").alias("archives"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.countDistinct("key").alias("keys"))


def read_hash_list(spark: SparkSession, path: str) -> DataFrame:
    """S-14: `key`, one a line, trimmed; blank lines do not count, an empty list is an error."""
    rows = spark.read.text(path).select(F.trim("value").alias("key")).where("key <> ''").distinct()
    if rows.isEmpty():
        raise ValueError(f"no hashes in {path}")
    return rows


def write_hash_list(members: DataFrame, path: str) -> None:
    """K-6: the distinct keys in order; a range sort keeps the order across part files."""
    members.select(F.col("key").alias("value")).distinct().orderBy("value").write.text(path)


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """K-7, T-28: `file, length, digest` of a folder's files by name."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("file"), "length", F.sha2("content", 256).alias("digest")).orderBy("file")


def executables(spark: SparkSession, folder: str) -> DataFrame:
    """S-15: `path, length, file_id` of files anywhere below a folder that begin as ELF does; the id is a digest and the name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    good = files.where(F.substring("content", 1, 4) == F.lit(b"\x7fELF"))
    return good.select("path", "length", F.concat(F.sha2("content", 256), F.lit("_"), F.regexp_extract("path", r"([^/]*)\z", 1)).alias("file_id"))
