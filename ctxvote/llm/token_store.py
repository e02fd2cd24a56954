"""A content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks whose borders depend on nearby ids only, so
equal passages give equal chunks.  Unique chunks are stored once under their SHA-256; a document's recipe lists
its chunks in order together with its place in the whole id stream and the Merkle root over its chunks; a manifest
holds the Merkle root of each recipe part, and one root over those.

Layout under the store's folder (Parquet):
    chunks/    digest, ids (2 or 4 bytes an id, little-endian), width, n_ids
    recipes/   part, doc_id, inside, n_tokens, digests (32 bytes a chunk), lengths (4 bytes a chunk), root
               -- rows in ascending doc_id order, parts in ascending order; `inside`: the ids before it in its part
    manifest/  part, n_docs, n_tokens, root

Reading checks every chunk against its digest, every recipe against its Merkle root, and the recipes of every part
against the manifest, whose leaves cover ids, places and lengths too.  The CRC-32 of a document comes from those of
its chunks as read: a chunk's CRC is moved over the bytes behind it (a multiplication by a power of x modulo the CRC
polynomial), and the moved values add up by exclusive or.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ensure_package
from ._shared import checkpoint_dir, cut, own_rows, partitions_of, release_memory, sized_join
from .tokens import encoded_rows

#: A chunk ends where this many low bits of the rolling hash are zero: 512 ids on average, at most `LONGEST`.
CUT_BITS = 9
ROLL = 16
LONGEST = 8192
#: Digests that a writing task remembers, so that a hot chunk leaves it once.
REMEMBERED = 200_000
#: Bytes of text to a bucket of chunks and to a part of recipes on average.
PART_BYTES = 256 << 20
#: Chunks with this many places are joined apart.
HOT_PLACES = 100_000

_CRC_POLY = 0xEDB88320


def chunk_ends(ids: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """The end positions of the chunks of documents that stand one after another; each document's end is one.

    A chunk ends where the hash of the `ROLL` ids before says so, all of them of the same document.
    """
    h = ids.astype(np.uint64) + np.uint64(1)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    step, base = 1, np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        while step < ROLL:  # the hash of the `ROLL` ids up to each position, by doubling
            h[step:] = h[step:] + h[:-step] * base
            base, step = base * base, step * 2
    found = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1
    starts = np.concatenate([[0], doc_ends])
    found = found[found - starts[np.searchsorted(doc_ends, found, "left")] >= ROLL]
    ends = np.unique(np.concatenate([found, doc_ends]))
    gaps = np.diff(ends, prepend=0)
    if len(gaps) and gaps.max() > LONGEST:
        long = gaps > LONGEST
        ends = np.sort(np.concatenate([ends, *[np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[long], gaps[long], strict=True)]]))
    return ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """The SHA-256 Merkle root; an odd node goes up as it is, no leaves give the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        paired = [hashlib.sha256(a + b).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = paired + leaves[len(paired) * 2 :]
    return leaves[0]


def _times_x(v: int) -> int:
    return (v >> 1) ^ (_CRC_POLY if v & 1 else 0)


def _product(a: np.ndarray, constant: int) -> np.ndarray:
    """Each polynomial of `a` times `constant`, modulo the CRC polynomial (bit 31 is x to the power 0)."""
    out, shifted = np.zeros_like(a), constant
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), np.uint32(shifted), np.uint32(0))
        shifted = _times_x(shifted)
    return out


def _powers() -> list[int]:
    """x to the power 8, 16, 32, ...: what moves a CRC over 1, 2, 4, ... bytes."""
    v = 1 << 23
    out = [v]
    for _ in range(62):
        v = int(_product(np.array([v], np.uint32), v)[0])
        out.append(v)
    return out


def moved_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 values moved over so many following bytes: crc(a + b) = moved_crc(crc(a), len(b)) ^ crc(b)."""
    crc, n = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k, power in enumerate(_powers()):
        if not (n >> k).any():
            break
        here = (n >> k & 1).astype(bool)
        crc[here] = _product(crc[here], power)
    return crc


def _deleted_at_exit(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def temporary_store(spark: SparkSession) -> str:
    """A folder for a store in the shared checkpoint folder, deleted when the application ends."""
    return _deleted_at_exit(spark, f"{checkpoint_dir(spark)}/token-store-{uuid.uuid4().hex}")


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every row's whole text, append `end_id`, and write the store at `path`; returns the top Merkle root (hex).

    Null and empty texts are `end_id` alone; a very long text is many chunks and one recipe; rows without an id come
    first; rows that repeat an id stand in the order of their contents; an empty table gives a store without recipes;
    other columns are not read.
    """
    spark = docs.sparkSession
    run = encoded_rows(spark, tokenizer, end_id)
    own = own_rows(docs, id_col, text_col)
    n_bytes = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(partitions_of(spark), -(-n_bytes // PART_BYTES))  # buckets of chunks, and parts of recipes, follow the bytes

    def encode(batches):
        import zstandard

        z, sent = zstandard.ZstdCompressor(level=3), set()
        for batch, texts in run(batches):
            packs: dict[int, list] = {}
            raw = b"".join(texts)
            ids = np.frombuffer(raw, "<u4")
            doc_ends = np.cumsum([len(x) // 4 for x in texts])
            ends = chunk_ends(ids, doc_ends)
            lengths = np.diff(ends, prepend=0).astype("<u4")
            places = ends.tolist()
            digests = [hashlib.sha256(raw[4 * a : 4 * b]).digest() for a, b in zip([0, *places], places, strict=False)]
            narrow = (np.maximum.reduceat(ids, ends - lengths) < 1 << 16).tolist()
            start = 0
            for digest, end, short in zip(digests, places, narrow, strict=True):
                if digest not in sent:
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(digest)
                    piece = ids[start:end]
                    piece = piece.astype("<u2") if short else piece
                    packs.setdefault(int.from_bytes(digest[:8], "big") % n, []).append((digest, piece.itemsize, piece.tobytes()))
                start = end
            rows, first = [], 0
            for doc_id, last, x in zip(batch.column("doc_id").to_pylist(), np.searchsorted(ends, doc_ends, "right").tolist(), texts, strict=True):
                own = digests[first:last]
                bucket = zlib.crc32(str(doc_id).encode()) % n
                rows.append((bucket, doc_id, len(x) // 4, b"".join(own), lengths[first:last].tobytes(), merkle_root(own), None))
                first = last
            for bucket, chunks in packs.items():
                heads = b"".join(d + struct.pack("<II", w, len(b)) for d, w, b in chunks)
                pack = np.asarray([len(chunks)], "<u4").tobytes() + heads + b"".join(b for _, _, b in chunks)
                rows.append((bucket, None, None, None, None, None, z.compress(pack)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "doc_id", "n_tokens", "digests", "lengths", "root", "pack"])

    rows = own.mapInArrow(encode, "bucket long, doc_id long, n_tokens long, digests binary, lengths binary, root binary, pack binary")
    staged = rows.repartitionById(n, F.col("bucket").cast("int"))
    staged = staged.mapInArrow(_unique, "kind string, doc_id long, n_tokens long, digests binary, lengths binary, root binary, digest binary, ids binary, width int, n_ids int")
    staged.write.partitionBy("kind").parquet(f"{path}/staged")
    _order_recipes(spark, path, n)
    manifest = _manifest(_recipes(spark, path))
    manifest.write.parquet(f"{path}/manifest")
    return _top_root(_stored_manifest(spark, path))


def _unique(batches):
    """Chunks of a bucket once each, recipes as they are; a task has one bucket, so only its digests are held.

    Workers outlive tasks, so the encoders of the tasks before, a large part of their memory, go first.
    """
    import zstandard

    release_memory()
    z, seen = zstandard.ZstdDecompressor(), set()
    for batch in batches:
        recipes = batch.filter(pa.compute.is_null(batch.column("pack")))
        if recipes.num_rows:
            none = [pa.nulls(recipes.num_rows, t) for t in (pa.binary(), pa.binary(), pa.int32(), pa.int32())]
            kind = pa.array(["recipe"] * recipes.num_rows)
            yield pa.RecordBatch.from_arrays([kind, *[recipes.column(c) for c in ("doc_id", "n_tokens", "digests", "lengths", "root")], *none], _STAGED)
        for packed in batch.column("pack").drop_null():
            pack = z.decompress(packed.as_py())
            count = int(np.frombuffer(pack, "<u4", 1)[0])
            at, rows = 4 + 40 * count, []
            for k in range(count):
                digest = pack[4 + 40 * k : 36 + 40 * k]
                width, size = struct.unpack_from("<II", pack, 36 + 40 * k)
                if digest not in seen:
                    seen.add(digest)
                    rows.append((digest, pack[at : at + size], width, size // width))
                at += size
            if rows:
                none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())]
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * len(rows)), *none, *made], _STAGED)


_STAGED = ["kind", "doc_id", "n_tokens", "digests", "lengths", "root", "digest", "ids", "width", "n_ids"]
_STAGED_RECIPE = "doc_id long, n_tokens long, digests binary, lengths binary, root binary"
_CHUNK = "digest binary, ids binary, width int, n_ids int"
_RECIPE = "part int, doc_id long, inside long, n_tokens long, digests binary, lengths binary, root binary"
_MANIFEST = "part int, n_docs long, n_tokens long, root binary"


def _order_recipes(spark: SparkSession, path: str, n: int) -> None:
    """Write the recipes in ascending doc_id order, each with the number of ids before it in its part."""
    staged = spark.read.schema(_STAGED_RECIPE).parquet(f"{path}/staged/kind=recipe") if _exists(spark, f"{path}/staged/kind=recipe") else spark.createDataFrame([], _STAGED_RECIPE)
    order = [F.col("doc_id").asc_nulls_first(), F.col("root"), F.col("digests")]
    ranged = staged.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "*")

    def place(batches):
        inside = 0
        for batch in batches:
            sizes = np.asarray(batch.column("n_tokens")).astype(np.int64)
            ends = inside + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), pa.array(ends - sizes), *[batch.column(c) for c in ("n_tokens", "digests", "lengths", "root")]], ["part", "doc_id", "inside", "n_tokens", "digests", "lengths", "root"])
            inside = int(ends[-1]) if len(ends) else inside

    ranged.mapInArrow(place, _RECIPE).write.parquet(f"{path}/recipes")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class _Fold:
    """The Merkle root of leaves that come one after another: at most one waiting node for each height."""

    def __init__(self) -> None:
        self.waiting: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height = 0
        while self.waiting and self.waiting[-1][0] == height:
            leaf = hashlib.sha256(self.waiting.pop()[1] + leaf).digest()
            height += 1
        self.waiting.append((height, leaf))

    def root(self) -> bytes:
        """As `merkle_root`: an odd node goes up as it is."""
        if not self.waiting:
            return hashlib.sha256(b"").digest()
        out = self.waiting[-1][1]
        for _, node in reversed(self.waiting[:-1]):
            out = hashlib.sha256(node + out).digest()
        return out


def _manifest(recipes: DataFrame) -> DataFrame:
    """One row per part: counts and the Merkle root over its recipes, folded in their order.

    A recipe's leaf covers its id, place, lengths and its own root.
    """

    def fold(batches):
        part, n_docs, n_tokens, state = None, 0, 0, _Fold()
        for batch in batches:
            done = []
            for p, doc_id, inside, size, lengths, root in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "inside", "n_tokens", "lengths", "root")), strict=True):
                if p != part:
                    if part is not None:
                        done.append((part, n_docs, n_tokens, state.root()))
                    part, n_docs, n_tokens, state = p, 0, 0, _Fold()
                if inside != n_tokens:
                    raise ValueError(f"a recipe is missing before place {inside} of part {p}")
                state.add(hashlib.sha256(f"{doc_id} {inside} {size} ".encode() + lengths + root).digest())
                n_docs, n_tokens = n_docs + 1, n_tokens + size
            yield _manifest_rows(done)
        yield _manifest_rows([] if part is None else [(part, n_docs, n_tokens, state.root())])

    rows = recipes.select("part", "doc_id", "inside", "n_tokens", "lengths", "root")
    return rows.repartition(partitions_of(recipes.sparkSession), "part").sortWithinPartitions("part", "inside").mapInArrow(fold, _MANIFEST)


def _manifest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "n_docs", "n_tokens", "root"])


def _top_root(manifest: DataFrame) -> str:
    """The Merkle root (hex) over the roots of the parts, folded in their order by one task."""

    def fold(batches):
        state = _Fold()
        for batch in batches:
            for root in batch.column("root").to_pylist():
                state.add(root)
        yield pa.RecordBatch.from_arrays([pa.array([state.root()], pa.binary())], ["root"])

    roots = manifest.select("part", "root").repartition(1).sortWithinPartitions("part").mapInArrow(fold, "root binary")
    found = roots.first()  # none where no task ran, for lack of parts
    return (bytes(found[0]) if found else merkle_root([])).hex()


def verify_manifest(spark: SparkSession, path: str, top_root: str | None = None) -> None:
    """Fold the recipes as read and hold the parts against the stored manifest, and this against `top_root`."""
    ensure_package(spark)
    stored = _stored_manifest(spark, path)
    found = _manifest(_recipes(spark, path))
    key = F.struct("n_docs", "n_tokens", "root")
    both = stored.select("part", key.alias("a")).join(found.select("part", key.alias("b")), "part", "full")
    wrong = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("part").first()
    if wrong is not None:
        raise ValueError(f"the recipes of part {wrong[0]} do not fit the manifest")
    if top_root is not None and _top_root(stored) != top_root:
        raise ValueError("the manifest does not fit the top root")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_RECIPE).parquet(f"{path}/recipes")


def _stored_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with `start`: the ids of all documents before."""
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part of `PART_BYTES`
    bases = _stored_manifest(spark, path).select("part", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("base"))
    return sized_join(_recipes(spark, path), cut(bases), ["part"], "inner").withColumn("start", F.col("base") + F.col("inside"))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    at = f"{path}/staged/kind=chunk"
    return spark.read.schema(_CHUNK).parquet(at) if _exists(spark, at) else spark.createDataFrame([], _CHUNK)


def _entries(recipes: DataFrame) -> DataFrame:
    """One row per chunk of each verified recipe: `doc_id, start, n_tokens, nth, digest, tail` (ids behind the chunk)."""

    def explode(batches):
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                batch = big.slice(at, 2000)
                roots, counts, leaves, tails = batch.column("root").to_pylist(), [], [], []
                starts, totals = np.asarray(batch.column("start")), np.asarray(batch.column("n_tokens"))
                for k, (digests, lengths) in enumerate(zip(batch.column("digests").to_pylist(), batch.column("lengths").to_pylist(), strict=True)):
                    own = [digests[i : i + 32] for i in range(0, len(digests), 32)]
                    if merkle_root(own) != roots[k]:
                        raise ValueError(f"the recipe at {starts[k]} does not fit its Merkle root")
                    counts.append(len(own))
                    leaves += own
                    tails.append(totals[k] - np.cumsum(np.frombuffer(lengths, "<u4").astype(np.int64)))
                of = pa.array(np.repeat(np.arange(len(counts)), counts))
                nth = np.concatenate([np.arange(c) for c in counts])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("start").take(of), batch.column("n_tokens").take(of), pa.array(nth), pa.array(leaves, pa.binary()), pa.array(np.concatenate(tails))], ["doc_id", "start", "n_tokens", "nth", "digest", "tail"])

    return recipes.mapInArrow(explode, "doc_id long, start long, n_tokens long, nth long, digest binary, tail long")


def _wide(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()


def _hot_digests(recipes: DataFrame) -> DataFrame:
    """`(digest)` of chunks that stand in very many places: too many for one task of a join."""
    each = F.transform(F.sequence(F.lit(0), (F.octet_length("digests") / 32).cast("int") - 1), lambda k: F.substring(F.col("digests"), 32 * k + 1, F.lit(32)))
    counts = recipes.select(F.explode(each).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= HOT_PLACES).select("digest")


def read_digests(spark: SparkSession, path: str, top_root: str | None = None) -> DataFrame:
    """Per document of the store, from its files: `doc_id, start, n_tokens, ids_crc32`, after all checks.

    Parts are held against the manifest (and this against `top_root`), recipes and chunks against their digests.
    """

    def check(batches):
        for batch in batches:
            digests, crcs = batch.column("digest").to_pylist(), []
            for digest, ids, width in zip(digests, batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True):
                raw = _wide(ids, width)
                if hashlib.sha256(raw).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} does not fit its digest")
                crcs.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(crcs, pa.int64())], ["digest", "crc"])

    def move(batches):
        for batch in batches:
            if batch.num_rows:
                crc = moved_crc(np.asarray(batch.column("crc")), 4 * np.asarray(batch.column("tail")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "crc"])

    ensure_package(spark)
    verify_manifest(spark, path, top_root)
    sums = cut(_chunks(spark, path).mapInArrow(check, "digest binary, crc long"))
    recipes = _placed(spark, path)
    entries = _entries(recipes)
    hot = cut(_hot_digests(recipes))
    missing = F.raise_error(F.lit("a chunk is missing")).cast("long")
    columns = ["doc_id", "start", "n_tokens", "tail", F.coalesce("crc", missing).alias("crc")]
    moved = sized_join(entries, hot, ["digest"], "left_anti").join(sums, "digest", "left").select(*columns)
    if not hot.isEmpty():
        moved = moved.union(sized_join(entries, cut(sums.join(hot, "digest")), ["digest"], "inner").select(*columns))
    moved = moved.mapInArrow(move, "doc_id long, start long, n_tokens long, crc long")
    return moved.groupBy("doc_id", "start", "n_tokens").agg(F.expr("bit_xor(crc)").alias("ids_crc32"))


def read_documents(spark: SparkSession, path: str, top_root: str | None = None) -> DataFrame:
    """Reconstruct every document from the store: `doc_id, start, n_tokens, ids` (u32 little-endian)."""
    ensure_package(spark)
    verify_manifest(spark, path, top_root)
    missing = F.raise_error(F.lit("a chunk is missing")).cast("binary")
    entries = _entries(_placed(spark, path)).join(_chunks(spark, path), "digest", "left").withColumn("ids", F.coalesce("ids", missing))

    def widen(batches):
        for batch in batches:
            ids = pa.array([_wide(i, w) for i, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens", "nth")] + [ids], ["doc_id", "start", "n_tokens", "nth", "ids"])

    rows = entries.mapInArrow(widen, "doc_id long, start long, n_tokens long, nth long, ids binary")
    joined = F.array_sort(F.collect_list(F.struct("nth", "ids")))
    rows = rows.groupBy("doc_id", "start", "n_tokens").agg(joined.alias("pieces"))
    return rows.select("doc_id", "start", "n_tokens", F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
