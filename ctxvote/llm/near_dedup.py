"""Near-duplicate classes by DartMinHash signatures, banding, and exact verification.

Documents are sets of five-word shingles (`weights="counts"`: weighted by how often a shingle occurs).  A shingle's
weight spans a region of the (weight, rank) plane, into which hashed darts fall as a Poisson process that depends
on the shingle alone.  A document throws the darts of its shingles up to the rank at which about `k ln k + 2k` have
fallen, and of those on each coordinate the earliest stays: one pass yields all coordinates, and two documents
agree on one with the probability of their (weighted) Jaccard similarity.

Bands of `ROWS` coordinates go to buckets.  A bucket has up to `PIVOTS` pivots, its first members in as many hash
orders; every member is paired with them, and candidate pairs are verified by the exact similarity of the whole
texts.  All pairs of a bucket that are still in different components follow, so no link within a bucket is lost: in
buckets of up to `SMALL` members as rows, in larger ones in cells of up to about `BLOCK` by `BLOCK` members, which an
index over the shingles of one side compares without a row for each pair.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U, joined_docs, lowered, mix, window_hashes, word_hashes
from ._shared import byte_slices, cut, own_rows, partitions_of, release_memory, sized_join, text_runs
from .components import components, joined_components

SHINGLE = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 a pair shares a band with a probability of 1 - (1 - 0.8**6)**28 = 0.9998.
BANDS, ROWS = 28, 6
#: Pivots of a bucket, members up to which its open pairs are rows, and members on a side of a cell beyond that.
PIVOTS, SMALL, BLOCK = 4, 16, 1024
#: Partners of a pivot in a bucket that are verified beside one copy of it, on average.
SALT = 256

_LOWEST = -8  # ranks up to 2**-8 are one cell
_AREA = 8  # the mean number of darts above which a cell is cut into parts


def shingles(low: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, their documents, words per document, hashes of the word sequences) of joined documents.

    A text of fewer than `SHINGLE` words, but not none, has one shingle: all its words.
    """
    words, at, _ = word_hashes(low)
    first = np.searchsorted(at, starts)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = window_hashes(words, SHINGLE)
    inside = doc[: len(grams)] == doc[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    grams, gram_doc = grams[inside], doc[: len(inside)][inside]
    # The whole word sequences, as two independent sums over (word, place).
    place = (np.arange(len(words)) - np.repeat(first[:-1], counts)).astype(np.uint64)
    keys = np.zeros((len(counts), 2), np.uint64)
    some = np.flatnonzero(counts)
    for k in range(2):
        if len(some):
            keys[some, k] = np.add.reduceat(mix(words ^ mix(place + U(1 + k * 0x51_7C_C1B7))), first[:-1][some])
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    grams = np.concatenate([grams, mix(keys[short, 0])])
    return grams, np.concatenate([gram_doc, short]), counts, keys


def distinct_shingles(grams: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, documents, counts), each shingle of a document once, documents ascending."""
    order = np.lexsort((grams, doc))
    g, d = grams[order], doc[order]
    first = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(g) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return g[at], d[at], np.diff(np.append(at, len(g)))


def _poisson(area: float, u: np.ndarray) -> np.ndarray:
    """Poisson counts of a mean `area` from uniform numbers."""
    term = total = math.exp(-area)
    cdf, k = [total], 0
    while total < 1 - 1e-15 and k < 40 + 4 * area:
        k += 1
        term *= area / k
        total += term
        cdf.append(total)
    return np.searchsorted(np.asarray(cdf), u, "left")


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * 2.0**-53


def dart_minhash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """A signature of `k` coordinates for each document with a positive total weight; 0 for others."""
    totals = np.bincount(doc, weights, n_docs)
    ranks, prints = np.full(n_docs * k, np.inf), np.zeros(n_docs * k, np.uint64)
    with np.errstate(divide="ignore"):
        reach = np.ceil(np.log2((k * math.log(k) + 2 * k) / totals))
    reach = np.where(totals > 0, np.maximum(reach, _LOWEST), -np.inf)
    done = np.full(n_docs, -np.inf)  # the highest rank cell thrown so far
    while (todo := reach > done).any():
        for cell in range(int(min(reach[todo].min(), _LOWEST)), int(reach[todo].max()) + 1):
            which = (reach >= cell) & (done < cell)
            here = np.flatnonzero(which[doc])
            if len(here):
                _throw(elements[here], weights[here], doc[here], cell, k, ranks, prints)
        done = np.where(todo, reach, done)
        # A coordinate without a dart looks at ranks twice as high.
        empty = np.isinf(ranks.reshape(n_docs, k)).any(axis=1) & (totals > 0)
        reach = np.where(empty, done + 1, done)
    return prints.reshape(n_docs, k)


def _throw(elements, weights, doc, cell, k, ranks, prints) -> None:
    """The darts of all elements in a rank cell: (2**(cell - 1), 2**cell], the lowest from 0."""
    rank_from = 0.0 if cell == _LOWEST else 2.0 ** (cell - 1)
    rank_size = 2.0**cell - rank_from
    weight_from, weight_size = 0.0, 1.0
    while True:
        here = np.flatnonzero(weights > weight_from)
        if not len(here):
            return
        salt = mix(np.asarray([(cell + 64) * 128 + int(weight_from).bit_length()], np.uint64))
        parts = max(1, int(rank_size * weight_size / _AREA))  # of the cell, by rank
        part = np.tile(np.arange(parts), len(here))
        owner = np.repeat(here, parts)
        h = mix(elements[owner] ^ salt) + part.astype(np.uint64) * U(0xD6E8FEB86659FD93)
        counts = _poisson(rank_size * weight_size / parts, _uniform(mix(h + U(1))))
        of = np.repeat(np.arange(len(owner)), counts)
        if len(of):
            nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            dart = mix(h[of] + (nth.astype(np.uint64) + U(2)) * U(0x9E3779B97F4A7C15))
            if weight_from or (weights[here] < 1).any():
                inside = weight_from + weight_size * _uniform(mix(dart ^ U(0xA5A5A5A5))) < weights[owner][of]
                of, dart = of[inside], dart[inside]
            rank = rank_from + rank_size / parts * (part[of] + _uniform(mix(dart ^ U(0x5A5A5A5A))))
            slot = doc[owner][of] * k + (dart % U(k)).astype(np.int64)
            np.minimum.at(ranks, slot, rank)
            best = ranks[slot] == rank
            prints[slot[best]] = dart[best]
        weight_from, weight_size = weight_from + weight_size, max(1.0, weight_from + weight_size)


def _signer(weights: str):
    def sign(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for batch in text_runs(batches, 1 << 19):
            texts = [lowered(bytes(t)) for t in byte_slices(batch.column("text"))]
            n = len(texts)
            grams, gram_doc, counts, keys = shingles(*joined_docs(texts))
            g, d, times = distinct_shingles(grams, gram_doc)
            w = np.ones(len(g)) if weights == "set" else times.astype(float)
            signature = dart_minhash(g, w, d, n, BANDS * ROWS)
            bands = np.zeros((n, BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands * U(0x9E3779B97F4A7C15) + signature[:, r::ROWS])
            bands ^= mix(np.arange(1, BANDS + 1, dtype=np.uint64))  # bands have buckets of their own
            flat = pa.array(bands.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(counts), pa.array(keys[:, 0].view(np.int64)), pa.array(np.ascontiguousarray(keys[:, 1]).view(np.int64)), lists, pa.array([z.compress(t) for t in texts], pa.binary())],
                ["doc_id", "text_key", "n_words", "key1", "key2", "bands", "packed"],
            )

    return sign


_SIGNED = "doc_id long, text_key long, n_words long, key1 long, key2 long, bands array<long>, packed binary"


def _slices(batches, columns: tuple[str, ...], limit: int = 1 << 18):
    """Lists of columns of a few rows each: about `limit` bytes of packed text."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("packed")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + limit, "right"))
            stop = min(max(stop, start + 1), start + 256)
            rows = batch.slice(start, stop - start)
            yield [rows.column(c).to_pylist() for c in columns]
            start += rows.num_rows


def _loader(weights: str):
    """A function from packed texts to (shingles, documents, times, first of each document), documents ascending."""
    import zstandard

    z = zstandard.ZstdDecompressor()

    def load(packed: list[bytes]):
        grams, doc, _, _ = shingles(*joined_docs([z.decompress(x) for x in packed]))
        g, d, times = distinct_shingles(grams, doc)
        return g, d, np.ones(len(g), np.int64) if weights == "set" else times.astype(np.int64), np.searchsorted(d, np.arange(len(packed) + 1))

    return load


def _verifier(weights: str, similarity: float):
    """Rows (pivot, salt, node, packed), a pivot's own row first: the links (u, v) that reach `similarity`."""

    def verify(batches):
        release_memory()
        load = _loader(weights)
        at, own = None, None  # the group of the last row, and its pivot's shingles
        for pivots, salts, nodes, packed in _slices(batches, ("pivot", "salt", "node", "packed")):
            g, d, times, first = load(packed)
            group, heads = [], [own] if own is not None else []  # of each row; the pivots' shingles by group
            for k, (pivot, salt, node) in enumerate(zip(pivots, salts, nodes, strict=True)):
                if (pivot, salt) != at:
                    if node != pivot:
                        raise ValueError("a pivot's row is missing")
                    at = (pivot, salt)
                    heads.append((g[first[k] : first[k + 1]], times[first[k] : first[k + 1]]))
                group.append(len(heads) - 1)
            own, group = heads[-1], np.asarray(group)
            # (group, shingle) as one number each: exact, and ascending among the pivots.
            distinct, code = np.unique(np.concatenate([*[x for x, _ in heads], g]), return_inverse=True)
            own_sizes = np.asarray([len(x) for x, _ in heads])
            n_own = int(own_sizes.sum())
            own_key = np.repeat(np.arange(len(heads)), own_sizes) * len(distinct) + code[:n_own]
            own_times = np.concatenate([t for _, t in heads])
            key = group[d] * len(distinct) + code[n_own:]
            place = np.minimum(np.searchsorted(own_key, key), n_own - 1)
            same = own_key[place] == key
            shared = np.bincount(d[same], np.minimum(own_times[place], times)[same], len(nodes))
            totals = np.bincount(d, times, len(nodes))
            own_totals = np.asarray([t.sum() for _, t in heads])[group]
            pivots, nodes = np.asarray(pivots, np.int64), np.asarray(nodes, np.int64)
            linked = (shared >= similarity * (own_totals + totals - shared) - 1e-9) & (pivots != nodes)
            yield pa.RecordBatch.from_arrays([pa.array(pivots[linked]), pa.array(nodes[linked])], ["u", "v"])

    return verify


def _links(pairs: DataFrame, texts: DataFrame, weights: str, similarity: float) -> DataFrame:
    """The pairs (pivot, salt, node) whose similarity is enough.  A pivot's text is copied beside each of its salts."""
    n = partitions_of(pairs.sparkSession)
    own = pairs.select("pivot", "salt").distinct().select("pivot", "salt", F.col("pivot").alias("node"))
    rows = sized_join(texts, pairs.select("pivot", "salt", "node").union(own), ["node"], "inner")
    rows = rows.select("pivot", "salt", "node", "packed", (F.col("node") != F.col("pivot")).alias("later"))
    rows = rows.repartition(n, "pivot", "salt").sortWithinPartitions("pivot", "salt", "later").drop("later")
    return rows.mapInArrow(_verifier(weights, similarity), "u long, v long")


class _Index:
    """The shingles of some texts, for their exact similarities to another one."""

    def __init__(self, nodes, roots, bands, grams, docs, times):
        self.nodes, self.roots, self.bands = np.asarray(nodes), np.asarray(roots), np.asarray(bands, np.int64).reshape(len(nodes), -1)
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.first = np.append(first, len(grams))
        self.docs, self.times = docs[order], times[order]
        self.totals = np.bincount(docs, times, len(nodes)).astype(np.int64)

    def links(self, bucket, root, bands, grams, times, similarity, upto) -> np.ndarray:
        """Which of the first `upto` texts are similar enough, of those in other components that meet in `bucket` first."""
        same = self.bands[:upto] == bands
        first = np.argmax(same, axis=1)
        total = int(times.sum())
        small, big = np.minimum(self.totals[:upto], total), np.maximum(self.totals[:upto], total)
        wanted = (self.roots[:upto] != root) & (self.bands[np.arange(upto), first] == bucket) & (small >= similarity * big - 1e-9)
        if not wanted.any():
            return np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = self.grams[place] == grams
        place, own = place[hit], times[hit]
        counts = self.first[place + 1] - self.first[place]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[place] - (ends - counts), counts)
        shared = np.bincount(self.docs[at], np.minimum(self.times[at], np.repeat(own, counts)), len(self.nodes))[:upto]
        return np.flatnonzero(wanted & (shared >= similarity * (self.totals[:upto] + total - shared) - 1e-9))


def _cell_verifier(weights: str, similarity: float):
    """Rows (bucket, a, b, later, node, root, bands, packed) by cell, its indexed side first: the links (u, v)."""

    def verify(batches):
        release_memory()
        load = _loader(weights)
        at, held, parts, index = None, [], [], None
        us, vs = [], []

        def probe(bucket, node, root, bands, grams, times, upto):
            for k in index.links(bucket, root, bands, grams, times, similarity, upto):
                us.append(int(index.nodes[k]))
                vs.append(node)

        def build():
            first = np.cumsum([0, *[n for _, _, _, n in parts]])
            flat = [np.concatenate(x) for x in zip(*[(g, d + k, t) for (g, d, t, _), k in zip(parts, first, strict=False)], strict=True)]
            return _Index(*[[h[i] for h in held] for i in range(3)], *flat), flat

        def end_cell():
            """Within a cell on the diagonal, each text is compared with those before it."""
            nonlocal index
            if at is not None and at[1] == at[2] and len(held) > 1:
                index, (grams, docs, times) = build()
                ends = np.searchsorted(docs, np.arange(len(held) + 1))
                for k in range(1, len(held)):
                    probe(at[0], held[k][0], held[k][1], index.bands[k], grams[ends[k] : ends[k + 1]], times[ends[k] : ends[k + 1]], k)

        for rows in _slices(batches, ("bucket", "a", "b", "later", "node", "root", "bands", "packed")):
            g, d, times, first = load(rows[-1])
            for k, (bucket, a, b, later, node, root, bands, _) in enumerate(zip(*rows, strict=True)):
                if (bucket, a, b) != at:
                    end_cell()
                    at, held, parts, index = (bucket, a, b), [], [], None
                own = slice(first[k], first[k + 1])
                if not later:
                    held.append((node, root, bands))
                    parts.append((g[own].copy(), d[own] - k, times[own].copy(), 1))
                elif held:
                    if index is None:
                        index, _ = build()
                    probe(bucket, node, root, np.asarray(bands, np.int64), g[own], times[own], len(held))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us, vs = [], []
        end_cell()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return verify


def _cells(members: DataFrame, roots: DataFrame) -> DataFrame:
    """`(bucket, a, b, later, node, root)`: every pair of a bucket's members in different components meets in one cell.

    The members outside a bucket's largest component are dealt to blocks by hash, and so are those inside it; a cell
    is two blocks or, on the diagonal, one.  Pairs inside the largest component need none.
    """
    labelled = members.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    sizes = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all")).where("all > most.n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    several = several.select("bucket", F.col("most.root").alias("largest"), blocks(F.col("all") - F.col("most.n")).alias("outer"), blocks(F.col("most.n")).alias("inner"))
    found = labelled.join(several, "bucket").withColumn("inside", F.col("root") == F.col("largest"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    found = found.withColumn("own", F.when(F.col("inside"), F.col("outer") + own).otherwise(own))
    met = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1))
    found = found.select("bucket", "node", "root", "own", F.explode(met).alias("other"))
    return found.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("later"), "node", "root")


def _cell_links(cells: DataFrame, signed: DataFrame, weights: str, similarity: float) -> DataFrame:
    """The links between texts that meet in a cell."""
    n = partitions_of(cells.sparkSession)
    texts = signed.select(F.col("row").alias("node"), "bands", "packed")
    rows = sized_join(texts, cells, ["node"], "inner").select("bucket", "a", "b", "later", "node", "root", "bands", "packed")
    rows = rows.repartition(n, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "later")
    return rows.mapInArrow(_cell_verifier(weights, similarity), "u long, v long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: str = "set", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: `doc_id, text_key, class_id, class_size, kept`.

    Documents link when the Jaccard similarity of their five-word shingles reaches `similarity`, and classes are
    linked documents; `class_id` is the smallest id of a class, whose row stays (of rows without any id or rows that
    repeat the smallest id, one stays).  Words are those of `lowered`.  Texts with the same words are copies; a text
    without words, null or empty, is a class of its own.  `text_key` is `xxhash64` of the text, to tell rows that
    repeat an id apart.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = own_rows(docs, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    signed = rows.mapInArrow(_signer(weights), _SIGNED)
    signed = cut(signed.select(F.monotonically_increasing_id().alias("row"), "*"))
    # Copies are one node, their first row; partial aggregation takes up a large group of copies.
    nodes = cut(signed.where("n_words > 0").groupBy("key1", "key2").agg(F.min("row").alias("node")))
    texts = signed.select(F.col("row").alias("node"), "packed")
    members = signed.select(F.col("row").alias("node"), "bands").join(nodes.select("node"), "node", "left_semi")
    members = members.select("node", F.explode("bands").alias("bucket"))
    orders = [F.min_by("node", F.xxhash64(F.lit(k), "node")).alias(f"p{k}") for k in range(PIVOTS)]
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *orders).where("n > 1")
    buckets = buckets.select("bucket", "n", F.array_distinct(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("pivots"))
    members = cut(members.join(buckets, "bucket"))

    # A node meets the same pivots in most of its buckets: they are gathered before they are paired.  Partners of a
    # pivot are dealt to salts that follow the size of the buckets, so that no pivot meets all of them in one task.
    met = members.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("pivots"))).alias("pivots"), F.max("n").alias("most"))
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("most") / SALT)).cast("int")
    tested = cut(met.select(F.explode("pivots").alias("pivot"), salt.alias("salt"), "node").where("pivot <> node"))
    roots = components(_links(tested, texts, weights, similarity))
    pairs = cut(_untested(members.where(F.col("n") <= SMALL).select("bucket", "node"), roots, tested))
    cells = cut(_cells(members.where(F.col("n") > SMALL), roots))
    more = [_links(pairs, texts, weights, similarity)] if not pairs.isEmpty() else []
    more += [_cell_links(cells, signed, weights, similarity)] if not cells.isEmpty() else []
    if more:
        roots = joined_components(roots, reduce(DataFrame.union, more))

    found = nodes.join(roots, "node", "left").select("key1", "key2", F.coalesce("root", "node").alias("root"))
    labelled = signed.select("row", "doc_id", "text_key", "n_words", "key1", "key2").join(found, ["key1", "key2"], "left")
    # A row without words has no node and is its own class.
    labelled = cut(labelled.select("row", "doc_id", "text_key", F.when(F.col("n_words") > 0, F.col("root")).otherwise(F.col("row")).alias("root")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    # Stored, so that the join is of two plain shuffles and the rows of a giant class may be split among tasks.
    classes = cut(labelled.groupBy("root").agg(first, F.count(F.lit(1)).alias("class_size")))
    out = labelled.join(classes, "root")
    return out.select("doc_id", "text_key", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"))


def _untested(members: DataFrame, roots: DataFrame, tested: DataFrame) -> DataFrame:
    """The pairs of a bucket that lie in different components and have not been tested, of buckets with few members."""
    labelled = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    several = labelled.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    there = labelled.join(several, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("node", "root")).alias("m"))  # at most SMALL
    one = lambda x: F.transform(F.filter("m", lambda y: (y["node"] > x["node"]) & (y["root"] != x["root"])), lambda y: F.struct(x["node"].alias("pivot"), y["node"].alias("node")))
    pairs = there.select(F.explode(F.flatten(F.transform("m", one))).alias("p")).select("p.pivot", "p.node").distinct()
    known = tested.select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node"))
    return pairs.join(known, ["pivot", "node"], "left_anti").select("pivot", F.lit(0).alias("salt"), "node")  # few partners each
