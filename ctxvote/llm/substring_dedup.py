"""Removal of long repeated byte strings by bucket-pointer refinement.

A byte goes when a string of `LENGTH` bytes that covers it also starts in a document with a smaller id.  To find
these strings without moving every suffix:

1. Documents are stored in batches of a few megabytes.  In each string of `LENGTH` bytes the `Q`-gram with the
   smallest hash is its anchor, so equal strings have equal anchors at equal places.  A batch sends each distinct
   anchor hash once to the bucket of its hash; anchors of one document only cannot lie in a repeat.
2. A batch sends each distinct neighbourhood (the bytes that strings around the anchor can reach) of its other
   anchors once, with the smallest document id that has it, to the bucket of the anchor.  Where they occur stays
   behind with the batch.
3. A bucket refines the suffixes of its neighbourhoods.  They fall into initial buckets by their first `STEP` bytes;
   then a suffix is sorted on the pair (its bucket number, the bucket number of the suffix `STEP` bytes later), which
   gives the buckets of twice as many bytes, and these numbers are reused in the same way, recursively, until they
   stand for `LENGTH` bytes.  No byte is looked at again after the initial buckets.  Neighbourhoods whose anchor stands
   alone drop out before.  In a final bucket, strings whose smallest document is another one are repeats.
4. The repeats go back to their batches, which cut them from the texts.

What is sent is bounded by a batch per hot string, since a batch speaks once for all its copies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import part_hashes, prefix_sums
from ._shared import byte_slices, cut, own_rows, partitions_of, text_runs

LENGTH = 50
Q = 16
#: Bytes of text in a batch, and bytes of text whose anchors or neighbourhoods share a bucket on average.
BATCH_BYTES = 2_000_000
BUCKET_BYTES = 16_000_000

_SIDE = LENGTH - Q  # bytes that a string can reach beyond its anchor on either side
_REACH = 2 * _SIDE + Q
_SEGMENT = 1 << 17

#: Bytes that the initial buckets stand for; neighbourhoods that are refined at once, cut between anchors.
STEP = 8
_AT_ONCE = 1 << 12


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The smallest (or largest) of each `width` neighbours, by doubling."""
    step = 1
    while 2 * step <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all strings of `LENGTH` bytes: ascending positions."""
    width, positions, hashes = LENGTH - Q + 1, [], []
    edge = np.zeros(width - 1, np.uint64)
    for at in range(0, max(len(text) - LENGTH + 1, 0), _SEGMENT):
        part = text[at : at + _SEGMENT + LENGTH - 1]
        grams = np.arange(len(part) - Q + 1)
        h = part_hashes(prefix_sums(part), grams, grams + Q)
        low = _sliding(h, width, np.minimum)
        # No window's minimum is above the hash of a gram that it holds, so the largest of them tells.
        found = np.flatnonzero(_sliding(np.concatenate([edge, low, edge]), width, np.maximum) == h)
        positions.append(found + at)
        hashes.append(h[found])
    if not positions:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    where, first = np.unique(np.concatenate(positions), return_index=True)  # segments overlap
    return where, np.concatenate(hashes)[first]


# ---- batches ---------------------------------------------------------------------------------------------------

_NO_ID = np.iinfo(np.int64).max


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.asarray([len(arrays), *[x for a in arrays for x in (a.dtype.num, a.size)]], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8).tolist(), 8 + 16 * n, []
    for kind, size in zip(head[::2], head[1::2], strict=True):
        t = np.dtype(_BY_NUM[kind])
        out.append(np.frombuffer(raw, t, size, at))
        at += size * t.itemsize
    return out


_BY_NUM = {np.dtype(t).num: t for t in (np.uint8, np.uint32, np.int32, np.int64, np.uint64)}


def _batched(limit: int):
    def run(batches):
        ids, texts, held = [], [], 0
        for batch in text_runs(batches, limit):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_slices(batch.column("text")), strict=True):
                if held and held + len(text) > limit:
                    yield _batch_row(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(_NO_ID if doc_id is None else doc_id)
                texts.append(bytes(text))
                held += len(text)
        if ids:
            yield _batch_row(ids, texts)

    return run


def _batch_row(ids, texts):
    data = b"".join(texts)
    packed = _pack(np.asarray(ids, np.int64), np.asarray([len(t) for t in texts], np.int64), np.frombuffer(data, np.uint8))
    return pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([len(data)], pa.int64())], ["packed", "n_bytes"])


class _Batch:
    """The documents of a batch, and its anchors that lie inside one document and some string of it."""

    def __init__(self, packed: bytes) -> None:
        self.ids, self.lengths, self.text = _unpack(packed)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def anchors(self) -> None:
        at, h = anchors(self.text)
        doc = np.searchsorted(self.starts, at, "right") - 1
        left = np.minimum(at - self.starts[doc], _SIDE)
        right = np.minimum(self.starts[doc + 1] - at - Q, _SIDE)
        good = (right >= 0) & (left + right >= _SIDE)
        self.at, self.h, self.doc, self.left, self.right = at[good], h[good], doc[good], left[good], right[good]
        self.distinct, self.of = np.unique(self.h, return_inverse=True)

    def buckets(self, n: int):
        """For each bucket, the numbers of its distinct hashes, ascending."""
        bucket = (self.distinct % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            yield int(bucket[order[a]]), order[a:b]


# ---- the three passes over the batches and the two over the buckets ----------------------------------------------


def _send_anchors(n: int):
    def run(batches):
        for b in batches:
            for batch, packed in zip(b.column("batch").to_pylist(), b.column("packed").to_pylist(), strict=True):
                own = _Batch(packed)
                own.anchors()
                rows = [(k, batch, (own.distinct[which] >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()) for k, which in own.buckets(n)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "batch", "hashes"])

    return run


def _by_bucket(work):
    """Applies `work` to the rows of each task as one table: a task has one bucket."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            yield from work(pa.Table.from_batches(batches).combine_chunks()).to_batches()

    return run


def _match_anchors(table: pa.Table) -> pa.Table:
    """Which hashes of each batch another batch has too, as bits."""
    raw = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in table.column("hashes").to_pylist()]
    sizes = [len(x) for x in raw]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :5] = np.concatenate(raw)
    _, of, count = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
    shared = np.split(count[of] > 1, np.cumsum(sizes)[:-1])
    bits = pa.array([np.packbits(x).tobytes() for x in shared], pa.binary())
    return pa.table([table.column("bucket"), table.column("batch"), bits], names=["bucket", "batch", "bits"])


def _send_neighbourhoods(n: int):
    def run(batches):
        for b in batches:
            for batch, packed, found in zip(*(b.column(c).to_pylist() for c in ("batch", "packed", "found")), strict=True):
                rows = [(k, batch, _pack(x.rows.ravel(), x.smallest)) for k, x in _neighbourhoods(_Batch(packed), found, n)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "batch", "payload"])

    return run


@dataclass
class _Found:
    """A batch's neighbourhoods in a bucket: the distinct ones, with the smallest id of each, and where they occur."""

    rows: np.ndarray
    smallest: np.ndarray
    at: np.ndarray  # places of the anchors of occurrences
    of: np.ndarray  # their neighbourhoods
    later: np.ndarray  # whether they stand in a document behind the smallest


def _neighbourhoods(own: _Batch, found: list, n: int) -> list[tuple[int, _Found]]:
    """The neighbourhoods of a batch by bucket; the same whenever the batch and `found` are."""
    own.anchors()
    if not len(own.at):
        return []
    bits = {x["bucket"]: x["bits"] for x in found}
    shared = np.zeros(len(own.distinct), bool)
    for k, which in own.buckets(n):
        shared[which] = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=len(which)).astype(bool)
    # Hashes that several documents of this batch have.
    low, high = np.full(len(own.distinct), len(own.ids)), np.full(len(own.distinct), -1)
    np.minimum.at(low, own.of, own.doc)
    np.maximum.at(high, own.of, own.doc)
    shared |= low != high
    used = np.flatnonzero(shared[own.of])
    if not len(used):
        return []
    at, left, right, ids = own.at[used], own.left[used], own.right[used], own.ids[own.doc[used]]
    text = np.concatenate([np.zeros(_SIDE, np.uint8), own.text, np.zeros(_SIDE, np.uint8)])
    rows = np.empty((len(used), _REACH + 2), np.uint8)
    rows[:, :_REACH] = np.lib.stride_tricks.sliding_window_view(text, _REACH)[at]
    place = np.arange(_REACH)
    rows[:, :_REACH][(place < _SIDE - left[:, None]) | (place >= _SIDE + Q + right[:, None])] = 0
    rows[:, _REACH], rows[:, _REACH + 1] = left, right
    _, first, of = np.unique(_row_keys(rows), return_index=True, return_inverse=True)
    smallest = np.full(len(first), _NO_ID)
    np.minimum.at(smallest, of, ids)
    bucket = (own.h[used][first] % np.uint64(n)).astype(np.int64)
    out, by_bucket = [], np.argsort(bucket, kind="stable")
    number = np.empty(len(first), np.int64)
    occurrences = np.argsort(bucket[of], kind="stable")
    occurrence_bucket = bucket[of][occurrences]
    for k in np.unique(bucket):
        which = by_bucket[np.searchsorted(bucket[by_bucket], k) : np.searchsorted(bucket[by_bucket], k, "right")]
        number[which] = np.arange(len(which))
        occ = occurrences[np.searchsorted(occurrence_bucket, k) : np.searchsorted(occurrence_bucket, k, "right")]
        later = ids[occ] > smallest[of[occ]]
        out.append((int(k), _Found(rows[first[which]], smallest[which], at[occ], number[of[occ]], later)))
    return out


def _row_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as numbers: equal rows, and only those, are equal."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    key = np.zeros(len(rows), np.int64)
    for word in padded.view(np.uint64).T:
        key = refine(key, word)
    return key


def refine(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket numbers refined by sorting on (bucket, what stands later): equal pairs, and only those, share a number."""
    order = np.lexsort((later, bucket))
    b, w = bucket[order], later[order]
    new = np.empty(len(order), np.int64)
    new[order] = np.cumsum(np.concatenate([[0], (b[1:] != b[:-1]) | (w[1:] != w[:-1])]))[: len(order)] if len(order) else 0
    return new


def suffix_buckets(text: np.ndarray, length: int) -> np.ndarray:
    """Bucket numbers of the strings of `length` bytes from each place of each row on, by bucket-pointer refinement.

    `text` has rows of equal size.  The number of a place is refined by that of a later place of its row, whose own
    number is the result of the step before.
    """
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, STEP, axis=1)).view(np.uint64)[:, :, 0]
    bucket = _numbered(words)  # the initial buckets
    done = STEP
    while done < length:
        offset = min(done, length - done)  # the last step overlaps the one before
        width = text.shape[1] - (done + offset) + 1
        pair = bucket[:, :width] * np.int64(bucket.max() + 1) + bucket[:, offset : offset + width]
        bucket = _numbered(pair)
        done += offset
    return bucket


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Equal keys, and only those, share a number; the numbers are in the order of the keys."""
    flat = keys.ravel()
    order = np.argsort(flat)
    in_order = flat[order]
    out = np.empty(len(flat), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], in_order[1:] != in_order[:-1]]))
    return out.reshape(keys.shape)


def repeat_masks(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each neighbourhood, bit a: the string that starts a bytes before the anchor is in one with a smaller id.

    Equal neighbourhoods are refined once; those behind the smallest of them repeat it in full.
    """
    _, first, of = np.unique(_row_keys(rows), return_index=True, return_inverse=True)
    smallest = np.full(len(first), _NO_ID)
    np.minimum.at(smallest, of, ids)
    masks = _distinct_masks(rows[first], smallest)[of]
    again = np.flatnonzero(ids > smallest[of])
    masks[again] = _whole(rows[again])
    return masks


def _distinct_masks(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """`repeat_masks` of neighbourhoods that are all different."""
    masks = np.zeros(len(rows), np.uint64)
    anchor = _row_keys(np.ascontiguousarray(rows[:, _SIDE : _SIDE + Q]))
    order = np.argsort(anchor, kind="stable")
    sizes = np.bincount(anchor)
    order = order[sizes[anchor[order]] > 1]
    starts = np.flatnonzero(np.diff(anchor[order], prepend=-1))
    first = 0
    while first < len(order):  # whole anchors, about `_AT_ONCE` neighbourhoods
        k = np.searchsorted(starts, first + _AT_ONCE)
        last = starts[k] if k < len(starts) else len(order)
        some = order[first:last]
        some = some[np.argsort(ids[some], kind="stable")]
        masks[some] = _refined(rows[some], ids[some])
        first = int(last)
    return masks


def _refined(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """`repeat_masks` of neighbourhoods with ascending ids."""
    left, right = rows[:, _REACH].astype(np.int64)[:, None], rows[:, _REACH + 1].astype(np.int64)[:, None]
    before = _SIDE - np.arange(_SIDE + 1)  # of a string that starts at a place: its bytes before the anchor
    whole = (left >= before) & (right >= _SIDE - before)
    bucket = suffix_buckets(rows[:, :_REACH], LENGTH)[whole]
    of, a = np.nonzero(whole)
    order = np.argsort(bucket, kind="stable")  # within a bucket, ids ascend
    b, doc = bucket[order], ids[of[order]]
    first = np.concatenate([[True], b[1:] != b[:-1]])[: len(b)]
    again = order[doc > doc[first][np.cumsum(first) - 1]] if len(b) else order
    masks = np.zeros((len(rows), _SIDE + 1), bool)
    masks[of[again], before[a[again]]] = True
    return (masks.astype(np.uint64) << np.arange(_SIDE + 1, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _refine_bucket(table: pa.Table) -> pa.Table:
    """The masks of each batch's neighbourhoods."""
    parts = [_unpack(x) for x in table.column("payload").to_pylist()]
    masks = repeat_masks(np.concatenate([p[0].reshape(-1, _REACH + 2) for p in parts]), np.concatenate([p[1] for p in parts]))
    sizes = [len(p[1]) for p in parts]
    out = [_pack(masks[e - n : e]) for e, n in zip(np.cumsum(sizes), sizes, strict=True)]
    return pa.table([table.column("batch"), table.column("bucket"), pa.array(out, pa.binary())], names=["batch", "bucket", "masks"])


def _whole(rows: np.ndarray) -> np.ndarray:
    """The masks of all strings that a neighbourhood holds whole."""
    a = np.arange(_SIDE + 1, dtype=np.int64)
    whole = (rows[:, _REACH, None] >= a) & (rows[:, _REACH + 1, None] >= _SIDE - a)
    return (whole.astype(np.uint64) << a.astype(np.uint64)).sum(axis=1, dtype=np.uint64)


def _cut_batches(n: int):
    def run(batches):
        for b in batches:
            for packed, found, masks in zip(*(b.column(c).to_pylist() for c in ("packed", "found", "masks")), strict=True):
                yield _cut_batch(_Batch(packed), found, {x["bucket"]: x["masks"] for x in masks or []}, n)

    return run


def _cut_batch(own: _Batch, found: list | None, masks: dict[int, bytes], n: int) -> pa.RecordBatch:
    """The texts of a batch without what `masks` mark, whose numbers are those of its neighbourhoods by bucket."""
    edge = np.zeros(len(own.text) + 1, np.int32)
    for k, x in _neighbourhoods(own, found, n) if masks else []:
        # Occurrences in a document behind the smallest of their own batch repeat their neighbourhood in full.
        mask = np.where(x.later, _whole(x.rows)[x.of], _unpack(masks[k])[0][x.of])
        at, mask = x.at[mask != 0], mask[mask != 0]
        for a in range(_SIDE + 1):
            here = at[(mask >> np.uint64(a) & np.uint64(1)).astype(bool)] - a
            np.add.at(edge, here, 1)
            np.add.at(edge, here + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans, kept = [], []
    for s, size in zip(own.starts.tolist(), own.lengths.tolist(), strict=False):
        here = gone[s : s + size]
        if not here.any():
            spans.append([])
            kept.append(own.text[s : s + size].tobytes())
            continue
        change = np.flatnonzero(np.diff(here.astype(np.int8), prepend=0, append=0))
        spans.append([{"start": x, "end": y} for x, y in zip(change[::2].tolist(), change[1::2].tolist(), strict=True)])
        kept.append(own.text[s : s + size][~here].tobytes())
    ids = pa.array([None if x == _NO_ID else x for x in own.ids.tolist()], pa.int64())
    return pa.RecordBatch.from_arrays([ids, pa.array(own.lengths), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per input row: `doc_id, n_bytes, spans, kept`.

    `spans` are the maximal removed runs (UTF-8 byte offsets, end exclusive), judged on the input; `kept` the remaining
    bytes.  Null and empty texts have no bytes; a text shorter than `LENGTH` bytes loses none.  Rows with the same id
    take nothing from each other; rows without an id count as larger than all ids.  An empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    rows = own_rows(docs, id_col, text_col).mapInArrow(_batched(batch_bytes), "packed binary, n_bytes long")
    stored = cut(rows.select(F.monotonically_increasing_id().alias("batch"), "packed", "n_bytes"))
    total = stored.agg(F.sum("n_bytes")).first()[0] or 0
    n = max(partitions_of(spark), -(-total // BUCKET_BYTES))
    batches = stored.select("batch", "packed")
    sent = batches.mapInArrow(_send_anchors(n), "bucket long, batch long, hashes binary")
    bits = _in_buckets(sent, n).mapInArrow(_by_bucket(_match_anchors), "bucket long, batch long, bits binary")
    bits = cut(bits.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias("found")))  # a bit per anchor of a batch
    sent = batches.join(bits, "batch").mapInArrow(_send_neighbourhoods(n), "bucket long, batch long, payload binary")
    masks = _in_buckets(sent, n).mapInArrow(_by_bucket(_refine_bucket), "batch long, bucket long, masks binary")
    masks = masks.groupBy("batch").agg(F.collect_list(F.struct("bucket", "masks")).alias("masks"))  # a mask per neighbourhood of a batch
    # A batch finds its neighbourhoods again: that costs less than to keep or to move where they occur.
    whole = batches.join(bits, "batch", "left").join(masks, "batch", "left")
    return whole.mapInArrow(_cut_batches(n), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _in_buckets(sent: DataFrame, n: int) -> DataFrame:
    """One bucket a task."""
    return sent.repartitionById(n, F.col("bucket").cast("int"))
