"""Packing token ids into windows by minimum bin slack.

Every document gives its whole windows first; what remains of it, shorter than a window, is an item.  Only the
histogram of item lengths goes to the driver: at most `window - 1` counts whatever the corpus.  There, the longest
remaining length opens a window and a bitset subset-sum dynamic program over the multiset of remaining lengths
finds the fill closest to capacity, whose counts are read back from the bitsets.  A pattern is used as often as
its counts allow.  Where the best fill leaves slack, one item is cut to fill it, so that the last window alone is
padded.  The resulting plan has a number of rows that depends on the window only; documents find their place in it
by their length and their rank among documents of that length.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, own_rows
from .tokens import encoded_rows

_PLAN = "left_over int, rank_lo long, rank_hi long, at int, length int, phase long, per_sequence long, first_sequence long, first_offset long"


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most `counts` of each, whose sum is closest to `capacity` from below.

    Longer lengths are tried first; the search ends as soon as the capacity itself is reached.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, power = min(counts[length], capacity // length), 1
        while left > 0:
            n = min(power, left)
            steps.append((length, n, reach))
            reach |= (reach << (n * length)) & full
            left, power = left - n, power * 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:  # this step must have been taken
            used[length] = used.get(length, 0) + n
            total -= n * length
    return used


class _Stock:
    """Items by length: each length holds runs of (left over, ranks lo to hi, ids already placed)."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.runs = {x: deque([(x, 0, n, 0)]) for x, n in histogram.items()}
        self.counts = dict(histogram)

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        out, runs = [], self.runs[length]
        self.counts[length] -= n
        while n:
            left_over, lo, hi, at = runs.popleft()
            got = min(n, hi - lo)
            out.append((left_over, lo, lo + got, at))
            if lo + got < hi:
                runs.appendleft((left_over, lo + got, hi, at))
            n -= got
        if not self.counts[length]:
            del self.counts[length]
        return out

    def put(self, left_over: int, rank: int, at: int) -> None:
        length = left_over - at
        self.runs.setdefault(length, deque()).append((left_over, rank, rank + 1, at))
        self.counts[length] = self.counts.get(length, 0) + 1


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """The rows of `_PLAN` for a histogram of item lengths under `window`.

    A row places the items `rank_lo` to `rank_hi` of a length `left_over`, from their id `at` on, `length` ids each;
    the item of rank r is number k = phase + r - rank_lo of its pattern: `per_sequence` of them stand in each
    sequence, from `first_sequence` on, the first at `first_offset`.
    """
    stock, rows, sequence = _Stock(histogram), [], 0
    while stock.counts:
        longest = max(stock.counts)
        stock.counts[longest] -= 1
        used = best_fill({k: v for k, v in stock.counts.items() if v}, window - longest)
        stock.counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        slack = window - sum(k * v for k, v in used.items())
        times = 1 if slack else min(stock.counts[k] // v for k, v in used.items())
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            phase = 0
            for left_over, lo, hi, at in stock.take(length, n * times):
                rows.append((left_over, lo, hi, at, length, phase, n, sequence, offset))
                phase += hi - lo
            offset += n * length
        if slack and stock.counts:  # every length left is longer than the slack, else it would have been used
            [(left_over, rank, _, at)] = stock.take(min(stock.counts), 1)
            rows.append((left_over, rank, rank + 1, at, slack, 0, 1, sequence, offset))
            stock.put(left_over, rank, at + slack)
        sequence += times
    return rows


def encode_documents(docs: DataFrame, tokenizer: str | None, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(row, doc_id, n, ids)` in the shared folder: each input row's ids with `end_id`, compressed, under a row number."""
    run = encoded_rows(docs.sparkSession, tokenizer, end_id)

    def encode(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for batch, ids in run(batches):
            narrow = [np.frombuffer(x, "<u4") for x in ids]
            narrow = [x.astype("<u2") if not len(x) or x.max() < 1 << 16 else x for x in narrow]
            packed = [bytes([x.itemsize]) + z.compress(x.tobytes()) for x in narrow]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in narrow], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "ids"])

    encoded = own_rows(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n long, ids binary")
    return cut(encoded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n", "ids"))


def unpack_ids(packed: bytes) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed[1:])
    return raw if packed[0] == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def pack(docs: DataFrame, window: int = 2048, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: `doc_id, start, length, ids, doc_tokens, sequence_id, offset`; ids are u32 little-endian.

    Each id of each row (its text's ids, then `end_id`) lies in exactly one piece; pieces fill sequences of at most
    `window` ids without gaps, and all sequences but one are full.  Null and empty texts have `end_id` alone; rows
    that repeat an id are packed each; rows without an id are packed under a null id; an empty table gives no
    pieces; other columns are not read.
    """
    spark = docs.sparkSession
    encoded = encode_documents(docs, tokenizer, end_id, id_col, text_col)
    part = F.shiftright("row", 33).alias("part")
    lens = encoded.select("row", part, "n", F.floor(F.col("n") / window).alias("full"), (F.col("n") % window).cast("int").alias("left_over"))
    # Ranks and running sums: within a partition of the stored rows, and over one row per partition.
    by_part = lens.groupBy("part").agg(F.sum("full").alias("here"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("part_sequence"))
    by_length = lens.where("left_over > 0").groupBy("left_over", "part").agg(F.count(F.lit(1)).alias("here"))
    of_length = Window.partitionBy("left_over").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_length = cut(by_length.select("left_over", "part", "here", F.coalesce(F.sum("here").over(of_length), F.lit(0)).alias("part_rank")))
    histogram = {r.left_over: r.n for r in by_length.groupBy("left_over").agg(F.sum("here").alias("n")).collect()}  # under `window` rows
    rows = plan(histogram, window)
    planned = F.broadcast(spark.createDataFrame(rows, _PLAN).coalesce(1))  # its size depends on `window` only
    total_full = lens.agg(F.sum("full")).first()[0] or 0

    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    whole = lens.where("full > 0").select("row", "part", F.coalesce(F.sum("full").over(within), F.lit(0)).alias("ahead"))
    whole = whole.join(by_part, "part").select("row", (F.col("part_sequence") + F.col("ahead")).alias("first_full"))
    ranked = lens.where("left_over > 0").select("row", "part", "n", "left_over", (F.row_number().over(Window.partitionBy("part", "left_over").orderBy("row")) - 1).alias("r"))
    ranked = ranked.join(by_length.select("left_over", "part", "part_rank"), ["left_over", "part"])
    ranked = ranked.withColumn("r", F.col("r") + F.col("part_rank")).join(planned, "left_over").where("r >= rank_lo and r < rank_hi")
    k = F.col("phase") + F.col("r") - F.col("rank_lo")
    piece = F.struct(
        (F.col("n") - F.col("left_over") + F.col("at")).cast("long").alias("start"),
        F.col("length").cast("long").alias("length"),
        (F.lit(total_full) + F.col("first_sequence") + F.floor(k / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (k % F.col("per_sequence")) * F.col("length")).cast("long").alias("offset"),
    )
    placed = ranked.groupBy("row").agg(F.collect_list(piece).alias("pieces"))  # a row has few pieces, at most one for each cut
    placed = placed.join(whole, "row", "full")

    def give(batches):
        for batch in batches:
            ids, out = [], {c: [] for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")}
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "pieces", "first_full")), strict=True)
            for k, (doc_id, n, packed, pieces, first_full) in enumerate(rows):
                raw = unpack_ids(packed)
                found = [(j * window, window, first_full + j, 0) for j in range(n // window)]
                found += [(p["start"], p["length"], p["sequence_id"], p["offset"]) for p in pieces or ()]
                for start, length, sequence, offset in found:
                    ids.append(raw[4 * start : 4 * (start + length)])
                    for c, v in zip(out, (doc_id, start, length, n, sequence, offset), strict=True):
                        out[c].append(v)
                if len(ids) >= 1000 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *[pa.array(v, pa.int64()) for v in out.values()]], ["ids", *out])
                    ids, out = [], {c: [] for c in out}

    return encoded.join(placed, "row").mapInArrow(give, "ids binary, doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long")
