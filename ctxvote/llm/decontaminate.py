"""Benchmark decontamination: a broadcast set of normalised benchmark windows, scanned by every document.

A word is a run of digits, letters and non-ASCII characters, with A to Z in lower case.  A window is ten
consecutive words of a benchmark item; an item of fewer words, but not none, is one window.  Workers hash the
documents' windows, look them up among the benchmark's, and verify each hit word by word.  A benchmark beyond
`BLOCK_BYTES` of text is scanned block by block, so what is broadcast has a fixed bound; a third of all rows with one
passage costs no more than other rows, since nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import joined_docs, lowered, window_hashes, word_hashes
from ._shared import byte_slices, cut, keep_rows, own_rows, text_runs

WINDOW = 10
#: Benchmark text held by a worker at once.
BLOCK_BYTES = 16_000_000

_FOUND = "doc_id long, text string, n_words long, hits array<struct<start:long,end:long>>, items array<string>"


def benchmark_windows(items: list[tuple[str, str]], window: int = WINDOW) -> dict[int, tuple[np.ndarray, np.ndarray, dict[bytes, tuple[str, ...]]]]:
    """By window length: a bitmap of the hashes' upper 16 bits, the sorted hashes, and the windows' words with their items."""
    exact: dict[int, dict[bytes, set[str]]] = {}
    hashes: dict[int, list[np.ndarray]] = {}
    for item_id, text in items:
        low = lowered(text.encode())
        words = low.split()
        if not words:
            continue
        length = min(window, len(words))
        for i in range(len(words) - length + 1):
            exact.setdefault(length, {}).setdefault(b" ".join(words[i : i + length]), set()).add(item_id)
        hashes.setdefault(length, []).append(window_hashes(word_hashes(low)[0], length))
    out = {}
    for length, found in exact.items():
        known = np.unique(np.concatenate(hashes[length]))
        bitmap = np.zeros(1 << 16, bool)
        bitmap[(known >> np.uint64(48)).astype(np.int64)] = True
        out[length] = (bitmap, known, {k: tuple(sorted(v)) for k, v in found.items()})
    return out


def _broadcast_blocks(spark, benchmark: DataFrame, window: int, item_col: str, item_text_col: str):
    """Broadcasts of the windows of parts of the benchmark that hold about `BLOCK_BYTES` of text each, and whether it is the last."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield spark.sparkContext.broadcast(benchmark_windows([(r.item_id, r.text) for r in block.collect()], window)), k == n - 1


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", texts: bool = True) -> DataFrame:
    """One row per input row: `doc_id, text, n_words, hits, items`; without `texts` the text stays where it was read.

    `hits` are maximal runs of hit words (word positions, end exclusive), in order; `items` the ids, as strings, of
    the items with a window in the document, sorted.  Null and empty texts have no words and no hits; an item
    without words has no window, one without an id counts under the empty string; an empty benchmark hits nothing;
    rows that repeat an id are separate rows; other columns are not read.
    """
    spark = docs.sparkSession
    found = own_rows(docs, id_col, text_col).select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,end:long>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for known, last in _broadcast_blocks(spark, benchmark, window, item_col, item_text_col):
        carried = texts or not last
        found = found.mapInArrow(_scanner(known, carried), _FOUND if carried else _FOUND.replace("text string, ", ""))
        found = found if last else cut(found)  # one block's windows at a time in a worker
    return found


def scan_texts(texts: list[bytes], windows) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """(first word of each text and the end, whether each word is hit, items by text) of lowered texts."""
    low, starts = joined_docs(texts)
    hashes, word_starts, word_ends = word_hashes(low)
    first = np.searchsorted(word_starts, starts)
    marks = np.zeros(len(hashes) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for length, (bitmap, sorted_hashes, exact) in windows.items():
        h = window_hashes(hashes, length)
        maybe = np.flatnonzero(bitmap[(h >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(sorted_hashes, h[maybe])
        maybe = maybe[sorted_hashes[np.minimum(at, len(sorted_hashes) - 1)] == h[maybe]]
        for i in maybe.tolist():
            doc = int(np.searchsorted(first, i, "right")) - 1
            if i + length > first[doc + 1]:
                continue  # the window would run into the next text
            key = b" ".join(low[word_starts[i + j] : word_ends[i + j]] for j in range(length))
            if key in exact:
                marks[i] += 1
                marks[i + length] -= 1
                items.setdefault(doc, set()).update(exact[key])
    return first, np.cumsum(marks[:-1]) > 0, items


def _scanner(known, carried: bool):
    def scan(batches):
        windows = known.value
        for batch in text_runs(batches):
            first, hit, items = scan_texts([lowered(bytes(t)) for t in byte_slices(batch.column("text"))], windows)
            old_hits, old_items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            new_hits = []
            for d in range(batch.num_rows):
                if d not in items:
                    new_hits.append(old_hits[d])
                    continue
                here = hit[first[d] : first[d + 1]]
                for x in old_hits[d]:
                    here[x["start"] : x["end"]] = True
                edge = np.flatnonzero(np.diff(here.astype(np.int8), prepend=0, append=0))
                new_hits.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            new_items = [sorted(items[d].union(old_items[d])) if d in items else old_items[d] for d in range(batch.num_rows)]
            spans = pa.array(new_hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            out = {"doc_id": batch.column("doc_id"), **({"text": batch.column("text")} if carried else {}), "n_words": pa.array(np.diff(first)), "hits": spans, "items": pa.array(new_items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return scan


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, in which no window of the benchmark occurs."""
    spark, kept = docs.sparkSession, docs
    for known, last in _broadcast_blocks(spark, benchmark, window, item_col, item_text_col):

        def clean(texts: list[bytes], known=known) -> list[bool]:
            out, at = [True] * len(texts), 0
            while at < len(texts):  # a bounded number of bytes at a time
                stop, held = at, 0
                while stop < len(texts) and (stop == at or held + len(texts[stop]) <= 1 << 21):
                    held += len(texts[stop])
                    stop += 1
                for d in scan_texts([lowered(t) for t in texts[at:stop]], known.value)[2]:
                    out[at + d] = False
                at = stop
            return out

        kept = keep_rows(kept, clean, text_col)
        kept = kept if last else cut(kept)
    return kept


def remove_spans(found: DataFrame) -> DataFrame:
    """`doc_id, text`: the rows of `find_contamination` without the text of their hit words."""

    def clean(batches):
        for batch in batches:
            texts = []
            for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                raw = text.encode()
                _, starts, ends = word_hashes(lowered(raw))
                kept, at = [], 0
                for x in hits:
                    kept.append(raw[at : starts[x["start"]]])
                    at = ends[x["end"] - 1]
                texts.append(b"".join([*kept, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return found.mapInArrow(clean, "doc_id long, text string")


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
