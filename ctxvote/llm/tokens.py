"""Token ids of whole texts by the `tokenizers` library, with a bounded cache of encoded units.

A byte-level BPE encodes the units of its pre-tokenizer apart.  A run of texts is cut into units at once by byte classes;
the units of the run are looked up in a cache, the library encodes those that are missing once each, and the ids of the
texts are gathered.  Where a text holds characters that are not classed here (white space other than spaces and
line feeds, control characters, rare or new ones), everything up to the next safe cuts is one unit that the library
splits itself.  A cut is safe before a space between two visible characters that are classed.  Vocabularies with other
pre-tokenizers get whole texts.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Units kept by a worker (about 70 bytes each, those over `KEY_BYTES` are not kept); the least recently used half goes.
CACHE_UNITS, KEY_BYTES = 1_000_000, 23
#: Units that the library gets as one text: short texts keep within the processor's caches.
SPACED_UNITS = 200
#: Bytes of text that are cut into units at once.
RUN_BYTES = 1 << 21

_ODD, _LETTER, _NUMBER, _MARK, _SPACE, _FEED = range(6)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point below 65,536; characters whose class changed over time are odd."""
    out = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        now, then = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
        if now[0] in "LN" and then[0] == now[0]:
            out[code] = _LETTER if now[0] == "L" else _NUMBER
        elif now[0] in "MPS" and then[0] in "MPS":
            out[code] = _MARK
    out[0x20], out[0x0A] = _SPACE, _FEED
    return out


def byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of the character that each byte belongs to, whether a byte begins one)."""
    table = _classes()
    out = table[:256][data]
    out[data >= 0x80] = _ODD
    begins = (data & 0xC0) != 0x80
    two = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] < 0xE0)) if len(data) else np.zeros(0, np.int64)
    if len(two):
        c = table[((data[two] & 0x1F).astype(np.int64) << 6) | (data[two + 1] & 0x3F)]
        out[two], out[two + 1] = c, c
    three = np.flatnonzero((data[:-2] >= 0xE0) & (data[:-2] < 0xF0)) if len(data) > 1 else np.zeros(0, np.int64)
    if len(three):
        c = table[((data[three] & 0x0F).astype(np.int64) << 12) | ((data[three + 1] & 0x3F).astype(np.int64) << 6) | (data[three + 2] & 0x3F)]
        out[three], out[three + 1], out[three + 2] = c, c, c
    return out, begins


def unit_starts(data: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the units of texts that stand one after another, whether each unit is a space and visible characters).

    `doc_starts` ascend; a text may be empty.
    """
    n = len(data)
    kind, begins = byte_classes(data)
    first = np.zeros(n + 1, bool)
    first[doc_starts[doc_starts < n]] = True
    first[n] = True
    before = np.empty(n, np.uint8)  # the class before each byte, _ODD + 100 where a text begins
    before[:1] = 100
    before[1:] = kind[:-1]
    before[first[:n]] = 100
    after = np.empty(n, np.uint8)
    after[-1:] = 100
    after[:-1] = kind[1:]
    after[first[1:]] = 100
    visible = (kind >= _LETTER) & (kind <= _MARK)
    seen_after = (after >= _LETTER) & (after <= _MARK)
    seen_before = (before >= _LETTER) & (before <= _MARK)
    start = visible & begins & (before != kind) & (before != _SPACE)
    blank = (kind == _SPACE) | (kind == _FEED)
    blank_before = (before == _SPACE) | (before == _FEED)
    # White space: its run begins a unit; so does its last character if something visible follows.
    start |= blank & (~blank_before | seen_after)
    # A mark ' that begins a unit takes s, t, m, d, re, ve or ll with it.
    marks = np.flatnonzero(start & (data == 0x27) & (after == _LETTER))
    if len(marks):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b = padded[marks + 1], padded[marks + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)) & ~first[np.minimum(marks + 2, n)]
        taken = marks[one | two]
        end = taken + np.where(one[one | two], 2, 3)
        start[taken + 1] = False
        end = end[end < n]
        start[end[kind[end] == _LETTER]] = True
    start |= first[:n]
    safe = (kind == _SPACE) & seen_before & seen_after  # a cut here parts units, whatever stands elsewhere
    odd = kind == _ODD
    if odd.any():
        zone = np.cumsum(safe | first[:n])
        spoilt = np.zeros(zone[-1] + 1, bool)
        spoilt[zone[odd]] = True
        start &= ~spoilt[zone] | safe | first[:n]
    at = np.flatnonzero(start)
    plain = (kind[at] == _SPACE) & seen_after[at]
    if odd.any():
        plain &= ~spoilt[zone[at]]
    return at, plain


class UnitTable:
    """Numbers (0, 1, ...) of units of at most `KEY_BYTES` bytes: open addressing, and the keys hold the bytes themselves."""

    def __init__(self) -> None:
        self.keys = [np.zeros(0, np.uint64)] * 3
        self._place(16)

    def __len__(self) -> int:
        return len(self.keys[0])

    @staticmethod
    def keys_of(raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Three words for each unit, its bytes with its length as the last one; units must not be longer than fits."""
        padded = np.concatenate([raw, np.zeros(KEY_BYTES + 1, np.uint8)])
        words = np.ndarray((len(raw) + KEY_BYTES - 6,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        masks = np.asarray([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        keys = [words[at + first] & masks[np.clip(sizes - first, 0, 8)] for first in (0, 8, 16)]
        keys[2] |= sizes.astype(np.uint64) << np.uint64(56)
        return keys

    def _slots_of(self, keys: list[np.ndarray]) -> np.ndarray:
        h = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        for key, factor in zip(keys[1:], (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), strict=True):
            h ^= h >> np.uint64(31)
            h += key
            h *= np.uint64(factor)
        h ^= h >> np.uint64(31)
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """The number of each unit, -1 for those that are missing."""
        out = np.full(len(keys[0]), -1, np.int64)
        left, slots = np.arange(len(out)), self._slots_of(keys)
        while len(self) and len(left):
            number = self.slots[slots]
            same = number >= 0
            again = same.copy()
            for own, key in zip(self.keys, keys, strict=True):
                same &= own[number] == key
            out[left[same]] = number[same]
            again &= ~same
            left, slots, keys = left[again], (slots[again] + 1) & (len(self.slots) - 1), [k[again] for k in keys]
        return out

    def add(self, keys: list[np.ndarray]) -> None:
        """Number units that differ and are missing."""
        first = len(self)
        self.keys = [np.concatenate([own, key]) for own, key in zip(self.keys, keys, strict=True)]
        if 2 * len(self) > len(self.slots):
            self._place(4 * len(self))
        else:
            self._fill(first)

    def keep(self, numbers: np.ndarray) -> None:
        """Forget all units but these, which are numbered anew in their order."""
        self.keys = [k[numbers] for k in self.keys]
        self._place(len(self.slots))

    def _place(self, room: int) -> None:
        self.slots = np.full(1 << (room - 1).bit_length(), -1, np.int32)
        self._fill(0)

    def _fill(self, first: int) -> None:
        number = np.arange(first, len(self), dtype=np.int32)
        slots = self._slots_of([k[first:] for k in self.keys])
        while len(number):
            free = np.flatnonzero(self.slots[slots] < 0)
            self.slots[slots[free]] = number[free]  # of several units for a slot one stays
            left = self.slots[slots] != number
            number, slots = number[left], (slots[left] + 1) & (len(self.slots) - 1)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, vocabulary: str, cache_units: int = CACHE_UNITS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        shown = str(self.tokenizer.pre_tokenizer)
        self.by_unit = shown.startswith("ByteLevel(") and "add_prefix_space=False" in shown and "use_regex=True" in shown and self.tokenizer.normalizer is None
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of each token: its characters stand for them
        for token, number in self.tokenizer.get_vocab().items():
            self.size[number] = len(token)
        self.cache_units = cache_units
        self.units = UnitTable()  # the cache; its arrays are in the order of the numbers
        self.pool, self.at, self.used, self.now = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32), 0

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _encode_spaced(self, units: pa.LargeBinaryArray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of units that begin with a space, encoded in long runs and parted by the bytes of the tokens."""
        ids, counts = [], []
        ends = np.frombuffer(units.buffers()[1], np.int64)[units.offset : units.offset + len(units) + 1]
        data = memoryview(units.buffers()[2] or b"")
        for at in range(0, len(units), SPACED_UNITS):
            own = ends[at : at + SPACED_UNITS + 1]
            found = np.asarray(self.tokenizer.encode_batch_fast([str(data[own[0] : own[-1]], "utf-8")], add_special_tokens=False)[0].ids, np.uint32)
            last = np.searchsorted(np.cumsum(self.size[found]), own[1:] - own[0]) + 1
            ids.append(found)
            counts.append(np.diff(last, prepend=0))
        return ids, counts

    def _encode_missing(self, units: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of units in their order."""
        order = np.argsort(~plain, kind="stable")
        n_plain = int(plain.sum())
        ids, counts = self._encode_spaced(units.take(pa.array(order[:n_plain])))
        others = [x.decode("utf-8", "replace") for x in units.take(pa.array(order[n_plain:])).to_pylist()]
        for i in range(0, len(others), 4000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(others[i : i + 4000], add_special_tokens=False)]
            ids += [np.asarray(x, np.uint32) for x in found]
            counts.append(np.asarray([len(x) for x in found], np.int64))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        lens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        ends = np.cumsum(lens)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return _gather(flat, (ends - lens)[back], lens[back])

    def _keep(self, keys: list[np.ndarray], pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> None:
        """Add units and their ids to the cache."""
        ids, ends = _gather(pool, starts, lens)
        self.units.add(keys)
        self.pool, self.at = np.concatenate([self.pool, ids]), np.concatenate([self.at, self.at[-1] + ends])
        self.used = np.concatenate([self.used, np.full(len(starts), self.now, np.int32)])
        if len(self.used) > self.cache_units:
            stay = np.sort(np.argsort(-self.used, kind="stable")[: self.cache_units // 2])
            self.units.keep(stay)
            self.used = self.used[stay]
            self.pool, ends = _gather(self.pool, self.at[stay], np.diff(self.at)[stay])
            self.at = np.append(0, ends)

    def _encode_run(self, data: bytes, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts that stand one after another, how many come before each text)."""
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(doc_starts), np.int64)
        self.now += 1
        at, plain = unit_starts(raw, doc_starts)
        sizes = np.diff(at, append=len(raw))
        short = np.flatnonzero(sizes <= KEY_BYTES)
        keys = self.units.keys_of(raw, at[short], sizes[short])
        number = np.full(len(at), -1, np.int64)
        number[short] = self.units.find(keys)
        hit = number >= 0
        self.used[number[hit]] = self.now
        miss = np.flatnonzero(~hit)
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(np.int64)), pa.py_buffer(data)])
        coded = units.take(pa.array(miss)).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        is_plain = np.zeros(len(coded.dictionary), bool)
        is_plain[codes[plain[miss]]] = True
        is_plain[codes[~plain[miss]]] = False  # a unit of both kinds is encoded by itself
        ids, ends = self._encode_missing(coded.dictionary, is_plain)
        counts = np.diff(ends, prepend=0)
        starts, lens = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        starts[hit], lens[hit] = self.at[number[hit]], self.at[number[hit] + 1] - self.at[number[hit]]
        starts[miss], lens[miss] = len(self.pool) + (ends - counts)[codes], counts[codes]
        pool = np.concatenate([self.pool, ids])
        where = np.empty(len(counts), np.int64)
        where[codes[::-1]] = miss[::-1]  # the first place of each missing unit
        where = where[sizes[where] <= KEY_BYTES]
        among = np.searchsorted(short, where)
        self._keep([k[among] for k in keys], pool, starts[where], lens[where])
        ids, ends = _gather(pool, starts, lens)
        return ids, np.append(0, ends)[np.searchsorted(at, doc_starts)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8)."""
        if not self.by_unit:
            return [self.whole(bytes(t).decode("utf-8", "replace")) for t in texts]
        parts: list[bytes] = []
        of: list[int] = []
        for k, text in enumerate(texts):
            for part in safe_parts(bytes(text), RUN_BYTES):
                parts.append(part)
                of.append(k)
        out: list[list[bytes]] = [[] for _ in texts]
        first = 0
        while first < len(parts):
            last, held = first, 0
            while last < len(parts) and (last == first or held + len(parts[last]) <= RUN_BYTES):
                held += len(parts[last])
                last += 1
            sizes = np.asarray([len(p) for p in parts[first:last]], np.int64)
            ids, starts = self._encode_run(b"".join(parts[first:last]), np.cumsum(sizes) - sizes)
            ends = np.append(starts[1:], len(ids))
            flat = ids.astype("<u4").tobytes()
            for k, a, b in zip(of[first:last], (4 * starts).tolist(), (4 * ends).tolist(), strict=True):
                out[k].append(flat[a:b])
            first = last
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]


def safe_parts(text: bytes, limit: int) -> Iterator[bytes]:
    """A text cut at spaces between ASCII letters or digits, into parts of about `limit` bytes where it has such."""
    start = 0
    while len(text) - start > limit:
        cut = text.find(b" ", start + limit)
        while cut >= 0 and not (cut + 1 < len(text) and text[cut - 1 : cut].isalnum() and text[cut + 1 : cut + 2].isalnum()):
            cut = text.find(b" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _gather(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the parts of `pool` one after another, their ends)."""
    ends = np.cumsum(lens)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, pool.dtype), ends
    return pool[np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1])], ends


_ENCODERS: dict[int, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each vocabulary and worker process, so that its cache outlives a task."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


@lru_cache(maxsize=1)
def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_json(path: str | None = None) -> str:
    """The vocabulary file as text; by default that of the public byte-level BPE."""
    with open(path or _default_path(), encoding="utf-8") as f:
        return f.read()


def encoded_rows(spark: SparkSession, path: str | None, end_id: int) -> Callable[[Iterator], Iterator[tuple]]:
    """A function for workers: Arrow batches with `text` to (batch, ids of each row with `end_id` after them)."""
    vocabulary = spark.sparkContext.broadcast(tokenizer_json(path))  # the size of a vocabulary file
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator) -> Iterator[tuple]:
        from ctxvote.llm._shared import byte_slices, text_runs

        enc = encoder(vocabulary.value)
        for batch in text_runs(batches, RUN_BYTES, encoders=True):
            yield batch, [x + end for x in enc.encode([bytes(t) for t in byte_slices(batch.column("text"))])]

    return run
