"""Vectorised hashes of words, shingles and byte strings over UTF-8 text."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE)) | U(1)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * (out[k - 1 : k] * U(base))
        k += m
    return out


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE, or its inverse modulo 2**64, to the powers 0 to n - 1."""
    size = max(_SEGMENT * 2, 1 << (n - 1).bit_length())
    return _powers(size, pow(BASE, -1, 1 << 64) if inverse else BASE)[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any part follows; one more than `data`."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def part_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each part: equal bytes give equal values wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), inverse=True)[starts])


#: A to Z become a to z; bytes that no word holds become spaces.
_LOWER = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20 for b in range(256))


def lowered(text: bytes) -> bytes:
    """`text` with ASCII letters in lower case and a space for each byte outside words `[0-9a-z]` or non-ASCII."""
    return text.translate(_LOWER)


def word_bounds(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lowered text."""
    inside = np.zeros(len(low) + 2, np.int8)
    inside[1:-1] = low != 0x20
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(low: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of lowered text, in segments of bounded size."""
    data = np.frombuffer(low, np.uint8)
    hashes, starts, ends, at = [], [], [], 0
    while at < len(data):
        stop = min(at + _SEGMENT, len(data))
        if stop < len(data):
            gap = low.rfind(b" ", at, stop)
            gap = gap if gap >= 0 else low.find(b" ", stop)
            stop = gap + 1 if gap >= 0 else len(data)
        part = data[at:stop]
        s, e = word_bounds(part)
        if len(s):
            hashes.append(part_hashes(prefix_sums(part), s, e))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    none = np.zeros(0, np.int64)
    if not hashes:
        return np.zeros(0, np.uint64), none, none
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of each `length` consecutive words."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, length):
        out *= U(BASE)
        out += words[k : k + n]
    return mix(out + U(length))


def joined_docs(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Texts in one string with a space after each, and where each starts."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return b" ".join([*texts, b""]), starts
