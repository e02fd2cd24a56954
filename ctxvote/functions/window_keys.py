"""Keys that tell context windows apart without hashing their bytes, for joins that do not show the hash of T-6.

A window is told by the codes of its tokens, weighted by their distance from the target and summed in 64 bits.  A marked
token has the code of its distance to the same name nearer to the target, or of none, so windows that differ in names
only are equal, as after renaming.  Both sides are read outwards, so the sums of all sizes come from one walk.  The
smallest size has two such sums, which also hold side and kind; a larger window is equal when its own sum and those of
all smaller ones are.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

from .text import SEGMENT
from .windows import PAD, _normal, _renames

#: Codes of tokens that a worker has met, by whether all but known ones are stripped; bounded, shorter tokens only.
_CODES: dict[bool, dict[str | None, bytes]] = {False: {}, True: {}}
_CODES_KEPT, _CODES_LONGEST = 150_000, 64
#: Targets that are looked at together.
_TARGETS = 1 << 14
_FAR = 1 << 30


def _fixed(name: str, n: int) -> np.ndarray:
    """`n` fixed numbers of 64 bits, all odd."""
    return np.frombuffer(b"".join(blake2b(f"{name}:{i}".encode(), digest_size=8).digest() for i in range(n)), "<u8") | np.uint64(1)


def _code(form: str) -> bytes:
    return blake2b(form.encode(), digest_size=16).digest()


def _coded(tokens: list[str | None], full_strip: bool) -> np.ndarray:
    """A row for each token: two codes of its normal form, and whether it is renamed and a border, in three columns."""
    known, out = _CODES[full_strip], []
    if len(known) > _CODES_KEPT:
        known.clear()
    missing = [t for t in tokens if t not in known]
    made = dict(zip(missing, _normal(missing, full_strip), strict=True))
    for t in tokens:
        row = known.get(t)
        if row is None:
            form = made[t]
            row = _code(form) + (_renames(form.encode()) + 2 * (t == SEGMENT)).to_bytes(8, "little")
            if t is None or len(t) <= _CODES_LONGEST:
                known[t] = row
        out.append(row)
    return np.frombuffer(b"".join(out), "<u8").reshape(-1, 3)


def _near(at: np.ndarray, same: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n tokens the distance to the next and to the last of the same name; `at`: the renamed ones."""
    after, before = np.full(n, _FAR, np.int64), np.full(n, _FAR, np.int64)
    order = np.argsort(same, kind="stable")
    places, names = at[order], same[order]
    pairs = np.flatnonzero(names[1:] == names[:-1])
    gaps = places[pairs + 1] - places[pairs]
    after[places[pairs]], before[places[pairs + 1]] = gaps, gaps
    return after, before


def window_keys(padded: pa.ListArray, rows: np.ndarray, places: np.ndarray, functions: np.ndarray, sizes: tuple[int, ...], full_strip: bool = False) -> list[np.ndarray]:
    """The keys of the windows of targets, those of the left sides and then those of the right: two columns of the
    smallest size and one of each larger size, ascending.

    `padded`: token lists with as many padding tokens (null) on either side as the widest window reaches; a target stands
    in the list `rows` at `places` without that padding, and its kind is in `functions`.
    """
    sizes, offsets = tuple(sorted(sizes)), padded.offsets.to_numpy().astype(np.int64)
    widest, least = sizes[-1], sizes[0]
    offsets = offsets - offsets[0]
    coded = padded.flatten().dictionary_encode(null_encoding="encode")
    of, table = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), _coded(coded.dictionary.to_pylist(), full_strip)
    distance = (_fixed("near a", widest + 1), _fixed("near b", widest + 1))
    first, weights = (_fixed("first a", 1), _fixed("first b", 1)), (_fixed("weight a", widest + 1), _fixed("weight b", least + 1))
    pad = [np.frombuffer(_code(PAD), "<u8")[k] for k in (0, 1)]
    renamed = (table[:, 2] & np.uint64(1)).astype(bool)
    own = [np.where(renamed, f, table[:, k])[of] for k, f in enumerate(first)]
    at = np.flatnonzero(renamed[of])
    _, names = np.unique(table[:, 0], return_inverse=True)
    lists = np.searchsorted(offsets, at, "right")
    after, before = _near(at, lists * len(table) + names[of[at]], len(of))
    borders = np.flatnonzero((table[:, 2] & np.uint64(2)).astype(bool)[of])
    targets = offsets[rows] + widest + places
    out = [np.empty(2 * len(targets), np.uint64) for _ in range(len(sizes) + 1)]
    for begin in range(0, len(targets), _TARGETS):
        t, fn = targets[begin : begin + _TARGETS], functions[begin : begin + _TARGETS]
        ends = {}
        if len(borders):
            k = np.searchsorted(borders, t)
            ends = {-1: np.where(k > 0, borders[k - 1], -_FAR), 1: np.where(k < len(borders), borders[np.minimum(k, len(borders) - 1)], _FAR)}
        for side, (step, near) in enumerate(((-1, after), (1, before))):
            to = slice(side * len(targets) + begin, side * len(targets) + begin + len(t))
            sums = [_fixed(f"side {k}", 4)[2 * side + fn.astype(np.int64)] for k in "ab"]
            for d in range(1, widest + 1):
                j = t + step * d
                gap = near[j]
                inside = np.flatnonzero(gap < d)
                beyond = np.flatnonzero((ends[step] - j) * step <= 0) if ends else ()
                for k in (0, 1) if d <= least else (0,):
                    code = own[k][j]
                    code[inside] = distance[k][gap[inside]]
                    if len(beyond):
                        code[beyond] = pad[k]
                    sums[k] = sums[k] + code * weights[k][d]
                if d in sizes:
                    out[sizes.index(d) + 1 if d > least else 0][to] = sums[0]
                    if d == least:
                        out[1][to] = sums[1]
    return out
