"""Context windows around marked tokens and their hashes (T-5, T-6, A-1)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from ..ship import ensure_package
from .text import SEGMENT, is_marked, kind_of, name_of, normalized

PAD = "??"
#: Window sizes of a default model.
SIZES = (48, 12, 8, 4, 2)


#: Tokens of a sequence that are looked at together, so that a long sequence is many small rows.
BLOCK = 1024


def _joined(tokens: Column) -> Column:
    """Tokens with the byte FF between any two: it begins no UTF-8 character, so they cannot be confused."""
    return F.call_function("array_join", tokens, F.lit(b"\xff").cast("string"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def span_names(span: Column) -> Column:
    """The marked tokens of a span that are renamed, in order of first appearance."""
    return F.array_distinct(F.filter(span, lambda t: t.startswith("@@") & is_marked(t) & (F.octet_length(t) > 4)))


def span_hash(span: Column, discriminator: Column) -> Column:
    """T-6: 24 hexadecimal digits of SHA-256 over the span and its discriminator.

    Tokens are joined by the byte FF.  Marked tokens are renamed in order of first appearance within the span, so
    contexts that differ in names only are equal.
    """

    def hashed(found: Column) -> Column:
        number = lambda t: F.array_position(found, t)
        rename = lambda t: F.when(t.startswith("@@") & (number(t) > 0), F.concat(F.lit("@@var_"), (number(t) - 1).cast("string"), F.lit("@@"))).otherwise(t)
        tokens = F.when(F.size(found) > 0, F.transform(span, rename)).otherwise(span)
        whole = F.concat(_joined(tokens), discriminator).cast("binary")
        return F.substring(F.sha2(whole, 256), 1, 24)

    return let(span_names(span), hashed)


_NAMES = [b"@@var_%d@@" % i for i in range(2 * max(SIZES))]


def _name(i: int) -> bytes:
    return _NAMES[i] if i < len(_NAMES) else b"@@var_%d@@" % i


def _renames(token: bytes) -> bool:
    return len(token) > 4 and token.startswith(b"@@") and token.endswith(b"@@")


def _masked(tokens: list[bytes], at: int, n: int) -> tuple[list[bytes], list[bytes]]:
    """The n tokens left and right of a target; what lies beyond a segment border, and the border, is padding."""
    left, right = tokens[at - n : at], tokens[at + 1 : at + 1 + n]
    border, pad = SEGMENT.encode(), PAD.encode()
    if border in left:
        last = n - 1 - left[::-1].index(border)
        left[: last + 1] = [pad] * (last + 1)
    if border in right:
        first = right.index(border)
        right[first:] = [pad] * (len(right) - first)
    return left, right


def _whole(tokens: list[bytes]) -> bytes:
    """What is hashed of a span, token by token."""
    names: dict[bytes, int] = {}
    return b"\xff".join(_name(names.setdefault(t, len(names))) if _renames(t) else t for t in tokens)


class _Row:
    """The padded tokens of a block in one run of bytes, each but the last followed by FF, and its marked tokens."""

    def __init__(self, data: bytes, starts: list[int], marks: list[int]) -> None:
        self.data, self.starts, self.marks = data, starts, marks  # starts: of each token, and one past the end
        self.names = [data[starts[m] : starts[m + 1] - 1] for m in marks]

    def tokens(self) -> list[bytes]:
        return self.data.split(b"\xff")  # no token has this byte

    def whole(self, a: int, b: int, lo: int, hi: int) -> bytes:
        """What is hashed of the span [a, b), whose marked tokens are those from lo to hi."""
        data, starts = self.data, self.starts
        if lo == hi:
            return data[starts[a] : starts[b] - 1]
        names: dict[bytes, bytes] = {}
        parts, at = [], starts[a]
        for m, name in zip(self.marks[lo:hi], self.names[lo:hi]):  # noqa: B905
            new = names.get(name)
            if new is None:
                new = names[name] = _name(len(names))
            parts += (data[at : starts[m]], new)
            at = starts[m + 1] - 1
        parts.append(data[at : starts[b] - 1])
        return b"".join(parts)


#: Normal forms of tokens that a worker has met, by whether all but known ones are stripped; bounded, shorter tokens only.
_NORMAL: dict[bool, dict[str, str]] = {False: {}, True: {}}
_NORMAL_KEPT, _NORMAL_LONGEST = 200_000, 64


def _normal(tokens: list[str], full_strip: bool) -> list[str]:
    """Normal forms of tokens; segment borders stay, and what is null stands for padding."""
    known, out = _NORMAL[full_strip], []
    if len(known) > _NORMAL_KEPT:
        known.clear()
    for t in tokens:
        form = known.get(t)
        if form is None:
            form = PAD if t is None else t if t == SEGMENT else normalized(t, full_strip)
            if t is not None and len(t) <= _NORMAL_LONGEST:
                known[t] = form
        out.append(form)
    return out


def _rows_of(padded: pa.ListArray, full_strip: bool) -> Iterator[_Row]:
    """The blocks of an Arrow column of token lists, normalised: each distinct token of the batch once."""
    ends = padded.offsets.to_numpy()
    coded = padded.values.dictionary_encode(null_encoding="encode")
    normal = pa.array(_normal(coded.dictionary.to_pylist(), full_strip), pa.string())
    values = normal.take(coded.indices).cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    first, size = offsets[:-1], np.diff(offsets)
    at = np.flatnonzero(size > 4)
    for place, back in ((first, 0), (first, -1), (first + size, 1), (first + size, 2)):
        at = at[raw[place[at] - back] == 0x40]
    joined = pc.binary_join(pa.ListArray.from_arrays(padded.offsets, values.cast(pa.binary())), b"\xff")
    for r, data in enumerate(joined.to_pylist()):
        a, b = int(ends[r]), int(ends[r + 1])
        starts = (offsets[a : b + 1] - offsets[a] + np.arange(b - a + 1)).tolist()
        lo, hi = np.searchsorted(at, (a, b))
        yield _Row(data, starts, (at[lo:hi] - a).tolist())


def _hashing(sizes: tuple[int, ...], flanking: bool, full_strip: bool, spans: bool, keyed: bool, out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches of blocks to one row for each target, with the windows of all sizes and sides in `_w`."""
    widest, sides = max(sizes), (b"left_", b"right_") if flanking else (b"",)
    discs = {fn: (sides[0] + short, sides[-1] + short) for fn, short in ((True, b"fn"), (False, b"var"))}
    ending = {(n, fn): n.to_bytes(3, "big") + (b"\x01" if fn else b"\x00") for n in sizes for fn in (True, False)}

    def add(made: list, whole: bytes, end: bytes) -> None:
        made.append(sha256(whole).digest()[:12] + end if keyed else sha256(whole).hexdigest()[:24])

    def slow(row: _Row, i: int, fn: bool, made: list, seen: list) -> None:
        """Token by token, where there are segment borders or the spans are wanted."""
        tokens, at = row.tokens(), i + widest
        for n in sizes:
            left, right = _masked(tokens, at, n)
            for side, span in zip(sides, [left, right] if flanking else [[*left, tokens[at], *right]], strict=True):
                add(made, _whole(span) + side + (b"fn" if fn else b"var"), ending[n, fn])
                seen.append(span)

    def fast(row: _Row, i: int, fn: bool, made: list) -> None:
        at, data, starts, marks = i + widest, row.data, row.starts, row.marks
        first, second = discs[fn]
        before, after = bisect_left(marks, at), bisect_left(marks, at + 1)
        head, tail = starts[at] - 1, starts[at + 1]
        for n in sizes:
            a, b = at - n, at + 1 + n
            lo, hi = bisect_left(marks, a, 0, before), bisect_left(marks, b, after)
            if flanking:
                add(made, (data[starts[a] : head] if lo == before else row.whole(a, at, lo, before)) + first, ending[n, fn])
                add(made, (data[tail : starts[b] - 1] if hi == after else row.whole(at + 1, b, after, hi)) + second, ending[n, fn])
            else:
                add(made, row.whole(a, b, lo, hi) + first, ending[n, fn])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = len(sizes) * len(sides)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.take(pa.array(range(at, min(at + 256, whole.num_rows))))  # a copy, so that its buffers hold no other rows
                targets = batch.column("_targets")
                flat = targets.flatten()
                places, names = flat.field("i").to_pylist(), flat.field("var").to_pylist()
                ends = targets.offsets.to_pylist()
                made, seen = [], []
                for r, (row, borders) in enumerate(zip(_rows_of(batch.column("_padded"), full_strip), batch.column("_borders").to_pylist(), strict=True)):
                    for k in range(ends[r], ends[r + 1]):
                        fn = names[k].startswith("sub_")
                        if borders or spans:
                            slow(row, places[k], fn, made, seen)
                        else:
                            fast(row, places[k], fn, made)
                parents = pc.list_parent_indices(targets)
                lists = pa.array(range(0, len(made) + 1, each), pa.int32())
                columns = {f.name: batch.column(f.name).take(parents) for f in batch.schema if f.name not in ("_targets", "_padded", "_borders")}
                columns |= {f.name: flat.field(k) for k, f in enumerate(flat.type)}
                columns["_w"] = pa.ListArray.from_arrays(lists, pa.array(made, pa.binary() if keyed else pa.string()))
                if spans:
                    columns["_spans"] = pa.ListArray.from_arrays(lists, pa.array([[t.decode() for t in x] for x in seen], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out], schema=out)

    return run


def target_blocks(entries: DataFrame, widest: int, keep: tuple[str, ...] = (), attach: Callable[[Column], Column] | None = None, attach_from: tuple[str, ...] = ()) -> DataFrame:
    """Sequences in blocks of `BLOCK` tokens: `entry_id, *keep, _at, _padded, _borders, _targets`: where a block begins, its
    tokens with as many on either side as the widest window reaches, whether they hold segment borders, and its targets
    (`i, var`, and `attached` with `attach`)."""
    pad = F.array_repeat(F.lit(None).cast("string"), widest)
    df = entries.select("entry_id", *keep, *attach_from, "tokens", F.concat(pad, "tokens", pad).alias("_padded"))
    blocks = F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / BLOCK).cast("int"))
    block = lambda b: F.struct((b * BLOCK).alias("at"), F.slice("tokens", b * BLOCK + 1, F.lit(BLOCK)).alias("tokens"), F.slice("_padded", b * BLOCK + 1, F.lit(BLOCK + 2 * widest)).alias("padded"))
    df = df.where(F.size("tokens") > 0).select("entry_id", *keep, *attach_from, F.explode(F.transform(blocks, block)).alias("_b"))
    targets = F.filter(F.transform("_b.tokens", lambda t, i: F.struct(i.alias("i"), t.alias("token"))), lambda x: x["token"].startswith("@@") & is_marked(x["token"]))
    named = lambda x: F.struct(x["i"].alias("i"), name_of(x["token"]).alias("var"), *([attach(name_of(x["token"])).alias("attached")] if attach is not None else []))
    targets = F.transform(targets, named)
    return df.select("entry_id", *keep, F.col("_b.at").alias("_at"), F.col("_b.padded").alias("_padded"), F.coalesce(F.array_contains("_b.padded", SEGMENT), F.lit(False)).alias("_borders"), targets.alias("_targets"))


def context_windows(entries: DataFrame, sizes=SIZES, flanking: bool = True, full_strip: bool = False, keep: tuple[str, ...] = (), spans: bool = False, attach: Callable[[Column], Column] | None = None, attach_from: tuple[str, ...] = (), keyed: bool = False) -> DataFrame:
    """T-5: one row for each target occurrence, size and side: `entry_id, *keep, pos, var, kind, n, flank, hash`.

    `entries(entry_id, tokens, ...)`.  Flanking windows are the n tokens left (`flank` false) and right (true) of
    the target; centred ones (flank null) hold 2n + 1 tokens with the target.  Windows are padded at the ends of
    the sequence and at segment borders.  Tokens are normalised and spans hashed from the bytes of a block of tokens (Arrow) before rows are
    exploded, and never shuffled.  With `spans` the tokens come along, for inspection.  `attach` makes a value
    `attached` of a target's name from the entry's columns `attach_from`; targets for which it is null have no windows.
    With `keyed`, `_key` (size, hash and kind in 16 bytes) takes the place of `n` and `hash`.
    """
    ensure_package(entries.sparkSession)
    sizes = tuple(sizes)
    df = target_blocks(entries, max(sizes), keep, attach, attach_from)
    if attach is not None:
        df = df.withColumn("_targets", F.filter("_targets", lambda x: x["attached"].isNotNull()))
    own = ["var", *(["attached"] if attach is not None else [])]
    inner = df.schema["_targets"].dataType.elementType
    w = ArrayType(BinaryType() if keyed else StringType())
    made = StructType([*[df.schema[c] for c in ("entry_id", *keep, "_at")], *[StructField(f.name, f.dataType) for f in inner], StructField("_w", w), *([StructField("_spans", ArrayType(ArrayType(StringType())))] if spans else [])])
    df = df.mapInArrow(_hashing(sizes, flanking, full_strip, spans, keyed, to_arrow_schema(made)), made)
    sides = [False, True] if flanking else [None]
    df = df.select("entry_id", *keep, (F.col("_at") + F.col("i")).alias("pos"), *own, kind_of(F.col("var")).alias("kind"), *(["_spans"] if spans else []), F.posexplode("_w").alias("_p", "_h"))
    flank = F.col("_p") % 2 == 1 if flanking else F.lit(None).cast("boolean")
    n = F.get(F.array(*[F.lit(n) for n in sizes]), F.floor(F.col("_p") / len(sides)).cast("int"))
    found = [flank.alias("flank"), F.col("_h").alias("_key")] if keyed else [n.alias("n"), flank.alias("flank"), F.col("_h").alias("hash")]
    return df.select("entry_id", *keep, "pos", *own, "kind", *found, *([F.get("_spans", F.col("_p")).alias("span")] if spans else []))


def occurrences(entries: DataFrame, keep: tuple[str, ...] = (), attach: Callable[[Column], Column] | None = None, attach_from: tuple[str, ...] = ()) -> DataFrame:
    """A-1: `entry_id, *keep, var, kind, n_occurrences` of every target of every entry.

    An entry that holds a bare `@@` or `@@@` is malformed as a whole and gives no rows.  `attach` makes a value
    `attached` of a target's name from the entry's columns `attach_from`, inside the row: only that value is shuffled.
    """
    extra = ["attached"] if attach is not None else []
    rows = marked_names(entries, keep, attach, attach_from)
    return rows.groupBy("entry_id", *keep, "var", *extra).agg(F.count(F.lit(1)).alias("n_occurrences")).withColumn("kind", kind_of(F.col("var")))


def marked_names(entries: DataFrame, keep: tuple[str, ...] = (), attach: Callable[[Column], Column] | None = None, attach_from: tuple[str, ...] = ()) -> DataFrame:
    """`entry_id, *keep, var` (and `attached`) for every occurrence of a target in an entry that is not malformed."""
    good = entries.where(~F.exists("tokens", lambda t: t.isin("@@", "@@@")))
    names = F.transform(F.filter("tokens", is_marked), name_of)
    if attach is None:
        return good.select("entry_id", *keep, F.explode(names).alias("var"))
    named = F.transform(names, lambda v: F.struct(v.alias("var"), attach(v).alias("attached")))
    return good.select("entry_id", *keep, *attach_from, F.explode(named).alias("_n")).select("entry_id", *keep, "_n.var", "_n.attached")
