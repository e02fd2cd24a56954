"""Look-up and back-off in one exchange (J-3, J-5): what the train entries know of the contexts of the test entries.

A window holds the smaller ones of its target and side, so windows that are equal in any size are equal in the smallest.
A side of a target therefore is one row with its keys of all sizes, dealt by the smallest: where it lands, the sizes are
looked up from the largest on, and only the labels of the first that is known leave the task.  Rows travel as columns in
compressed packs; equal rows of a task are counted before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import kind_of
from ..functions.window_keys import window_keys
from ..functions.windows import SIZES, target_blocks
from ..ship import ensure_package
from .model import BROADCAST_LABELS, human_label

#: Sides of targets that a task holds before it packs them, and rows that it looks at together.
HELD, TOGETHER = 500_000, 512


def small(vocab: DataFrame) -> bool:
    """Whether workers may hold the labels of a vocabulary."""
    return vocab.count() <= BROADCAST_LABELS


def _numbered(vocab: DataFrame) -> DataFrame:
    """`kind, label, number` in the order of labels; `small` vocabularies only."""
    return vocab.select("kind", "label", (F.row_number().over(Window.orderBy("kind", "label")) - 1).alias("number"))


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order of rows by all keys, whether a row in that order differs from the one before)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, new


def _pack(columns: dict[str, pa.Array]) -> bytes:
    sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _packing(numbers: Callable[[], tuple[dict, dict]], sizes: tuple[int, ...], full_strip: bool, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow batches of blocks to packs `bucket, pack` of the sides of their targets."""
    names = [f"k{i}" for i in range(len(sizes) + 1)]

    def packed(held: list[pa.Table]) -> Iterator[tuple[int, bytes]]:
        if not held:
            return
        rows = pa.concat_tables(held)
        keys = [rows.column(k).to_numpy() for k in names]
        bucket = (keys[1] >> np.uint64(33)) % np.uint64(n)
        if "label" in rows.column_names:
            order, new = _runs([bucket, *keys, rows.column("label").to_numpy()])
            at = np.flatnonzero(new)
            rows = rows.take(pa.array(order[at])).append_column("count", pa.array(np.diff(np.append(at, len(order)))))
            bucket = bucket[order[at]]
        else:
            order = np.lexsort((*keys[:3], bucket))
            rows, bucket = rows.take(pa.array(order)), bucket[order]
        rows = rows.combine_chunks()
        begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(bucket)], strict=False):
            yield int(bucket[a]), _pack({c: pa.concat_arrays(rows.column(c).slice(a, b - a).chunks) for c in rows.column_names})

    def out(found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for bucket, pack in found:
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([pack], pa.binary())], ["bucket", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind = numbers()
        known, asked, n_known, n_asked = [], [], 0, 0
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.take(pa.array(range(at, min(at + TOGETHER, whole.num_rows))))  # a copy, so that its buffers hold no other rows
                targets = batch.column("_targets")
                flat, rows = targets.flatten(), pc.list_parent_indices(targets).to_numpy(zero_copy_only=False)
                if not len(flat):
                    continue
                place, var = flat.field("i").to_numpy(zero_copy_only=False), flat.field("var")
                fn = pc.starts_with(var, "sub_").to_numpy(zero_copy_only=False)
                keys = window_keys(batch.column("_padded"), rows, place, fn, sizes, full_strip)
                train = batch.column("train").to_numpy(zero_copy_only=False)[rows]
                labels = flat.field("attached").dictionary_encode(null_encoding="encode")
                texts = labels.dictionary.to_pylist()
                table = np.asarray([[d.get(x, -1) for x in texts] for d in by_kind], np.int32).reshape(2, -1)
                number = table[fn.astype(np.int64), labels.indices.to_numpy(zero_copy_only=False)]
                for test, chosen, to in ((False, np.flatnonzero(train & (number >= 0)), known), (True, np.flatnonzero(~train), asked)):
                    if not len(chosen):
                        continue
                    both = np.concatenate([chosen, chosen + len(train)])
                    columns = {c: pa.array(k[both]) for c, k in zip(names, keys, strict=True)}
                    twice = pa.array(np.concatenate([chosen, chosen]))
                    if test:
                        pos = batch.column("_at").to_numpy(zero_copy_only=False)[rows] + place
                        columns |= {"entry_id": batch.column("entry_id").take(pa.array(rows[chosen]).cast(pa.int64())), "var": var.take(pa.array(chosen))}
                        columns |= {c: pa.concat_arrays([columns[c], columns[c]]) for c in ("entry_id", "var")}
                        columns |= {"pos": pa.array(pos.astype(np.int32)).take(twice), "flank": pa.array(np.arange(len(both)) >= len(chosen))}
                    else:
                        columns["label"] = pa.array(number).take(twice)
                    to.append(pa.table(columns))
                    n_known, n_asked = n_known + (0 if test else len(both)), n_asked + (len(both) if test else 0)
                if n_known > HELD:
                    yield from out(packed(known))
                    known, n_known = [], 0
                if n_asked > HELD:
                    yield from out(packed(asked))
                    asked, n_asked = [], 0
        yield from out(packed(known))
        yield from out(packed(asked))

    return run


def _top(group: np.ndarray, label: np.ndarray, count: np.ndarray, n_groups: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start and number of labels of each group, labels, counts): the k most frequent, ties to the smaller label."""
    order = np.lexsort((label, group))
    group, label, count = group[order], label[order], count[order]
    begins = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (label[1:] != label[:-1])))
    group, label, count = group[begins], label[begins], np.add.reduceat(count, begins)
    order = np.lexsort((label, -count, group))
    group, label, count = group[order], label[order], count[order]
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    rank = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
    stay = rank < k
    group, label, count = group[stay], label[stay], count[stay]
    lens = np.bincount(group, minlength=n_groups)
    return np.cumsum(lens) - lens, lens, label, count


def _resolving(sizes: tuple[int, ...], k: int, out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The packs of a task to `entry_id, pos, var, flank, n, numbers, counts` of the contexts that some size knows."""
    names = [f"k{i}" for i in range(len(sizes) + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = [], []
        for batch in batches:
            for pack in batch.column("pack"):
                rows = pa.ipc.open_stream(pack.as_buffer()).read_all()
                (known if "label" in rows.column_names else asked).append(rows)
        if not known or not asked:
            return
        known, asked = pa.concat_tables(known), pa.concat_tables(asked)
        keys = [np.concatenate([known.column(c).to_numpy(), asked.column(c).to_numpy()]) for c in names]
        label, count = known.column("label").to_numpy(), known.column("count").to_numpy()
        known, n_known = None, known.num_rows
        order = np.lexsort(keys[::-1])
        new, groups = np.zeros(len(order), bool), []
        new[:1] = True
        for i, key in enumerate(keys):
            key = key[order]
            new[1:] |= key[1:] != key[:-1]
            if i:  # the first two are one size
                own = np.empty(len(order), np.int64)
                own[order] = np.cumsum(new) - 1
                groups.append(own)
        keys = order = None
        open_ = np.arange(asked.num_rows)
        for size, group in reversed(list(zip(sizes, groups, strict=True))):
            n_groups = int(group.max()) + 1
            there, wanted = np.zeros(n_groups, bool), np.zeros(n_groups, bool)
            there[group[:n_known]] = True
            own = group[n_known:][open_]
            hit = there[own]
            found, own, open_ = open_[hit], own[hit], open_[~hit]
            if not len(found):
                continue
            wanted[own] = True
            used = np.flatnonzero(wanted[group[:n_known]])
            starts, lens, labels, counts = _top(group[used], label[used], count[used], n_groups, k)
            for at in range(0, len(found), 50_000):
                rows, of = asked.take(pa.array(found[at : at + 50_000])), own[at : at + 50_000]
                ends = np.cumsum(lens[of])
                places = np.repeat(starts[of] - (ends - lens[of]), lens[of]) + np.arange(ends[-1])
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                columns = {c: pa.concat_arrays(rows.column(c).chunks) for c in ("entry_id", "pos", "var", "flank")}
                columns |= {"n": pa.array(np.full(len(of), size, np.int32)), "numbers": pa.ListArray.from_arrays(offsets, pa.array(labels[places], pa.int32())), "counts": pa.ListArray.from_arrays(offsets, pa.array(counts[places], pa.int64()))}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out], schema=out)

    return run


def resolved(entries: DataFrame, vocab: DataFrame, label_type: str = "type", sizes=SIZES, k: int = 5, full_strip: bool = False) -> DataFrame:
    """J-3, J-5: `entry_id, pos, var, flank, n, numbers, counts`: of each context of the entries that are not `train`, the
    k most frequent labels of its largest window that the `train` entries know, as numbers that `contexts` turns into
    labels.

    `entries(entry_id, tokens, labels, train)`; a `small` vocabulary.
    """
    spark = entries.sparkSession
    ensure_package(spark)
    sizes = tuple(sorted(sizes))
    rows = _numbered(vocab).toArrow()
    by_kind = spark.sparkContext.broadcast([dict(zip(x.column("label").to_pylist(), x.column("number").to_pylist(), strict=True)) for x in (rows.filter(pc.equal(rows.column("kind"), kind)) for kind in ("variable", "function"))])
    attach = lambda var: F.when(~F.col("train"), F.struct(F.lit(None).cast("string").alias("label"))).otherwise(human_label(label_type)(var))["label"]
    blocks = target_blocks(entries, max(sizes), ("train",), attach, ("labels",))
    blocks = blocks.withColumn("_targets", F.filter("_targets", lambda x: x["attached"].isNotNull() | ~F.col("train")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = blocks.select("entry_id", "train", "_at", "_padded", "_targets").mapInArrow(_packing(lambda: by_kind.value, sizes, full_strip, n), "bucket int, pack binary")
    made = StructType([entries.schema["entry_id"], StructField("pos", IntegerType()), StructField("var", StringType()), StructField("flank", BooleanType()), StructField("n", IntegerType()), StructField("numbers", ArrayType(IntegerType())), StructField("counts", ArrayType(LongType()))])
    return packs.repartitionById(n, F.col("bucket")).mapInArrow(_resolving(sizes, k, to_arrow_schema(made)), made)


def contexts(found: DataFrame, vocab: DataFrame) -> DataFrame:
    """The rows of `resolved` as those of `back_off`, one for each label, with its share `p` of its context.

    An entry's rows come together, so that its votes and ranks need no further shuffle.
    """
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    rows = found.repartition("entry_id").select("entry_id", "pos", "var", "flank", "n", total.alias("_t"), F.explode(F.arrays_zip("numbers", "counts")).alias("_x"))
    rows = rows.select("entry_id", "pos", "var", kind_of(F.col("var")).alias("kind"), "flank", "n", F.col("_x.numbers").alias("number"), F.col("_x.counts").alias("count"), (F.col("_x.counts") / F.col("_t")).alias("p"))
    return rows.join(F.broadcast(_numbered(vocab).select("number", "label")), "number").drop("number")
