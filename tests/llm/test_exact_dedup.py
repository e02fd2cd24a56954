import hashlib
import random
from collections import defaultdict

import pytest

from ctxvote.llm.exact_dedup import exact_dedup


def brute(rows, best):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    seen, out = set(), []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = best(ids) if ids else None
        first = (i, t or "") not in seen
        seen.add((i, t or ""))
        out.append((i, keep, len(groups[t or ""]), i == keep and first, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
def test_against_brute_force(spark, keep, best):
    rng = random.Random(3)
    texts = ["", None, "a", "a ", "A", "é", "é", "x" * 200_000, "\n", "\x00"]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(7, "a"), (7, "a"), (None, "a"), (None, "only"), (None, "only")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, run int, digest string")
    got = sorted((tuple(r) for r in exact_dedup(df, keep=keep).drop("text_key").collect()), key=repr)
    assert got == brute(rows, best)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_digest_is_spread_over_runs(spark):
    from ctxvote.llm.exact_dedup import FAN, fingerprints, merge_tree

    df = spark.range(5000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text")
    leaf, root = merge_tree(fingerprints(df, 2), 2)
    first = leaf.groupBy("digest").agg({"run": "count", "group_size": "max"}).orderBy("count(run)", ascending=False).first()
    assert first["count(run)"] > 0.9 * FAN**2 and first["max(group_size)"] < 30
    top = root.orderBy("group_size", ascending=False).first()
    assert (top.winner.id, top.group_size) == (0, 1667)


def test_runs_are_sorted_and_end_where_their_digests_belong(spark):
    from pyspark.sql import functions as F

    from ctxvote.llm.exact_dedup import FAN, _merged, fingerprints, merge_tree, rounds_for

    assert [rounds_for(n) for n in (1, 16, 256, 257, 10_000)] == [2, 2, 2, 3, 4]
    df = spark.range(2000).selectExpr("id as doc_id", "cast(id % 700 as string) as text")
    _, root = merge_tree(fingerprints(df, 2), 2)
    rows = root.withColumn("part", F.spark_partition_id()).collect()
    assert len(rows) == 700
    for r in rows:  # digit 0 of the run is the digest's first, digit 1 its second
        assert r.run == (r.digest[0] >> 4) + FAN * (r.digest[0] & 15)
    places = {}
    for r in rows:
        assert places.setdefault(r.run, r.part) == r.part
    for part in {r.part for r in rows}:
        keys = [(r.run, bytes(r.digest)) for r in rows if r.part == part]
        assert keys == sorted(keys)
    plan = root._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "Python" not in plan and "Arrow" not in plan


def test_rows_without_ids_are_spread_too(spark):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'one' as text")
    got = exact_dedup(df).groupBy("kept", "group_size").count().collect()
    assert sorted((r.kept, r.group_size, r["count"]) for r in got) == [(False, 3000, 2999), (True, 3000, 1)]
