"""Transaction-id sets against plain Python sets."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import transactions as tx

KIND = "source int, seq long, note string"


def ids(table):
    out = set()
    for r in table.collect():
        assert r.low <= r.high
        new = {(r.source, i) for i in range(r.low, r.high + 1)}
        assert not out & new, "intervals are disjoint"
        out |= new
    spans = sorted((r.source, r.low, r.high) for r in table.collect())
    assert all(a[0] != b[0] or a[2] + 1 < b[1] for a, b in zip(spans, spans[1:])), "and do not touch"
    return out


def rows(spark, given):
    return spark.createDataFrame([(s, i, "n") for s, i in given], KIND)


def drawn(seed, n=400, span=600):
    rng = random.Random(seed)
    return [(rng.choice([1, 1, 1, 2, 9]), rng.randrange(-span // 3, span)) for _ in range(n)]


@pytest.mark.parametrize("width", [7, 1 << 20])
def test_algebra(spark, width):
    a, b = drawn(1), drawn(2)
    left, right = (tx.transaction_set(rows(spark, x), width=width) for x in (a, b))
    assert ids(left) == set(a)
    assert ids(tx.union(left, right, width=width)) == set(a) | set(b)
    assert ids(tx.difference(left, right, width=width)) == set(a) - set(b)
    assert ids(tx.difference(left, left, width=width)) == set()
    holes = {
        (s, i)
        for s in {s for s, _ in a}
        for i in range(min(i for t, i in a if t == s), max(i for t, i in a if t == s))
    } - set(a)
    assert ids(tx.gaps(left, width=width)) == holes


def test_overlapping_intervals_are_merged(spark):
    table = spark.createDataFrame(
        [(1, 1, 5), (1, 3, 9), (1, 10, 10), (1, 12, 20), (1, 13, 14), (2, 5, 5), (None, 1, 2), (3, None, 2)],
        "source int, low long, high long",
    )
    got = sorted(tuple(r) for r in tx.merged(table, width=4).collect())
    assert got == [(1, 1, 10), (1, 12, 20), (2, 5, 5)]


def test_contains(spark):
    held = tx.transaction_set(rows(spark, drawn(3)), width=16)
    asked = [*drawn(4), *drawn(4)[:50], (1, None), (None, 3), (77, 1), (1, 10**12)]
    got = tx.contains(rows(spark, asked), held, width=16).collect()
    have = set(drawn(3))
    assert sorted(map(repr, ((r.source, r.seq, r.applied) for r in got))) == sorted(
        map(repr, ((s, i, (s, i) in have) for s, i in asked))
    )


def test_nulls_and_empty_tables(spark):
    table = rows(spark, [(None, 1), (1, None)])
    for t in (table, table.limit(0)):
        held = tx.transaction_set(t)
        assert held.count() == tx.gaps(held).count() == tx.difference(held, held).count() == 0
        assert not any(r.applied for r in tx.contains(table, held).collect())


def test_a_source_with_most_ids_is_cut(spark):
    """One million consecutive ids of one source: no window partition holds more than a chunk."""
    wide = spark.range(1_000_000).select(F.lit(1).alias("source"), F.col("id").alias("seq"))
    held = tx.transaction_set(wide.filter("seq % 100000 <> 5"), width=10_000)
    assert sorted((r.low, r.high) for r in held.collect())[:2] == [(0, 4), (6, 100_004)]
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in plan


def test_no_task_holds_more_as_a_table_grows(spark, monkeypatch):
    """Tasks follow the rows, not the session's number of shuffle partitions (8 here)."""
    monkeypatch.setattr(tx, "TASK_ROWS", 500)
    table = spark.range(40_000).select(F.lit(1).alias("source"), (F.col("id") * 2).alias("seq"))
    every = tx.transaction_set(table, width=64)
    for found, left in (
        (tx.difference(every, tx.transaction_set(table.filter("seq % 8 = 0"), width=64), width=64), 30_000),
        (tx.union(every, every, width=64), 40_000),
        (tx.gaps(every, width=64), 39_999),
    ):
        sizes = found.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == left
        assert len(sizes) > 40 and max(r["count"] for r in sizes) < 2_500


@pytest.mark.parametrize("start", [-(1 << 62), (1 << 62) + 1])
def test_huge_ids_and_stretches_over_many_chunks(spark, start):
    numbers = [i for i in range(600) if i % 97 and i not in (63, 64, 128, 191, 192, 193)]
    held = tx.transaction_set(rows(spark, [(1, start + i) for i in numbers]), width=64)
    assert ids(held) == {(1, start + i) for i in numbers}
