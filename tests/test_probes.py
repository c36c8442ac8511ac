"""Probe operators against plain Python on random histories, with one node far busier than the rest."""

import random
from datetime import datetime, timedelta

import pytest

from fleetlens.functions.ranking import time_chunk
from fleetlens.operators import probes

START = datetime(2024, 1, 1)


def history(seed, nodes=12, ok_rate=0.3, ties=True):
    seeded = random.Random(seed)
    rows, seq = [], 0
    for node in range(nodes):
        for _ in range(1500 if node == 0 else seeded.randrange(0, 60)):
            step = seeded.randrange(0, 2000) if ties else seeded.randrange(0, 200_000)
            rows.append((node, START + timedelta(seconds=step), seq, seeded.random() < ok_rate))
            seq += 1
    seeded.shuffle(rows)
    return rows


SCHEMA = "node_id long, ts timestamp, seq long, ok boolean"


def by_node(rows):
    nodes = {}
    for row in rows:
        nodes.setdefault(row[0], []).append(row)
    return {n: sorted(rs, key=lambda r: (r[1], r[2])) for n, rs in nodes.items()}


def python_changes(rows, retries):
    out = []
    for node, probed in by_node(rows).items():
        status, streak = "starting", 0
        for _, ts, seq, ok in probed:
            streak = 0 if ok else streak + 1
            now = "healthy" if ok else "unhealthy" if streak >= retries else status
            if now != status:
                out.append((node, ts, seq, status, now))
            status = now
    return sorted(out)


def python_streaks(rows, retries):
    out = []
    for node, probed in by_node(rows).items():
        run = []
        for _, ts, _, ok in [*probed, (node, None, None, True)]:
            if not ok:
                run.append(ts)
                continue
            if len(run) >= retries:
                out.append((node, run[0], len(run), run[retries - 1], ts))
            run = []
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chunk_seconds", [7, 300, 10**6])
def test_streaks_and_changes(spark, seed, chunk_seconds):
    rows = history(seed)
    frame = spark.createDataFrame(rows, SCHEMA)
    streaks = probes.unhealthy_streaks(frame, 5, chunk_seconds)
    assert sorted((tuple(r) for r in streaks.collect()), key=str) == python_streaks(rows, 5)
    changes = probes.health_changes(frame, 5, chunk_seconds)
    assert sorted(tuple(r) for r in changes.collect()) == python_changes(rows, 5)


def test_streaks_continue_from_carry(spark):
    rows = sorted(history(9), key=lambda r: (r[1], r[2]))
    cut = rows[len(rows) // 2][1]
    frame = spark.createDataFrame(rows, SCHEMA)
    chunk = time_chunk(frame, "ts", 100)
    whole = probes.with_streaks(frame, chunk)
    early = [r for r in rows if r[1] <= cut]
    carry = []
    for node, probed in by_node(early).items():
        streak = 0
        for row in probed:
            streak = 0 if row[3] else streak + 1
        carry.append((node, streak, sum(r[3] for r in probed)))
    late = probes.with_streaks(
        spark.createDataFrame([r for r in rows if r[1] > cut], SCHEMA),
        chunk,
        spark.createDataFrame(carry, "node_id long, streak long, oks long"),
    )
    expected = {tuple(r) for r in whole.collect() if r.ts > cut}
    assert {tuple(r) for r in late.collect()} == expected


def python_readiness(starts, polls, max_polls, horizon):
    polled = by_node(polls)
    out = []
    for node, start_id, ts in starts:
        seen = [
            p for p in polled.get(node, []) if ts < p[1] <= ts + timedelta(seconds=horizon)
        ][:max_polls]
        used = next((i + 1 for i, p in enumerate(seen) if p[3]), None)
        ready_ts = seen[used - 1][1] if used else None
        out.append((start_id, node, ts, used is not None, ready_ts, used))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(
    ("max_polls", "horizon", "chunk_seconds"),
    [(3, 50, 20), (30, 180, 7), (1, 7, 500), (1000, 5, 60), (200, 10**5, 30)],
)
def test_readiness(spark, seed, max_polls, horizon, chunk_seconds):
    polls = history(seed, ok_rate=0.05)
    seeded = random.Random(seed + 100)
    starts = [
        (seeded.choice([0, 0, *range(14)]), 10_000 + i, START + timedelta(seconds=seeded.randrange(-50, 2100)))
        for i in range(400)
    ]
    got = probes.readiness(
        spark.createDataFrame(starts, "node_id long, start_id long, ts timestamp"),
        spark.createDataFrame(polls, SCHEMA),
        max_polls,
        horizon,
        chunk_seconds=chunk_seconds,
    )
    rows = sorted(
        (r.start_id, r.node_id, r.ts, r.ready, r.ready_ts, r.polls_used) for r in got.collect()
    )
    assert rows == python_readiness(starts, polls, max_polls, horizon)


def test_stop_waits_for_a_node_that_does_not_answer(spark):
    starts = spark.createDataFrame([(1, 100, START), (2, 101, START)], "node_id long, start_id long, ts timestamp")
    polls = [(1, START + timedelta(seconds=i + 1), i, i < 3) for i in range(6)]
    polls += [(2, START + timedelta(seconds=i + 1), 10 + i, None if i else True) for i in range(6)]
    got = probes.readiness(starts, spark.createDataFrame(polls, SCHEMA), action="stop")
    rows = {r.node_id: r for r in got.collect()}
    assert (rows[1].polls_used, rows[1].message) == (4, "MySQL stopped successfully")
    assert (rows[2].ready, rows[2].message) == (False, "MySQL still running after stop command")


def test_node_may_be_named_by_several_columns(spark):
    rows = [(r[0] % 3, *r) for r in history(11)]
    frame = spark.createDataFrame(rows, f"cluster_id long, {SCHEMA}").withColumnRenamed("node_id", "id")
    keys = ["cluster_id", "id"]
    changes = probes.health_changes(frame, 5, 60, keys)
    assert sorted(tuple(r)[1:] for r in changes.collect()) == python_changes([r[1:] for r in rows], 5)


def test_start_without_node_or_time_is_kept_as_not_ready(spark):
    starts = spark.createDataFrame(
        [(None, 1, START), (1, 2, None), (1, 3, START)], "node_id long, start_id long, ts timestamp"
    )
    polls = [(1, START + timedelta(seconds=1), 1, True), (None, START + timedelta(seconds=1), 2, True), (1, None, 3, True)]
    got = probes.readiness(starts, spark.createDataFrame(polls, SCHEMA))
    assert {r.start_id: r.ready for r in got.collect()} == {1: False, 2: False, 3: True}


def test_one_node_with_nine_tenths_of_the_rows_is_spread(spark):
    rows = [(0 if i % 10 else 1 + i % 7, START + timedelta(seconds=60 * i), i, i % 13 == 0) for i in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    changes = probes.health_changes(frame, 5, 3600)
    assert sorted(tuple(r) for r in changes.collect()) == python_changes(rows, 5)
    starts = spark.createDataFrame([(0, i, START + timedelta(minutes=i)) for i in range(0, 3000, 50)], "node_id long, start_id long, ts timestamp")
    plan = probes.readiness(starts, frame)._jdf.queryExecution().executedPlan().toString()
    for text in (plan, changes._jdf.queryExecution().executedPlan().toString()):
        assert "TakeOrderedAndProject" not in text and "SinglePartition" not in text


def test_chunks_of_times_without_zone_follow_their_own_clock(spark):
    texts = ["2024-03-31 01:59:59", "2024-03-31 02:30:00", "2024-03-31 03:00:00", "2024-10-27 02:59:59", "2024-10-27 03:00:00"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("cast(t as timestamp_ntz) ts")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        got = [r[0] for r in frame.select(time_chunk(frame, "ts", 3600)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == sorted(got) and got[2] - got[0] == 2 and got[4] - got[3] == 1
