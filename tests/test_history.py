"""Histories against brute force in plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import history

START = datetime(2024, 1, 1)
REPORT = "node_id int, ts timestamp_ntz, seq long, status string, extra string"


def reports(seed, n=300, hours=200):
    rng = random.Random(seed)
    return [
        (rng.choice([1, 1, 1, 2, 3]), START + timedelta(minutes=rng.randrange(60 * hours)), i, rng.choice(["up", "up", "down", None]), "e")
        for i in range(n)
    ]


def spans(rows):
    out = {}
    for node in {r[0] for r in rows}:
        last = {}
        for r in sorted((r for r in rows if r[0] == node), key=lambda r: (r[1], r[2])):
            last[r[1]] = r[3]
        own = []
        for ts, status in sorted(last.items()):
            if not own or own[-1][0] != status:
                own.append((status, ts))
        ends = [ts for _, ts in own[1:]] + [None]
        out[node] = [(s, a, b) for (s, a), b in zip(own, ends)]
    return out


def told(table):
    out = {}
    for r in table.collect():
        out.setdefault(r.node_id, []).append((r.status, r.valid_from, r.valid_to))
    return {k: sorted(v, key=lambda x: x[1]) for k, v in out.items()}


@pytest.mark.parametrize("chunk_seconds", [600, 86_400])
def test_validity(spark, chunk_seconds):
    rows = reports(1)
    table = spark.createDataFrame([*rows, (None, START, 1, "up", "e"), (1, None, 1, "up", "e")], REPORT)
    assert told(history.validity(table, ["status"], chunk_seconds=chunk_seconds)) == spans(rows)
    assert history.validity(table.limit(0), ["status"]).count() == 0


def test_extension_equals_the_whole(spark):
    rows = sorted(reports(2), key=lambda r: r[1])
    cut = rows[200][1]
    early, late = ([r for r in rows if (r[1] < cut) == e and (e or r[0] != 3)] for e in (True, False))
    table = lambda part: spark.createDataFrame(part, REPORT)
    old = history.validity(table(early), ["status"])
    kept, new = history.extend_validity(old, table(late), ["status"])
    assert told(kept.unionByName(new)) == spans(early + late)
    # Closed stretches and nodes without reports are kept as they are.
    assert kept.filter("valid_to IS NULL").count() == 1 and kept.count() >= old.count() - 2


@pytest.mark.parametrize("chunk_seconds", [600, 86_400])
def test_as_of(spark, chunk_seconds):
    rows, rng = reports(3), random.Random(4)
    asked = [(rng.choice([1, 2, 3, 4]), START + timedelta(minutes=rng.randrange(-60, 60 * 210)), i) for i in range(200)]
    asked += [asked[0], (None, START, 900), (1, None, 901), (1, min(r[1] for r in rows if r[0] == 1), 902)]
    table = history.validity(spark.createDataFrame(rows, REPORT), ["status"])
    questions = spark.createDataFrame(asked, "node_id int, ts timestamp_ntz, id int")
    got = history.as_of(questions, table, ["status"], chunk_seconds=chunk_seconds).collect()
    expected = []
    for node, ts, i in asked:
        hit = [s for s in spans(rows).get(node, []) if ts and s[1] <= ts and (s[2] is None or ts < s[2])]
        expected.append((i, hit[0][0] if hit else None, hit[0][1] if hit else None))
    assert sorted(map(repr, ((r.id, r.status, r.valid_from) for r in got))) == sorted(map(repr, expected))


def test_availability_per_window(spark):
    rows = reports(5)
    end = START + timedelta(hours=190)
    table = history.validity(spark.createDataFrame(rows, REPORT), ["status"])
    up = F.coalesce(F.col("status") == "up", F.lit(False))
    got = {
        (r.node_id, r.window_start.replace(tzinfo=None)): (r.up_micros, r.known_micros)
        for r in history.availability_per_window(table, up, 7200, F.lit(end)).collect()
    }
    expected = {}
    for node, own in spans(rows).items():
        for status, a, b in own:
            b, at = min(b or end, end), a
            while at < b:
                start = START + timedelta(hours=2) * ((at - START) // timedelta(hours=2))
                stop = min(b, start + timedelta(hours=2))
                one = (stop - at) // timedelta(microseconds=1)
                u, k = expected.get((node, start), (0, 0))
                expected[node, start] = (u + one * (status == "up"), k + one)
                at = stop
    assert got == expected


@pytest.mark.parametrize("chunk_seconds", [600, 86_400])
def test_drift_periods(spark, chunk_seconds):
    rng = random.Random(6)
    kind = "node int, key string, ts timestamp, seq long, value string"

    def side(n):
        return [
            (rng.choice([1, 1, 2]), rng.choice("ab"), START + timedelta(minutes=rng.randrange(3000)), i, rng.choice(["x", "y", None]))
            for i in range(n)
        ]

    left, right = side(80), side(120)
    tables = [spark.createDataFrame([*s, (None, "a", START, 0, "x"), (1, "a", None, 0, "x")], kind) for s in (left, right)]
    got = history.drift_periods(*tables, chunk_seconds=chunk_seconds).collect()
    expected = []
    for node, key in {(r[0], r[1]) for r in left + right}:
        last, own = {}, []
        lines = [(r[2], r[3], s, r[4]) for s, rows in enumerate((left, right)) for r in rows if r[:2] == (node, key)]
        for ts in sorted({x[0] for x in lines}):
            for x in sorted((x for x in lines if x[0] == ts), key=lambda x: x[1]):
                last[x[2]] = x[3]
            e, o = last.get(0), last.get(1)
            state = (
                "none" if e is None and o is None else "missing" if o is None else "extra" if e is None
                else "ok" if e == o else "changed"
            )
            if not own or own[-1][:3] != (state, e, o):
                own.append((state, e, o, ts))
        ends = [x[3] for x in own[1:]] + [None]
        expected += [(node, key, *x, end) for x, end in zip(own, ends) if x[0] != "none"]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))


def test_a_busy_node_is_cut(spark):
    """A third of all reports come from one node within an hour; the result is that of the rule."""
    rows = spark.range(90_000).selectExpr(
        "cast(if(id % 3 = 0, 1, 2 + id % 500) as int) as node_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 0.04) as ts",
        "id as seq",
        "if(id % 6 = 0, 'up', 'down') as status",
    )
    got = history.validity(rows, ["status"], chunk_seconds=60).groupBy("node_id").count()
    assert {r["node_id"]: r["count"] for r in got.collect()}[1] == 30_000
