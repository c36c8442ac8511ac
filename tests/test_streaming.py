"""Every stream against its batch twin, with the input split over many files and out of order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import changes, probes, status
from fleetlens.sources import logs
from fleetlens.streaming.changes import AppliedSink, SnapshotSink, stream_dedup_changes
from fleetlens.streaming.health import (
    HealthSink,
    ReadinessSink,
    finished_chunks,
    first_good_poll,
    probe_schema,
    stream_good_polls,
    timeline_schema,
)
from fleetlens.streaming.status import CurrentStatusSink, stream_latest_status
from tests.test_changes import CHANGE, frames, live, make, replay

START = datetime(2024, 1, 1)
DELAY = 120
LAG = f"{DELAY} seconds"
PROBE_SCHEMA = probe_schema()
TIMELINE_SCHEMA = timeline_schema()


def timeline(seed, count=1500):
    """Rows in time order, then moved by less than the delay. Node 0 has most of them."""
    seeded = random.Random(seed)
    rows = []
    for seq in range(count):
        node = 0 if seeded.random() < 0.5 else seeded.randrange(8)
        rows.append((node, START + timedelta(seconds=seq * 3 + seeded.randrange(3)), seq, seeded.random() < 0.35))
    return sorted(rows, key=lambda r: r[1] + timedelta(seconds=seeded.randrange(DELAY)))


def write_files(spark, rows, schema, folder, files):
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], schema)
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, sink, folder, mode="append"):
    query = (
        stream.writeStream.foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query.lastProgress["batchId"]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def end_of_input(*more):
    """A row far behind all others: it moves the watermark past them."""
    return (None, START + timedelta(days=400), None, *more)


CHANGES_SCHEMA = "node_id long, ts timestamp, seq long, from_status string, to_status string"


@pytest.mark.parametrize("files", [1, 6])
def test_health_equals_batch(spark, tmp_path, files):
    rows = timeline(1)
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    write_files(spark, rows, PROBE_SCHEMA, source, files)
    stream = write_files(spark, [end_of_input(None)], PROBE_SCHEMA, source, 1)
    run(finished_chunks(stream, LAG, 60), HealthSink(folder, chunk_seconds=60), folder)
    got = spark.read.schema(CHANGES_SCHEMA).parquet(f"{folder}/changes/batch=*")
    expected = probes.health_changes(spark.createDataFrame(rows, PROBE_SCHEMA), chunk_seconds=60)
    assert rows_of(got) == rows_of(expected)


@pytest.mark.parametrize("files", [1, 6])
def test_readiness_equals_batch(spark, tmp_path, files):
    rows = [(n, ts, seq, seq % 11 == 0, ok and seq % 4 == 0) for n, ts, seq, ok in timeline(2)]
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    write_files(spark, rows, TIMELINE_SCHEMA, source, files)
    stream = write_files(spark, [end_of_input(None, None)], TIMELINE_SCHEMA, source, 1)
    sink = ReadinessSink(folder, max_polls=6, horizon_seconds=90, chunk_seconds=30)
    sink.flush(spark, run(finished_chunks(stream, LAG, 30), sink, folder))
    frame = spark.createDataFrame(rows, TIMELINE_SCHEMA)
    expected = probes.readiness(
        frame.filter("is_start").withColumnRenamed("seq", "start_id"), frame.filter("NOT is_start"), 6, 90
    ).drop("polls_after")
    got = spark.read.schema(expected.schema).parquet(f"{folder}/outcomes/batch=*")
    assert rows_of(got) == rows_of(expected)
    early = got.filter(F.input_file_name().contains("batch=1/")).count()
    assert files == 1 or early < got.count()


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, PROBE_SCHEMA).groupBy(
        "node_id", F.window("ts", "60 seconds").alias("w")
    ).agg(F.collect_list(F.struct("ts", "seq", "ok")).alias("rows")).select("node_id", F.col("w.end").alias("until"), "rows")


def test_repeated_batch_gives_the_same_result(spark, tmp_path):
    rows = sorted(timeline(3), key=lambda r: r[1])
    sink = HealthSink(str(tmp_path), chunk_seconds=60)
    edges = [START, START + timedelta(minutes=25), START + timedelta(minutes=50), START + timedelta(days=1)]
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        batch = chunks_of(spark, [r for r in rows if low <= r[1] < high])
        sink(batch, i)
        sink(batch, i)
    got = spark.read.schema(CHANGES_SCHEMA).parquet(f"{tmp_path}/changes/batch=*")
    expected = probes.health_changes(spark.createDataFrame(rows, PROBE_SCHEMA))
    assert rows_of(got) == rows_of(expected)


def test_stream_continues_after_a_restart(spark, tmp_path):
    rows = timeline(8)
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    for part in (rows[:600], rows[600:900], rows[900:], [end_of_input(None)]):
        stream = write_files(spark, part, PROBE_SCHEMA, source, 2 if len(part) > 1 else 1)
        run(finished_chunks(stream, LAG, 60), HealthSink(folder, chunk_seconds=60), folder)
    got = spark.read.schema(CHANGES_SCHEMA).parquet(f"{folder}/changes/batch=*")
    expected = probes.health_changes(spark.createDataFrame(rows, PROBE_SCHEMA))
    assert rows_of(got) == rows_of(expected)


def test_no_engine_internals():
    import pathlib

    import fleetlens.streaming as package

    for file in pathlib.Path(package.__file__).parent.glob("*.py"):
        assert "_jvm" not in file.read_text()


def test_current_status_ignores_late_reports(spark, tmp_path):
    rows = timeline(4)
    random.Random(4).shuffle(rows)
    stream = write_files(spark, rows, PROBE_SCHEMA, str(tmp_path / "in"), 5)
    folder = str(tmp_path / "out")
    sink = CurrentStatusSink(f"{folder}/current", PROBE_SCHEMA)
    last = run(stream_latest_status(stream), sink, folder, "update")
    expected = status.latest_status(spark.createDataFrame(rows, PROBE_SCHEMA))
    current = sink.current(spark, last)
    assert rows_of(current) == rows_of(expected)
    sink(spark.createDataFrame(rows[:0], PROBE_SCHEMA), last + 1)
    assert rows_of(sink.current(spark, last + 1)) == rows_of(expected)
    # One node's report rewrites one bucket.
    sink(spark.createDataFrame([(3, START + timedelta(days=9), 9_999, True)], PROBE_SCHEMA), last + 2)
    written = spark.read.parquet(f"{folder}/current/rows")
    assert written.filter(F.col("version") == last + 2).select("bucket").distinct().count() == 1
    newest = {r["node_id"]: r["seq"] for r in sink.current(spark, last + 2).collect()}
    assert newest[3] == 9_999 and len(newest) == expected.count()


@pytest.mark.parametrize("salts", [1, 4])
def test_dedup_over_several_batches(spark, tmp_path, salts):
    seeded = random.Random(5)
    rows = [(seeded.randrange(3), seeded.randrange(200), START + timedelta(seconds=i)) for i in range(900)]
    rows += [(9, 9, START)] * 600
    seeded.shuffle(rows)
    stream = write_files(spark, rows, "source long, seq long, ts timestamp", str(tmp_path / "in"), 6)
    query = (
        stream_dedup_changes(stream, "1 hour", salts)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("source", "seq")
    assert rows_of(got) == sorted({r[:2] for r in rows}, key=str)


def test_snapshot_follows_the_stream(spark, tmp_path):
    base, rows = make(6, count=600)
    snapshot, _ = frames(spark, base, rows)
    shuffled = rows[:]
    random.Random(6).shuffle(shuffled)
    stream = write_files(spark, shuffled, CHANGE, str(tmp_path / "in"), 6)
    sink = SnapshotSink(str(tmp_path / "delta"), changes.live_rows(snapshot), "id")
    last = run(stream, sink, str(tmp_path))
    merged = sink.snapshot(spark, last)
    assert live(merged) == replay(base, rows)
    folded = sink.fold(spark, last, str(tmp_path / "folded"))
    again = SnapshotSink(str(tmp_path / "delta2"), folded, "id")
    again(spark.createDataFrame(rows[:300], CHANGE), 0)
    assert live(again.snapshot(spark, 0)) == replay(base, rows)


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    base, rows = make(7, count=300)
    snapshot, _ = frames(spark, base, rows)
    sink = SnapshotSink(str(tmp_path), changes.live_rows(snapshot), "id", buckets=16)
    for i, part in enumerate((rows[:250], rows[250:251], rows[251:251], rows[251:])):
        batch = spark.createDataFrame(part, CHANGE)
        sink(batch, i)
        sink(batch, i)
    assert live(sink.snapshot(spark, 3)) == replay(base, rows)
    written = spark.read.parquet(str(tmp_path / "rows")).groupBy("version").agg(F.countDistinct("bucket"))
    counts = dict(tuple(r) for r in written.collect())
    assert counts[1] == 1 < counts[0]


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("[2024-05-01 10:00:01] ERROR: bad\nnoise\n")
    lines = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    query = (
        logs.parse_tool_logs(lines)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("parsed")).collect()
    assert [(r.level, r.message) for r in rows] == [("ERROR", "bad"), (None, "noise")]


def test_a_burst_of_one_node_is_dealt_to_many_state_rows(spark, tmp_path):
    """A third of all rows come from one node in one hour; no state row holds a large part of them."""
    rows = [(1 if i % 3 == 0 else i + 10, START + timedelta(seconds=i % 3000), i, i % 5 > 0) for i in range(6000)]
    stream = write_files(spark, rows + [end_of_input(None)], PROBE_SCHEMA, str(tmp_path / "in"), 1)
    held = []

    def sink(batch, batch_id):
        held.extend(r["n"] for r in batch.filter("node_id = 1").selectExpr("size(rows) AS n").collect())

    run(finished_chunks(stream, LAG, 3600), sink, str(tmp_path))
    assert sum(held) == 2000 and len(held) == 32 and max(held) < 120
    again = write_files(spark, rows + [end_of_input(None)], PROBE_SCHEMA, str(tmp_path / "in2"), 1)
    folder = str(tmp_path / "out")
    run(finished_chunks(again, LAG, 3600), HealthSink(folder), folder)
    got = spark.read.schema(CHANGES_SCHEMA).parquet(f"{folder}/changes/batch=*")
    expected = probes.health_changes(spark.createDataFrame(rows, PROBE_SCHEMA))
    assert rows_of(got) == rows_of(expected)


def test_applied_sets_pass_each_change_once_however_late(spark, tmp_path):
    seeded = random.Random(9)
    kind = "source int, seq long, note string"
    sent = [(seeded.choice([1, 1, 1, 2]), seeded.randrange(400), "n") for _ in range(500)]
    sink = AppliedSink(str(tmp_path), width=64)
    batches = [sent[:200], sent[200:], sent[:50], [], [(2, 10**9, "far"), (None, 1, "no source"), (1, None, "no id")]]
    for i, part in enumerate(batches):
        batch = spark.createDataFrame(part, kind)
        sink(batch, i)
        sink(batch, i)
    got = [(r["source"], r["seq"]) for r in spark.read.schema(kind).parquet(f"{tmp_path}/rows/batch=*").collect()]
    assert sorted(map(str, got)) == sorted(map(str, {r[:2] for part in batches for r in part}))
    held = {(r["source"], i) for r in sink.applied(spark, 4).collect() for i in range(r["low"], r["high"] + 1)}
    assert held == {r[:2] for part in batches for r in part if None not in r[:2]}
    holes = {(r["source"], i) for r in sink.gaps(spark, 4).filter("high < 1000").collect() for i in range(r["low"], r["high"] + 1)}
    assert not holes & held and all(any((s, j) in held for j in range(i)) for s, i in holes)


def test_readiness_by_time_only(spark, tmp_path):
    rows = [(n, ts, seq, seq % 7 == 0, ok) for n, ts, seq, ok in timeline(10, 700)]
    stream = write_files(spark, rows, TIMELINE_SCHEMA, str(tmp_path / "in"), 4)
    spark.createDataFrame([end_of_input(None, None)], TIMELINE_SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    starts = stream.filter("is_start OR node_id IS NULL").withColumnRenamed("seq", "start_id")
    polls = stream.filter("NOT is_start OR node_id IS NULL").select("node_id", "ts", "ok")
    query = (
        stream_good_polls(starts, polls, LAG, 60)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = first_good_poll(spark.read.parquet(str(tmp_path / "out"))).select("node_id", "start_id", "ready_ts")
    expected = []
    for n, ts, seq, start, _ in rows:
        if start:
            good = [t for m, t, _, s, ok in rows if m == n and not s and ok and ts < t <= ts + timedelta(seconds=60)]
            expected.append((n, seq, min(good, default=None)))
    assert rows_of(got) == sorted(expected, key=str) and any(x[2] is None for x in expected)


def test_steps_of_a_sink_are_sized_by_their_data(spark, tmp_path):
    """A batch of a stream with state runs without adaptive execution; a sink's own jobs have it again."""
    seen = []

    class Sink(ReadinessSink):
        def _settle(self, final, batch_id, until, flush=False):
            seen.append((batch_id, final.sparkSession.conf.get("spark.sql.adaptive.enabled")))
            super()._settle(final, batch_id, until, flush)
            seen.append((batch_id, final.sparkSession.conf.get("spark.sql.adaptive.enabled")))

    rows = [(n, ts, seq, seq % 11 == 0, ok) for n, ts, seq, ok in timeline(2, 400)]
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    write_files(spark, rows, TIMELINE_SCHEMA, source, 2)
    stream = write_files(spark, [end_of_input(None, None)], TIMELINE_SCHEMA, source, 1)
    sink = Sink(folder, horizon_seconds=90, chunk_seconds=30)
    last = run(finished_chunks(stream, LAG, 30), sink, folder)
    assert {on for _, on in seen} == {"true"}
    # A batch without a finished chunk keeps what is open.
    held = rows_of(sink.rows.read(spark, last))
    sink(spark.createDataFrame([], finished_schema()), last + 1)
    assert rows_of(sink.rows.read(spark, last + 1)) == held


def finished_schema():
    return "node_id long, until timestamp, rows array<struct<ts: timestamp, seq: long, is_start: boolean, ok: boolean>>"


def test_a_change_passed_before_does_not_go_into_the_set_again(spark, tmp_path):
    kind = "source int, seq long, note string"
    sink = AppliedSink(str(tmp_path))
    sink(spark.createDataFrame([(1, i, "n") for i in range(50)], kind), 0)
    sink(spark.createDataFrame([(1, i, "n") for i in range(40, 60)] * 3, kind), 1)
    assert spark.read.schema(kind).parquet(f"{tmp_path}/rows/batch=1").count() == 10
    assert rows_of(sink.applied(spark, 1)) == [(1, 0, 59)]
    assert (tmp_path / "staged").exists()
