"""Streams over the files of a table, run to the end of their input and read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.operators import changes as batch_changes
from fleetlens.plans.registry import query
from fleetlens.plans.run_queries import APPLIED, CHANGES, HORIZON, POLLS, READINESS
from fleetlens.plans.status_queries import LATEST
from fleetlens.plans.views import Fleet
from fleetlens.session import work_folder
from fleetlens.streaming.changes import AppliedSink, SnapshotSink, stream_dedup_changes
from fleetlens.streaming.health import (
    HealthSink,
    ReadinessSink,
    finished_chunks,
    first_good_poll,
    stream_good_polls,
)
from fleetlens.streaming.status import CurrentStatusSink, stream_latest_status

DELAY = "1 hour"
PIECES = 3

# The copies of a line in the given table lie up to seven years apart.
REPLAY_DELAY = "4000 days"


def in_pieces(f: Fleet, rows: DataFrame, folder: str, run, end: bool = False) -> int:
    """Write ``rows`` to ``{folder}/in`` in pieces of event time; ``run`` the stream after each.

    Every piece is a restart of the stream from its checkpoint, so state has to carry over. With ``end``
    a last row far behind all others moves the watermark past them; its node is null. Returns the
    number of the last batch.
    """
    source = f"{folder}/in"
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / PIECES
    stream, batch = None, -1
    for i in range(PIECES):
        low = F.lit(True) if i == 0 else F.col("ts") >= F.lit(first + i * step)
        high = F.lit(True) if i == PIECES - 1 else F.col("ts") < F.lit(first + (i + 1) * step)
        rows.filter(low & high).write.mode("append").parquet(source)
        stream = f.spark.readStream.schema(rows.schema).parquet(source)
        batch = run(stream)
    if end:
        late = [c.alias(n) for n, c in (("ts", F.lit(last + timedelta(days=3650))),)]
        sentinel = f.spark.range(1).select(
            *[late[0] if n == "ts" else F.lit(None).cast(t).alias(n) for n, t in rows.dtypes]
        )
        sentinel.write.mode("append").parquet(source)
        batch = run(f.spark.readStream.schema(rows.schema).parquet(source))
    return batch


def run_batches(rows: DataFrame, sink, folder: str, mode: str = "append") -> int:
    """Run ``sink`` for all input; returns the number of the last batch."""
    stream = (
        rows.writeStream.foreachBatch(sink)
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    return stream.lastProgress["batchId"]


def outputs(f: Fleet, folder: str, schema: str) -> DataFrame:
    return f.spark.read.schema(schema).parquet(f"{folder}/batch=*").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )


def probes_of(f: Fleet) -> DataFrame:
    return f.events.select(
        F.col("user_id").alias("node_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("event_type").isin("signup", "view").alias("ok"),
        "value",
    )


@query("ss1_stream_latest_status", LATEST)
def latest(f: Fleet) -> DataFrame:
    folder = work_folder(f.spark, "latest")
    rows = probes_of(f)
    schema = "node_id long, ts timestamp, seq long, ok boolean, value double"
    sink = CurrentStatusSink(f"{folder}/current", schema)
    last = in_pieces(
        f, rows, folder, lambda s: run_batches(stream_latest_status(s), sink, folder, "update")
    )
    return sink.current(f.spark, last).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("ss2_stream_health", CHANGES)
def health(f: Fleet) -> DataFrame:
    folder = work_folder(f.spark, "health")
    sink = HealthSink(folder)
    rows = probes_of(f).drop("value")
    in_pieces(
        f, rows, folder, lambda s: run_batches(finished_chunks(s, DELAY), sink, folder), end=True
    )
    schema = "node_id long, ts timestamp, seq long, from_status string, to_status string"
    return outputs(f, f"{folder}/changes", schema)


@query("ss3_stream_readiness", READINESS)
def readiness(f: Fleet) -> DataFrame:
    folder = work_folder(f.spark, "readiness")
    rows = f.events.select(
        F.col("user_id").alias("node_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "signup").alias("is_start"),
        (F.col("event_type") == "view").alias("ok"),
    )
    sink = ReadinessSink(folder, POLLS, HORIZON)
    last = in_pieces(
        f, rows, folder, lambda s: run_batches(finished_chunks(s, DELAY), sink, folder), end=True
    )
    sink.flush(f.spark, last)
    schema = (
        "node_id long, start_id long, ts timestamp, ready boolean, ready_ts timestamp, "
        "polls_used long, message string"
    )
    return outputs(f, f"{folder}/outcomes", schema).withColumn(
        "ready_ts", F.col("ready_ts").cast("timestamp_ntz")
    )


@query(
    "ss4_stream_dedup_changes",
    "SELECT DISTINCT source, seq, true AS is_input_row FROM {v_replayed}",
)
def dedup(f: Fleet) -> DataFrame:
    """Kept rows; each must be a whole row of the input, whichever copy came first."""
    folder = work_folder(f.spark, "dedup")
    rows = f.lineitem.select(
        F.col("l_linenumber").alias("source"),
        F.col("l_orderkey").alias("seq"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        "l_partkey",
        "l_quantity",
    )

    def run(stream: DataFrame) -> int:
        written = (
            stream_dedup_changes(stream, REPLAY_DELAY)
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{folder}/rows")
        )
        written.awaitTermination()
        return -1

    in_pieces(f, rows, folder, run)
    kept = f.spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    given = rows.distinct().withColumn("is_input_row", F.lit(True))
    return kept.join(given, rows.columns, "left").select(
        "source", "seq", F.coalesce("is_input_row", F.lit(False)).alias("is_input_row")
    )


@query("ss5_stream_apply_changes", APPLIED)
def apply(f: Fleet) -> DataFrame:
    folder = work_folder(f.spark, "snapshot")
    rows = f.events.select(
        F.col("user_id").alias("node_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete")
        .when(F.col("event_type") == "signup", "insert")
        .otherwise("update")
        .alias("op"),
        F.col("event_type").alias("label"),
        F.col("value").alias("amount"),
        "ts",
    )
    sink = SnapshotSink(f"{folder}/versions", f.v_base, "node_id")
    last = in_pieces(f, rows, folder, lambda s: run_batches(s, sink, folder))
    return batch_changes.live_rows(sink.snapshot(f.spark, last))


@query(
    "ss3_stream_ready_in_time",
    f"""
    SELECT s.node_id, s.start_id, s.ts, min(p.ts) IS NOT NULL AS ready, min(p.ts) AS ready_ts,
           CASE WHEN min(p.ts) IS NOT NULL THEN '{fv.POLL_MESSAGES["start"][0]}'
                ELSE '{fv.POLL_MESSAGES["start"][1]}' END AS message
    FROM {{v_start}} AS s
    LEFT JOIN {{v_poll}} AS p ON p.node_id = s.node_id AND p.ok AND p.ts > s.ts
                             AND p.ts <= s.ts + INTERVAL {HORIZON} SECOND
    GROUP BY s.node_id, s.start_id, s.ts""",
)
def ready_in_time(f: Fleet) -> DataFrame:
    """Readiness bounded by time only, from a join of two streams."""
    folder = work_folder(f.spark, "ready-in-time")
    rows = f.events.select(
        F.col("user_id").alias("node_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("start_id"),
        (F.col("event_type") == "signup").alias("is_start"),
        (F.col("event_type") == "view").alias("ok"),
    )

    def run(stream: DataFrame) -> int:
        starts = stream.filter("is_start OR node_id IS NULL").select("node_id", "start_id", "ts")
        polls = stream.select("node_id", "ts", "ok")
        written = (
            stream_good_polls(starts, polls, DELAY, HORIZON)
            .writeStream.format("parquet")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{folder}/met")
        )
        written.awaitTermination()
        return -1

    in_pieces(f, rows, folder, run, end=True)
    met = f.spark.read.schema("node_id long, start_id long, ts timestamp, poll_ts timestamp").parquet(
        f"{folder}/met"
    )
    return first_good_poll(met).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("ts", "ready_ts")}
    )


@query(
    "ss4_stream_applied_sets",
    "SELECT DISTINCT source, seq, true AS is_input_row FROM {v_replayed}",
)
def applied_sets(f: Fleet) -> DataFrame:
    """Each change once, with intervals of ids for state; each must be a whole row of the input."""
    folder = work_folder(f.spark, "applied")
    rows = f.lineitem.select(
        F.col("l_linenumber").alias("source"),
        F.col("l_orderkey").alias("seq"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        "l_partkey",
        "l_quantity",
    )
    kind = rows.schema["source"].dataType.simpleString()
    sink = AppliedSink(f"{folder}/sink", f"source {kind}")
    in_pieces(f, rows, folder, lambda s: run_batches(s, sink, folder))
    kept = f.spark.read.schema(rows.schema).parquet(f"{folder}/sink/rows/batch=*")
    given = rows.distinct().withColumn("is_input_row", F.lit(True))
    return kept.join(given, rows.columns, "left").select(
        "source", "seq", F.coalesce("is_input_row", F.lit(False)).alias("is_input_row")
    )
