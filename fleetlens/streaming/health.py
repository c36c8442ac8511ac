"""Health changes and readiness from streams, with the batch operators doing the work.

Spark's watermark and state decide when a piece of a node's history is final: ``finished_chunks``
groups rows by node and time chunk in append mode, so each chunk comes out once, complete, and no
earlier chunk of its node comes later. The sinks only join finished chunks to one carried row
per node (or the starts still open) and run the batch operators on them. Rows behind the watermark
are dropped by Spark and counted in its progress reports (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.functions.ranking import time_chunk
from fleetlens.functions.scalars import is_true
from fleetlens.operators.probes import NODE, changes_of_health, readiness, with_streaks
from fleetlens.streaming.versions import BucketedTable, VersionedTable, adaptive

NODE_SCHEMA = "node_id long"


def probe_schema(node: str = NODE_SCHEMA) -> str:
    return f"{node}, ts timestamp, seq long, ok boolean"


def timeline_schema(node: str = NODE_SCHEMA) -> str:
    return f"{node}, ts timestamp, seq long, is_start boolean, ok boolean"


def _names(node: str) -> list[str]:
    return [field.split()[0] for field in node.split(",")]


def finished_chunks(
    rows: DataFrame,
    delay: str,
    chunk_seconds: int = 3600,
    keys: Sequence[str] = NODE,
    pieces: int = 32,
) -> DataFrame:
    """Rows of each (node, time chunk) that the watermark has passed, as ``pieces`` rows at most.

    Run it in append mode. Rows of a chunk are dealt to its pieces by a hash of ``seq``, and all pieces of a chunk
    come out together, so a burst of one node is spread over as many rows of Spark's state and as
    many tasks. Rows without a time belong to no chunk.
    """
    payload = [c for c in rows.columns if c not in keys]
    piece = F.pmod(F.xxhash64("seq"), F.lit(pieces)).alias("_piece")
    return (
        rows.withWatermark("ts", delay)
        .groupBy(*keys, F.window("ts", f"{chunk_seconds} seconds").alias("_chunk"), piece)
        .agg(F.collect_list(F.struct(*payload)).alias("rows"))
        .select(*keys, F.col("_chunk.end").alias("until"), "rows")
    )


def _opened(batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    return batch.select(*keys, F.explode("rows").alias("_r")).select(*keys, "_r.*")


class HealthSink:
    """``foreachBatch`` sink for finished chunks of probes: writes changes to ``{path}/changes``.

    The state is one row per node: its failures in a row and its count of good probes. ``node``
    declares the columns that identify a node.
    """

    def __init__(
        self,
        path: str,
        retries: int = fv.HEALTH_RETRIES,
        chunk_seconds: int = 3600,
        node: str = NODE_SCHEMA,
    ):
        self.path, self.retries, self.chunk_seconds = path, retries, chunk_seconds
        self.keys = _names(node)
        self.state = BucketedTable(f"{path}/state", f"{node}, streak long, oks long", self.keys)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        keys, spark = self.keys, batch.sparkSession
        rows = _opened(batch, keys)
        staged = VersionedTable(f"{self.path}/staged", rows.schema)
        staged.write(batch_id, rows)
        with adaptive(spark):
            final = staged.read(spark, batch_id)
            # Only nodes with finished chunks go on from what was carried.
            known = self.state.read(spark, batch_id - 1)
            carry = known.join(final.select(*keys).distinct(), keys, "left_semi")
            chunk = time_chunk(final, "ts", self.chunk_seconds)
            marked = with_streaks(final, chunk, carry, keys).persist()
            changes_of_health(marked, self.retries, keys).write.mode("overwrite").parquet(
                f"{self.path}/changes/batch={batch_id}"
            )
            newest = F.max(F.struct("ts", "seq", "streak", "oks_before", "ok")).alias("_l")
            last = marked.groupBy(*keys).agg(newest).select(
                *keys,
                F.col("_l.streak").cast("long").alias("streak"),
                (F.col("_l.oks_before") + F.col("_l.ok").cast("int")).alias("oks"),
            )
            self.state.replace(batch_id, last)
            marked.unpersist()


class ReadinessSink:
    """``foreachBatch`` sink for finished chunks of starts and polls: outcomes to ``{path}/outcomes``.

    A start is settled by a good poll, by ``max_polls`` polls, or when finished chunks reach past
    its horizon. Until then it stays in the state, with the polls that an open start can see.
    """

    def __init__(
        self,
        path: str,
        max_polls: int = fv.READY_POLLS,
        horizon_seconds: int = fv.READY_HORIZON_SECONDS,
        chunk_seconds: int = 3600,
        node: str = NODE_SCHEMA,
    ):
        self.path, self.max_polls = path, max_polls
        self.horizon_seconds, self.chunk_seconds = horizon_seconds, chunk_seconds
        self.keys = _names(node)
        self.rows = VersionedTable(f"{path}/open", timeline_schema(node))
        self.clock = VersionedTable(f"{path}/clock", "until timestamp")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = VersionedTable(f"{self.path}/staged", batch.schema)
        staged.write(batch_id, batch)
        with adaptive(spark):
            held = staged.read(spark, batch_id)
            # Append mode gives out all chunks up to the watermark, so all rows before the end of any
            # chunk seen are final.
            clock = self.clock.read(spark, batch_id - 1).unionByName(held.select("until"))
            self.clock.write(batch_id, clock.agg(F.max("until").alias("until")))
            until = self.clock.read(spark, batch_id).first().until
            self._settle(_opened(held, self.keys), batch_id, until)

    def flush(self, spark: SparkSession, last_batch_id: int) -> None:
        """End of input: what is still open is settled in a batch of its own."""
        empty = spark.createDataFrame([], self.rows.schema)
        self._settle(empty, last_batch_id + 1, None, flush=True)

    def _settle(self, final: DataFrame, batch_id: int, until, flush: bool = False) -> None:
        spark, keys = final.sparkSession, self.keys
        horizon = F.make_dt_interval(secs=F.lit(self.horizon_seconds))
        rows = self.rows.read(spark, batch_id - 1).unionByName(final)
        starts = rows.filter("is_start").withColumnRenamed("seq", "start_id")
        polls = rows.filter("NOT is_start")
        outcome = readiness(
            starts, polls, self.max_polls, self.horizon_seconds, keys, self.chunk_seconds
        )
        over = F.lit(flush) if until is None else F.col("ts") + horizon < F.lit(until)
        settled = outcome.filter(F.col("ready") | (F.col("polls_after") >= self.max_polls) | over)
        settled = settled.drop("polls_after")
        target = f"{self.path}/outcomes/batch={batch_id}"
        settled.write.mode("overwrite").parquet(target)
        done = spark.read.schema(settled.schema).parquet(target)
        still_open = starts.join(done, [*keys, "start_id"], "left_anti").withColumnRenamed(
            "start_id", "seq"
        )
        if until is not None:
            polls = polls.filter(F.col("ts") + horizon >= F.lit(until))
        self.rows.write(batch_id, still_open.unionByName(polls))


def stream_good_polls(
    starts: DataFrame,
    polls: DataFrame,
    delay: str,
    horizon_seconds: int = fv.READY_HORIZON_SECONDS,
    keys: Sequence[str] = NODE,
) -> DataFrame:
    """(keys, start_id, ts, poll_ts) of each start and good poll after it within the horizon, or one null.

    A left outer join of two streams by time: ``starts`` (keys, start_id, ts) and ``polls`` (keys, ts, ok). Both
    have a watermark of ``delay``; a start without a good poll comes out when both have passed its horizon,
    and Spark drops what neither needs any more. Run it in append mode. ``first_good_poll``
    settles the starts. A row with a null key moves the watermark of both sides.
    """
    clock = F.col(keys[0]).isNull()
    # Keys are compared as a struct: Spark would drop null keys below the watermark, and clock rows with them.
    left = starts.withWatermark("ts", delay).withColumn("_key", F.struct(*keys))
    right = (
        polls.filter(is_true(F.col("ok")) | clock)
        .select(F.struct(*keys).alias("_poll_key"), F.col("ts").alias("poll_ts"))
        .withWatermark("poll_ts", delay)
    )
    near = (
        (F.col("_key") == F.col("_poll_key"))
        & (F.col("poll_ts") > F.col("ts"))
        & (F.col("poll_ts") <= F.col("ts") + F.expr(f"INTERVAL {horizon_seconds} SECONDS"))
    )
    return left.join(right, near, "left_outer").select(*keys, "start_id", "ts", "poll_ts")


def first_good_poll(met: DataFrame, keys: Sequence[str] = NODE) -> DataFrame:
    """(keys, start_id, ts, ready, ready_ts, message) of each start in ``met``, as ``stream_good_polls`` gives it."""
    seen, not_seen = fv.POLL_MESSAGES["start"]
    found = met.dropna(subset=[*keys]).groupBy(*keys, "start_id", "ts").agg(F.min("poll_ts").alias("ready_ts"))
    ready = F.col("ready_ts").isNotNull()
    return found.withColumns({"ready": ready, "message": F.when(ready, seen).otherwise(not_seen)})
