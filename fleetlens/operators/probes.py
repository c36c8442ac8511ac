"""Probe histories: readiness after a start, streaks of failed probes, health changes.

All three are linear passes. Every history is cut into time chunks, so a node with most of all
probes is spread over many tasks; no operator pairs rows of a group. ``keys`` are the
columns that identify a node, such as ``("cluster_id", "node_id")``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.functions.ranking import CHUNK, time_chunk
from fleetlens.functions.scalars import is_true

NODE = ("node_id",)

# Order of rows with the same time: a poll at the moment of a start comes before it.
POLL, START = 0, 1


def _scan_polls(timeline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Within ``keys``: running poll number and next good poll (time and number)."""
    cell = Window.partitionBy(*keys)
    upward = cell.orderBy("ts", "_kind", "seq")
    downward = cell.orderBy(F.desc("ts"), F.desc("_kind"), F.desc("seq"))
    up_to_here = upward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = timeline.withColumn("_no", F.count_if(F.col("_kind") == POLL).over(up_to_here))
    good = F.when(F.col("_ok"), F.struct("ts", "_no"))
    after = downward.rowsBetween(Window.unboundedPreceding, -1)
    from_here = downward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.withColumn("_next", F.min(good).over(after))


def _poll_offsets(scanned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per chunk: polls in the chunks before it, polls of the node, first good poll behind it."""
    parts = scanned.groupBy(*keys, CHUNK).agg(
        F.count_if(F.col("_kind") == POLL).alias("_n"),
        F.min(F.when(F.col("_ok"), F.struct("ts", "_no"))).alias("_good"),
    )
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    reverse = Window.partitionBy(*keys).orderBy(F.desc(CHUNK))
    return (
        parts.withColumns(
            {
                "_before": F.coalesce(
                    F.sum("_n").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ),
                "_total": F.sum("_n").over(Window.partitionBy(*keys)),
            }
        )
        .withColumn("_good", _shifted("_good", "_before"))
        .select(
            *keys,
            CHUNK,
            "_before",
            "_total",
            F.min("_good")
            .over(reverse.rowsBetween(Window.unboundedPreceding, -1))
            .alias("_later"),
        )
    )


def _shifted(good: str, offset: str) -> Column:
    """A good poll with its number counted from the start of the node's history."""
    number = F.col(f"{good}._no") + F.col(offset)
    return F.when(
        F.col(good).isNotNull(), F.struct(F.col(f"{good}.ts").alias("ts"), number.alias("_no"))
    )


def readiness(
    starts: DataFrame,
    polls: DataFrame,
    max_polls: int = fv.READY_POLLS,
    horizon_seconds: int = fv.READY_HORIZON_SECONDS,
    keys: Sequence[str] = NODE,
    chunk_seconds: int = 3600,
    action: str = "start",
) -> DataFrame:
    """For each start, the first good probe among the next ``max_polls`` within the horizon.

    ``starts`` holds ``node_id, start_id, ts``; ``polls`` holds ``node_id, seq, ts, ok``. Both form
    one timeline per node. There, the number of polls so far and the next good poll with its
    number settle each start, so starts are never paired with polls. Timelines are cut into time
    chunks; one small row per chunk holds its poll count and its first good poll. ``action`` is
    start, restart or stop; after a stop, a probe is good when the node does not answer. A start
    without node or time is not ready.
    """
    keys = list(keys)
    good_poll = is_true(~F.col("ok") if action == "stop" else F.col("ok"))
    seen, not_seen = fv.POLL_MESSAGES[action]
    chunk = time_chunk(polls, "ts", chunk_seconds).alias(CHUNK)
    placed = reduce(and_, [F.col(c).isNotNull() for c in [*keys, "ts"]])
    timeline = starts.filter(placed).select(
        *keys, "ts", F.col("start_id").alias("seq"), F.lit(START).alias("_kind"),
        F.lit(False).alias("_ok"), chunk,
    ).unionByName(
        polls.filter(placed).select(
            *keys, "ts", "seq", F.lit(POLL).alias("_kind"), good_poll.alias("_ok"), chunk
        )
    )
    # The scan of the starts and the offsets read the same columns, so they share one shuffle.
    scanned = _scan_polls(timeline, [*keys, CHUNK])
    settled = (
        scanned.filter(F.col("_kind") == START)
        .join(_poll_offsets(scanned, keys), [*keys, CHUNK], "left")
        .withColumn("_next", F.coalesce(_shifted("_next", "_before"), "_later"))
        .withColumn("_no", F.col("_no") + F.col("_before"))
        .select(*keys, "seq", "ts", "_no", "_next", "_total")
    )
    unplaced = starts.filter(~placed).select(*keys, F.col("start_id").alias("seq"), "ts")
    settled = settled.unionByName(unplaced, allowMissingColumns=True)

    used = F.col("_next._no") - F.col("_no")
    in_time = F.col("_next.ts") <= F.col("ts") + F.make_dt_interval(secs=F.lit(horizon_seconds))
    ready = is_true((used <= max_polls) & in_time)
    return settled.select(
        *keys,
        F.col("seq").alias("start_id"),
        "ts",
        ready.alias("ready"),
        F.when(ready, F.col("_next.ts")).alias("ready_ts"),
        F.when(ready, used).alias("polls_used"),
        F.when(ready, seen).otherwise(not_seen).alias("message"),
        (F.col("_total") - F.col("_no")).alias("polls_after"),
    )


def _scan_history(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Within ``keys``: failures and good probes before each row, and failures in a row before it."""
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("ts", "seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = rows.withColumns(
        {
            "_fails": F.count_if(~F.col("ok")).over(earlier),
            "_oks": F.count_if("ok").over(earlier),
        }
    )
    at_last_ok = F.max(F.when(F.col("ok"), F.col("_fails"))).over(earlier)
    return counted.withColumn("_before", F.col("_fails") - F.coalesce(at_last_ok, F.lit(0)))


def _chunk_offsets(scanned: DataFrame, carry: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Per chunk, what the chunks before it bring in: failures in a row and good probes."""
    parts = scanned.groupBy(*keys, CHUNK).agg(
        F.count_if("ok").alias("_n_ok"),
        F.count_if(~F.col("ok")).alias("_n_fail"),
        F.max(F.when(F.col("ok"), F.col("_fails"))).alias("_fails_at_ok"),
    )
    if carry is not None:
        parts = parts.unionByName(
            carry.select(
                *keys,
                F.lit(None).cast("long").alias(CHUNK),
                F.col("oks").alias("_n_ok"),
                F.col("streak").alias("_n_fail"),
                F.when(F.col("oks") > 0, F.lit(0)).alias("_fails_at_ok"),
            )
        )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.withColumn("_fails_in", F.coalesce(F.sum("_n_fail").over(before), F.lit(0)))
    at_last_ok = F.max(F.col("_fails_in") + F.col("_fails_at_ok")).over(before)
    return totals.select(
        *keys,
        CHUNK,
        (F.col("_fails_in") - F.coalesce(at_last_ok, F.lit(0))).alias("_streak_in"),
        F.coalesce(F.sum("_n_ok").over(before), F.lit(0)).alias("_oks_in"),
    ).filter(F.col(CHUNK).isNotNull())


def with_streaks(
    probes: DataFrame,
    chunk: Column,
    carry: DataFrame | None = None,
    keys: Sequence[str] = NODE,
) -> DataFrame:
    """Add ``streak_before``, ``streak`` (failures in a row) and ``oks_before`` to each probe.

    ``probes`` holds ``node_id, ts, seq, ok``. ``carry`` (``node_id, streak, oks``) continues an
    earlier history. A probe without node or time belongs to no history and is left out.

    Histories are cut into chunks that are scanned on their own; one small row per chunk tells the
    next chunks what came before.
    """
    keys = list(keys)
    rows = probes.select(
        *keys, "ts", "seq", is_true(F.col("ok")).alias("ok"), chunk.alias(CHUNK)
    ).dropna(subset=[*keys, CHUNK])
    scanned = _scan_history(rows, [*keys, CHUNK])
    chunked = scanned.join(_chunk_offsets(scanned, carry, keys), [*keys, CHUNK], "left")

    came_in = F.when(F.col("_oks") == 0, F.col("_streak_in")).otherwise(0)
    return (
        chunked.withColumn("streak_before", F.col("_before") + came_in)
        .select(
            *keys,
            "ts",
            "seq",
            "ok",
            "streak_before",
            F.when(F.col("ok"), 0).otherwise(F.col("streak_before") + 1).alias("streak"),
            (F.col("_oks_in") + F.col("_oks")).alias("oks_before"),
        )
    )


def unhealthy_streaks(
    probes: DataFrame,
    retries: int = fv.HEALTH_RETRIES,
    chunk_seconds: int = 3600,
    keys: Sequence[str] = NODE,
) -> DataFrame:
    """Runs of at least ``retries`` failed probes: start, length, unhealthy moment, recovery."""
    marked = with_streaks(probes, time_chunk(probes, "ts", chunk_seconds), None, keys)
    failed = ~F.col("ok")
    return (
        marked.filter(failed | (F.col("streak_before") >= retries))
        .groupBy(*keys, F.col("oks_before").alias("_island"))
        .agg(
            F.max(F.when(failed & (F.col("streak") == 1), F.col("ts"))).alias("start_ts"),
            F.max("streak").alias("length"),
            F.max(F.when(failed & (F.col("streak") == retries), F.col("ts"))).alias("unhealthy_ts"),
            F.max(F.when(F.col("ok"), F.col("ts"))).alias("recovery_ts"),
        )
        .filter(F.col("length") >= retries)
        .drop("_island")
    )


def changes_of_health(
    marked: DataFrame, retries: int = fv.HEALTH_RETRIES, keys: Sequence[str] = NODE
) -> DataFrame:
    """Rows of ``with_streaks`` at which the health of a node changes.

    A node is starting until its first good probe (healthy) or its ``retries``-th failure in a
    row (unhealthy).
    """
    recovers = F.col("ok") & ((F.col("oks_before") == 0) | (F.col("streak_before") >= retries))
    breaks = ~F.col("ok") & (F.col("streak") == retries)
    return marked.filter(recovers | breaks).select(
        *keys,
        "ts",
        "seq",
        F.when(F.col("streak_before") >= retries, "unhealthy")
        .when(F.col("oks_before") > 0, "healthy")
        .otherwise("starting")
        .alias("from_status"),
        F.when(F.col("ok"), "healthy").otherwise("unhealthy").alias("to_status"),
    )


def health_changes(
    probes: DataFrame,
    retries: int = fv.HEALTH_RETRIES,
    chunk_seconds: int = 3600,
    keys: Sequence[str] = NODE,
) -> DataFrame:
    marked = with_streaks(probes, time_chunk(probes, "ts", chunk_seconds), None, keys)
    return changes_of_health(marked, retries, keys)
