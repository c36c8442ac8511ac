"""Histories: the validity of each status, status as of any time, availability per window, drift over time.

A report tells the state of a node from its time on, until a later report tells another. Everything here
is a pass over timelines cut into time chunks (see ``timelines``), so a node with most of all reports is
spread over many tasks, and intervals are never paired. Rows without a key or time take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.ranking import expand_slots, time_chunk
from fleetlens.functions.timelines import carry_forward, neighbour

NODE = ("node_id",)
CHUNK_SECONDS = 86_400


def validity(
    reports: DataFrame,
    value: Sequence[str],
    keys: Sequence[str] = NODE,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """(keys, value columns, valid_from, valid_to): a row for each stretch of time with equal values.

    ``reports`` holds the keys, ``ts``, ``seq`` and the value columns. Of reports of one time the one with the
    largest ``seq`` counts. ``valid_to`` is null for the stretch that is still open. Nulls are values like any other.
    """
    keys, chunk = list(keys), time_chunk(reports, "ts", chunk_seconds)
    known = reports.select(*keys, "ts", "seq", F.struct(*value).alias("_v")).dropna(subset=[*keys, "ts"])
    # One report per time, combined before the shuffle.
    last = known.groupBy(*keys, "ts").agg(F.max(F.struct("seq", "_v"))["_v"].alias("_v"))
    seen = neighbour(last, keys, ["ts"], chunk, ["_v"], "_before", before=True)
    changes = seen.filter(F.col("_before").isNull() | ~F.col("_v").eqNullSafe(F.col("_before._v")))
    spans = neighbour(changes.drop("_before"), keys, ["ts"], chunk, ["ts"], "_next")
    return spans.select(
        *keys, *[F.col(f"_v.{c}").alias(c) for c in value], F.col("ts").alias("valid_from"), F.col("_next.ts").alias("valid_to")
    )


def extend_validity(
    history: DataFrame,
    reports: DataFrame,
    value: Sequence[str],
    keys: Sequence[str] = NODE,
    chunk_seconds: int = CHUNK_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """(rows that are final, rows that are new) after later ``reports``; their union is the new history.

    Reports must not be older than the open stretch of their node. Closed stretches and nodes without
    reports are final, so only the open stretches of reported nodes are worked on again, and a store of
    histories appends the second table.
    """
    keys = list(keys)
    touched = reports.dropna(subset=[*keys, "ts"]).select(*keys).distinct()
    open_ = history.filter("valid_to IS NULL").join(touched, keys, "left_semi")
    again = open_.select(
        *keys, F.col("valid_from").alias("ts"), F.lit(None).cast(reports.schema["seq"].dataType).alias("seq"), *value
    )
    kept = history.filter("valid_to IS NOT NULL").unionByName(
        history.filter("valid_to IS NULL").join(touched, keys, "left_anti").select(*history.columns)
    )
    fresh = again.unionByName(reports.select(*keys, "ts", "seq", *value))
    return kept, validity(fresh, value, keys, chunk_seconds)


def as_of(
    asked: DataFrame,
    history: DataFrame,
    value: Sequence[str],
    keys: Sequence[str] = NODE,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """``asked`` (keys, ``ts``, other columns) with the values in force at its time and ``valid_from``.

    A stretch holds from its first moment to before its end. Values are null where nothing is known yet. Rows without
    a key or time get nulls, repeated rows are answered each.
    """
    keys = list(keys)
    known = F.struct(F.col("valid_from"), *value)
    marks = history.select(*keys, F.col("valid_from").alias("ts"), F.lit(0).alias("_kind"), known.alias("_mark"))
    questions = asked.withColumn("_kind", F.lit(1))
    line = questions.unionByName(marks, allowMissingColumns=True)
    found = carry_forward(line, keys, ["ts", "_kind"], time_chunk(line, "ts", chunk_seconds), {"_found": "_mark"})
    return found.filter("_kind = 1").select(
        *asked.columns, *[F.col(f"_found.{c}").alias(c) for c in (*value, "valid_from")]
    )


def availability_per_window(
    history: DataFrame,
    up: Column,
    window_seconds: int,
    until: Column,
    keys: Sequence[str] = NODE,
) -> DataFrame:
    """(keys, window_start, up_micros, known_micros): time up and time known in each window of fixed length.

    ``history`` is that of ``validity``; an open stretch lasts to ``until``, and nothing counts behind it. Windows
    begin at multiples of ``window_seconds`` since 1970. A stretch is cut at the windows' edges; its windows
    are spread in blocks, and each (key, window) is added up before the shuffle.
    """
    width = window_seconds * 1_000_000
    first = F.unix_micros(F.col("valid_from").cast("timestamp"))
    last = F.least(
        F.unix_micros(F.coalesce(F.col("valid_to"), until).cast("timestamp")), F.unix_micros(until.cast("timestamp"))
    )
    spans = history.select(*keys, up.alias("_up"), first.alias("_a"), last.alias("_b")).filter("_a < _b")
    spans = spans.withColumn("_w", F.floor(F.col("_a") / width)).withColumn(
        "_n", F.floor((F.col("_b") - 1) / width) - F.col("_w") + 1
    )
    cut = expand_slots(spans, "_n", "_slot").withColumn("_s", (F.col("_w") + F.col("_slot")) * width)
    lasted = F.least(F.col("_b"), F.col("_s") + width) - F.greatest(F.col("_a"), F.col("_s"))
    return cut.groupBy(*keys, F.timestamp_micros("_s").alias("window_start")).agg(
        F.sum(F.when(F.col("_up"), lasted).otherwise(0)).alias("up_micros"), F.sum(lasted).alias("known_micros")
    )


def drift_periods(
    expected: DataFrame,
    observed: DataFrame,
    keys: Sequence[str] = ("node", "key"),
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """(keys, state, expected, observed, valid_from, valid_to): what two histories say together over time.

    Both hold the keys, ``ts``, ``seq`` and ``value`` (a null value removes the setting). At each time with a
    change the last value of either side is carried forward; equal stretches are joined. The state is ``ok``,
    ``changed``, ``missing`` (only expected) or ``extra`` (only observed); stretches with neither are left out.
    """
    keys = list(keys)

    def side(rows: DataFrame, name: str) -> DataFrame:
        value = F.max(F.struct("seq", "value"))["value"]
        known = rows.dropna(subset=[*keys, "ts"]).groupBy(*keys, "ts").agg(value.alias("value"))
        return known.select(*keys, "ts", F.struct("value").alias(name))

    line = side(expected, "_e").unionByName(side(observed, "_o"), allowMissingColumns=True)
    # A time at which both sides change is one row.
    line = line.groupBy(*keys, "ts").agg(F.max("_e").alias("_e"), F.max("_o").alias("_o"))
    chunk = time_chunk(line, "ts", chunk_seconds)
    both = carry_forward(line, keys, ["ts"], chunk, {"_left": "_e", "_right": "_o"})
    wanted, found = F.col("_left.value"), F.col("_right.value")
    state = (
        F.when(wanted.isNull() & found.isNull(), "none")
        .when(found.isNull(), "missing")
        .when(wanted.isNull(), "extra")
        .when(wanted == found, "ok")
        .otherwise("changed")
    )
    told = both.select(
        *keys, "ts", F.lit(0).alias("seq"), state.alias("state"), wanted.alias("expected"), found.alias("observed")
    )
    return validity(told, ["state", "expected", "observed"], keys, chunk_seconds).filter("state <> 'none'")
