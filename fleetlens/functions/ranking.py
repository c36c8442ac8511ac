"""Positions inside groups that may be too large for one task.

A plain ``row_number().over(partitionBy(key))`` sends a whole group to one task. Here each
group is cut into chunks along its order. Rows are numbered inside their chunk, and the sizes
of the chunks before it (a small aggregate, combined before the shuffle) are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

CHUNK = "_chunk"


def number_chunk(column: str, width: int = 65536) -> Column:
    """Chunk of an integer order column."""
    return F.floor(F.col(column) / F.lit(width))


def time_chunk(rows: DataFrame, column: str, seconds: int) -> Column:
    """Chunk of an event-time column of ``rows``; it never falls while the time rises.

    A time without zone is counted in its own clock, so the session's zone has no part in it.
    """
    at = F.col(column)
    if rows.schema[column].dataType == TimestampNTZType():
        day = F.unix_date(at.cast("date")) * F.lit(86_400)
        passed = day + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    else:
        passed = F.unix_seconds(at.cast("timestamp"))
    return F.floor(passed / F.lit(seconds))


def group_position(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    position: str,
    total: str | None = None,
    per_group: DataFrame | None = None,
) -> DataFrame:
    """Add the 1-based position in the group, and the group size if ``total`` is named.

    ``order`` must be total within a group and ``chunk`` must never fall while it rises. Rows
    with a null key or chunk are kept with a null position. ``per_group`` (one row per group)
    is joined to the chunk sizes, so that no row-level join meets a whole group in one task.
    """
    chunked = rows.withColumn(CHUNK, chunk)
    sizes = chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(*keys).orderBy(CHUNK)
    offsets = sizes.select(
        *keys,
        CHUNK,
        F.coalesce(
            F.sum("_n").over(by_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    if per_group is not None:
        offsets = offsets.join(per_group, list(keys), "left")
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    out = chunked.join(offsets, [*keys, CHUNK], "left").withColumn(
        position, F.col("_before") + F.row_number().over(inside)
    )
    if total:
        out = out.withColumnRenamed("_total", total)
    return out.drop(CHUNK, "_before", "_total")


def expand_slots(rows: DataFrame, count: str, slot: str, width: int = 4096) -> DataFrame:
    """One row per slot 0 .. count-1; two steps, so no row ever holds an array of all slots."""
    last = F.col(count).cast("long") - 1
    return (
        rows.filter(F.col(count) > 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / width))))
        .withColumn(
            slot,
            F.explode(
                F.sequence(
                    F.col("_block") * width, F.least(last, F.col("_block") * width + (width - 1))
                )
            ),
        )
        .drop("_block")
    )
