"""Timelines per key: values carried forward, the row behind a row, running sums.

A window over a whole key would send all of its rows to one task. Here a timeline is cut into chunks of its
order (see ``ranking``): rows look around inside their chunk, and one small row per chunk, combined
before the shuffle, tells what the chunks before or behind it hold.

``order`` are the columns that order a timeline in full, ``chunk`` must never fall while they rise. Rows with
a null key or chunk belong to no timeline: they keep their own values and see no other row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.ranking import CHUNK


def carry_forward(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, values: Mapping[str, str]
) -> DataFrame:
    """Add, for each (name, column) of ``values``, the last value of the column up to the row, nulls skipped."""
    chunked = rows.withColumn(CHUNK, chunk)
    inside = (
        Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    ends = chunked.groupBy(*keys, CHUNK).agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_end_{n}")
            for n, c in values.items()
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.select(
        *keys,
        CHUNK,
        *[F.last(f"_end_{n}", ignorenulls=True).over(earlier).alias(f"_in_{n}") for n in values],
    )
    found = chunked.withColumns({n: F.last(c, ignorenulls=True).over(inside) for n, c in values.items()})
    joined = found.join(brought, [*keys, CHUNK], "left")
    return joined.withColumns({n: F.coalesce(n, f"_in_{n}") for n in values}).drop(
        CHUNK, *[f"_in_{n}" for n in values]
    )


def neighbour(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    columns: Sequence[str],
    name: str,
    before: bool = False,
) -> DataFrame:
    """Add ``name``: a struct of ``columns`` of the next row of the timeline, or of the row ``before``; null at
    the end. ``columns`` can be ordered."""
    chunked = rows.withColumn(CHUNK, chunk)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    pick, step = (F.max, F.lag) if before else (F.min, F.lead)
    whole = F.struct(*order, *[c for c in columns if c not in order])
    edges = chunked.groupBy(*keys, CHUNK).agg(pick(whole).alias("_edge"))
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    across = edges.withColumn("_across", step("_edge").over(chunks))
    picked = F.struct(*[F.col(f"_across.{c}").alias(c) for c in columns])
    across = across.select(*keys, CHUNK, F.when(F.col("_across").isNotNull(), picked).alias("_across"))
    found = chunked.withColumn(name, step(F.struct(*columns)).over(inside))
    return (
        found.join(across, [*keys, CHUNK], "left")
        .withColumn(name, F.coalesce(name, "_across"))
        .drop(CHUNK, "_across")
    )


def running_sums(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, sums: Mapping[str, str]
) -> DataFrame:
    """Add, for each (name, column) of ``sums``, the sum of the column up to and with the row."""
    chunked = rows.withColumn(CHUNK, chunk)
    inside = (
        Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    parts = chunked.groupBy(*keys, CHUNK).agg(*[F.sum(c).alias(f"_part_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(
        *keys, CHUNK, *[F.coalesce(F.sum(f"_part_{n}").over(earlier), F.lit(0)).alias(f"_in_{n}") for n in sums]
    )
    found = chunked.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    joined = found.join(before, [*keys, CHUNK], "left")
    own = [] if CHUNK in rows.columns else [CHUNK]
    return joined.withColumns({n: F.col(n) + F.coalesce(f"_in_{n}", F.lit(0)) for n in sums}).drop(
        *own, *[f"_in_{n}" for n in sums]
    )


def spans_where(
    events: DataFrame,
    keys: Sequence[str],
    at: str,
    chunk: Column,
    sums: Sequence[str],
    inside: Callable[[Mapping[str, Column]], Column],
    tasks: int | None = None,
) -> DataFrame:
    """(keys, ``at``, ``until``): the stretches on which ``inside`` holds, a test of the sums in force.

    An event adds to ``sums`` from ``at`` on; all sums begin at zero. Events of one position are added up before
    the shuffle. Stretches that touch are one; ``until`` is null if a stretch does not end.

    With ``tasks`` the chunks are dealt to that many tasks at once, whatever the session's settings; no position
    may then have very many events.
    """
    added, kept = [F.sum(c).alias(f"_d_{c}") for c in sums], []
    if tasks:
        dealt = events.withColumn(CHUNK, chunk).repartition(tasks, *keys, CHUNK)
        points, chunk, kept = dealt.groupBy(*keys, CHUNK, at).agg(*added), F.col(CHUNK), [CHUNK]
    else:
        points = events.groupBy(*keys, at).agg(*added)
    summed = running_sums(points, keys, [at], chunk, {c: f"_d_{c}" for c in sums})
    now = inside({c: F.col(c) for c in sums})
    # What held just before is known from the sums without this position's events.
    then = inside({c: F.col(c) - F.col(f"_d_{c}") for c in sums})
    turns = summed.select(*keys, at, *kept, now.alias("_now"), then.alias("_then")).filter("_now <> _then")
    if tasks:
        turns = turns.repartition(tasks, *keys, CHUNK)
    spans = neighbour(turns, keys, [at], chunk, [at], "_next")
    return spans.filter("_now").select(*keys, at, F.col(f"_next.{at}").alias("until"))
