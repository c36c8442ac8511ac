"""Sets of transaction ids per source, as intervals of consecutive ids.

A replica that has applied ids 1 to 1,000,000 is one row, and each gap costs one more. Union, difference and
gaps are passes over the ends of intervals, and a test whether ids are in a set carries the last interval
forward; a source with most of all ids is cut into chunks of ids (see ``timelines``).

A set is a table (keys, low, high) of disjoint intervals that do not touch, both ends included. Rows with a null
key or id are in no set.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.ranking import CHUNK, number_chunk
from fleetlens.functions.timelines import carry_forward, spans_where
from fleetlens.session import work_folder

SOURCE = ("source",)
#: Ids in a chunk.
WIDTH = 1 << 16
#: Rows that a task sorts, about; more than a chunk holds.
TASK_ROWS = 1 << 19


def _known(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.dropna(subset=list(columns))


def transaction_set(
    changes: DataFrame, keys: Sequence[str] = SOURCE, seq: str = "seq", width: int = WIDTH
) -> DataFrame:
    """The ids of ``changes`` as a set; replays count once.

    Each chunk of ids is compacted for itself: a row that begins or ends a stretch stays, and a stretch is read off
    the row behind its first. Only the first and the last stretch of a chunk can touch those of others, so only
    they are merged. The pieces are written below the session's folder for intermediate tables: the ids are counted
    and read once, and all that follows works on intervals.
    """
    spark = changes.sparkSession
    ids = _known(changes.select(*keys, F.col(seq).cast("long").alias("low")), [*keys, "low"])
    ids = ids.withColumn(CHUNK, number_chunk("low", width))
    line = ids.distinct().repartition(tasks_for(ids), *keys, CHUNK)
    order = Window.partitionBy(*keys, CHUNK).orderBy("low")
    before, behind = F.lag("low").over(order), F.lead("low").over(order)
    line = line.withColumns({"_before": before, "_behind": behind})
    first = F.col("_before").isNull() | (F.col("_before") + 1 < F.col("low"))
    last = F.col("_behind").isNull() | (F.col("low") + 1 < F.col("_behind"))
    ends = line.withColumns({"_first": first, "_last": last}).filter("_first OR _last")
    high = F.when(F.col("_last"), F.col("low")).otherwise(F.lead("low").over(order))
    edge = F.col("_before").isNull() | F.lead("low").over(order).isNull()
    edge = F.when(F.col("_last"), edge).otherwise(F.col("_before").isNull() | F.lead("low", 2).over(order).isNull())
    pieces = ends.withColumns({"high": high, "_edge": edge}).filter("_first").select(*keys, "low", "high", "_edge")
    folder = work_folder(spark, "transactions")
    pieces.write.parquet(folder)
    stored = spark.read.schema(pieces.schema).parquet(folder)
    whole = merged(stored.filter("_edge").drop("_edge"), keys, width)
    return stored.filter("NOT _edge").drop("_edge").unionByName(whole)


def tasks_for(rows: DataFrame) -> int:
    """Tasks of a step that sorts ``rows``: one for each ``TASK_ROWS``, so none holds more as a table grows."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def merged(intervals: DataFrame, keys: Sequence[str] = SOURCE, width: int = WIDTH) -> DataFrame:
    """The set of all ids in ``intervals``, which may overlap and touch."""
    return _where(_ends(intervals, keys, "held"), keys, width, ["held"], lambda n: n["held"] > 0)


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = SOURCE, width: int = WIDTH) -> DataFrame:
    """Ids in either set."""
    names = [*keys, "low", "high"]
    ends = _ends(a.select(*names).unionByName(b.select(*names)), keys, "held")
    return _where(ends, keys, width, ["held"], lambda n: n["held"] > 0, tasks_for(ends))


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = SOURCE, width: int = WIDTH) -> DataFrame:
    """Ids in ``a`` that are not in ``b``: what a replica with ``b`` lacks of a primary with ``a``."""
    both = _ends(a, keys, "left").unionByName(_ends(b, keys, "right"), allowMissingColumns=True)
    inside = lambda n: (n["left"] > 0) & (n["right"] == 0)
    return _where(both, keys, width, ["left", "right"], inside, tasks_for(both))


def gaps(held: DataFrame, keys: Sequence[str] = SOURCE, width: int = WIDTH) -> DataFrame:
    """Intervals of ids missing between the smallest and the largest id of each key."""
    ends = _ends(held, keys, "held")
    between = _where(ends, keys, width, ["held"], lambda n: n["held"] == 0, tasks_for(ends))
    return between.filter("high IS NOT NULL")


def contains(
    rows: DataFrame,
    held: DataFrame,
    keys: Sequence[str] = SOURCE,
    seq: str = "seq",
    out: str = "applied",
    width: int = WIDTH,
    tasks: int | None = None,
) -> DataFrame:
    """``rows`` with ``out``: whether their id is in the set. Each row is answered for itself.

    The interval that begins last at or before an id decides, so ids and intervals meet on one timeline and are
    never paired. A row with a null key or id is in no set. ``tasks`` saves the count of both tables.
    """
    marks = held.select(*keys, F.col("low").alias("_at"), F.lit(0).alias("_kind"), F.col("high").alias("_high"))
    asked = rows.withColumns({"_at": F.col(seq).cast("long"), "_kind": F.lit(1), "_high": F.lit(None).cast("long")})
    line = asked.unionByName(marks, allowMissingColumns=True).withColumn("_place", number_chunk("_at", width))
    line = line.repartition(tasks or tasks_for(line), *keys, "_place")
    carried = carry_forward(line, keys, ["_at", "_kind"], F.col("_place"), {"_reach": "_high"})
    inside = F.coalesce(F.col("_reach") >= F.col("_at"), F.lit(False))
    return carried.filter("_kind = 1").withColumn(out, inside).select(
        *[c for c in rows.columns if c != out], out
    )


def _ends(intervals: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """One more from the first id of an interval on, one less behind its last."""
    known = _known(intervals.select(*keys, "low", "high"), [*keys, "low", "high"])
    ends = F.array(
        F.struct(F.col("low").alias("at"), F.lit(1).alias(count)),
        F.struct((F.col("high") + 1).alias("at"), F.lit(-1).alias(count)),
    )
    return known.select(*keys, F.explode(ends).alias("_e")).select(*keys, "_e.*")


def _where(
    events: DataFrame,
    keys: Sequence[str],
    width: int,
    counts: Sequence[str],
    inside: Callable[[Mapping[str, Column]], Column],
    tasks: int | None = None,
) -> DataFrame:
    """Intervals of ids on which ``inside`` holds. ``tasks`` are for events of sets: few at one id."""
    chunk = number_chunk("at", width)
    spans = spans_where(events.fillna(0, list(counts)), keys, "at", chunk, counts, inside, tasks)
    return spans.select(*keys, F.col("at").alias("low"), (F.col("until") - 1).alias("high"))
