"""The next row in the order of a key, over a whole table. Native expressions only.

The order is cut into chunks of about ``CHUNK_ROWS`` rows, so that the next row is mostly found inside a
chunk by a window over it; at the end of a chunk stands a copy of the first row of the next one. Chunks come from 256 quantiles of the key, each cut evenly; a key that holds whole
quantiles is cut by a hash of the other columns instead, which is the order of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = 256
CHUNK_ROWS = 1024


def _chunk(rows: DataFrame, key: str) -> tuple[Column, Column]:
    """(quantile, part of it): numbers that never fall while the key, then the tie, rise."""
    shares = F.array(*[F.lit(i / QUANTILES) for i in range(QUANTILES + 1)])
    # At most 257 numbers reach the driver.
    bounds, count = rows.agg(
        F.percentile_approx(key, shares, F.lit(10_000)), F.count(F.lit(1))
    ).first()
    bounds = sorted(bounds or [0])
    parts = max(1, count // QUANTILES // CHUNK_ROWS)
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    # The first of equal bounds, so that rows of one key share a quantile.
    at = F.size(F.filter(edges, lambda b: b < F.col(key)))
    low, high = F.get(edges, at - 1).cast("double"), F.get(edges, at).cast("double")
    passed = F.try_divide(F.col(key).cast("double") - low, high - low)
    even = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(passed * parts)))
    hot = sorted({b for b, c in zip(bounds, bounds[1:]) if b == c})
    if not hot:
        return at, F.coalesce(even, F.lit(0)).cast("long")
    # Rows of a hot key lie behind all others of its quantile, by the first bits of the tie.
    bits = max(1, (parts * QUANTILES).bit_length())
    behind = parts + F.shiftrightunsigned(F.col("_tie").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)
    hot_key = F.col(key).isin(hot)
    return at, F.when(hot_key, behind).otherwise(F.coalesce(even, F.lit(0))).cast("long")


def with_next(
    rows: DataFrame,
    key: str,
    columns: Sequence[str],
    derive: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """``rows`` with ``next_`` columns: those of the next row by descending ``key``, an integer.

    The row behind the last one is the first; a single row is its own next one. Rows of equal keys come by
    a hash of ``columns``, then by the columns; a null key counts as the smallest number. ``derive``
    adds columns to rows that are shuffled already, and what it adds has a next value too.
    An empty table stays empty.
    """
    keyed = rows.withColumns(
        {
            "_key": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))),
            "_tie": F.xxhash64(*columns),
        }
    )
    quantile, part = _chunk(keyed.select("_key", "_tie"), "_key")
    cell = ["_quantile", "_part"]
    dealt = keyed.withColumns({"_quantile": quantile, "_part": part})
    order = [F.desc("_key"), F.desc("_tie"), *[F.desc(c) for c in columns]]
    guests = _guests(dealt, cell, order)
    met = (
        dealt.withColumn("_guest", F.lit(False))
        .unionByName(guests.withColumn("_guest", F.lit(True)))
        .repartition(*cell)
    )
    made = derive(met)
    values = [*columns, *[c for c in made.columns if c not in met.columns]]
    inside = Window.partitionBy(*cell).orderBy("_guest", *order)
    seen = made.withColumn("_next", F.lead(F.struct(*values)).over(inside)).filter(~F.col("_guest"))
    return seen.select(
        *rows.columns,
        *[c for c in values if c not in rows.columns],
        *[F.col(f"_next.{c}").alias(f"next_{c}") for c in values],
    )


def _guests(dealt: DataFrame, cell: list[str], order: list[Column]) -> DataFrame:
    """For each chunk a copy of the first row of the next chunk that has rows; of the first one for the last."""
    # Spark applies the rank test before the shuffle, so a task sends one row of a chunk.
    first = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
    tops = dealt.withColumn("_rank", first).filter("_rank = 1").drop("_rank")
    names = [c for c in tops.columns if c not in cell]
    packed = tops.select(*cell, F.struct(*names).alias("_row"))
    chunks = Window.partitionBy("_quantile").orderBy(F.desc("_part"))
    after = packed.withColumn("_after", F.lead("_row").over(chunks))
    # What follows the last chunk of a quantile: the first of the next quantile, of 258 at most.
    heads = Window.partitionBy("_quantile").orderBy(F.desc("_part"))
    quantiles = packed.withColumn("_rank", F.row_number().over(heads)).filter("_rank = 1")
    row = Window.orderBy(F.desc("_quantile"))
    whole = row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    onward = quantiles.select(
        "_quantile",
        F.coalesce(F.lead("_row").over(row), F.first("_row").over(whole)).alias("_onward"),
    )
    return after.join(onward, "_quantile").select(
        *cell, F.coalesce("_after", "_onward").alias("_row")
    ).select(*cell, "_row.*")
