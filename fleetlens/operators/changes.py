"""Replicated tables: full copy, deduplicated changes, snapshot with changes applied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_hash(rows: DataFrame) -> Column:
    """A 64-bit hash of a whole row."""
    # A hash skips nulls, so where they are is hashed with the values; nested values as text.
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    values = [
        F.to_json(F.struct(f.name), {"ignoreNullFields": "false"})
        if isinstance(f.dataType, nested)
        else F.col(f.name)
        for f in rows.schema
    ]
    return F.xxhash64(*values, *[F.col(c).isNull() for c in rows.columns])


def _sums(rows: DataFrame) -> list[Column]:
    digest = row_hash(rows)
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(digest).alias("hash_xor"),
        F.sum(digest.cast("decimal(38,0)")).alias("hash_sum"),
    ]


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row: row count and two order-free hashes (the sum also sees repeated rows)."""
    return rows.agg(*_sums(rows))


def clone_snapshot(rows: DataFrame, path: str) -> DataFrame:
    """Write a full copy to a new folder, check it against the source, and return it.

    The source's fingerprint is observed while it is written, so it is read once.
    """
    seen = Observation()
    rows.observe(seen, *_sums(rows)).write.mode("errorifexists").parquet(path)
    copy = rows.sparkSession.read.schema(rows.schema).parquet(path)
    if fingerprint(copy).first().asDict() != seen.get:
        raise ValueError(f"copy at {path} differs from its source")
    return copy


def dedup_changes(
    changes: DataFrame, keys: Sequence[str] = ("source", "seq"), order: Sequence[str] = ()
) -> DataFrame:
    """One row per transaction id. The rows of an id are ordered by ``order``, then by all columns."""
    rest = [c for c in changes.columns if c not in keys and c not in order]
    first = Window.partitionBy(*keys).orderBy(*order, *rest)
    return changes.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def as_snapshot(base: DataFrame) -> DataFrame:
    """A plain table as a snapshot to which no change was applied yet."""
    return base.withColumns(
        {"last_seq": F.lit(None).cast("long"), "deleted": F.lit(False)}
    )


def latest_changes(changes: DataFrame, *keys: str) -> DataFrame:
    """The change with the highest ``seq`` per key; the rank test runs before the shuffle, too."""
    tie = [F.col(c).desc() for c in changes.columns if c not in (*keys, "seq")]
    newest = Window.partitionBy(*keys).orderBy(F.col("seq").desc(), *tie)
    return changes.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def apply_changes(snapshot: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """Snapshot after the changes: the latest full row per key wins, a delete leaves a tombstone.

    ``changes`` holds the row columns, ``seq`` and ``op`` (insert, update, delete); ``keys`` is
    the primary key. ``last_seq`` and tombstones stay in the snapshot, so an older change that
    comes later cannot win, and applying the same changes again alters nothing.
    """
    values = [c for c in snapshot.columns if c not in (*keys, "last_seq", "deleted")]
    incoming = latest_changes(changes.select(*keys, "seq", "op", *values), *keys).select(
        *keys,
        F.col("seq").alias("_seq"),
        (F.col("op") == "delete").alias("_gone"),
        *[F.col(c).alias(f"_new_{c}") for c in values],
    )
    wins = F.col("_seq").isNotNull() & (
        F.col("last_seq").isNull() | (F.col("_seq") > F.col("last_seq"))
    )
    return snapshot.join(incoming, list(keys), "full_outer").select(
        *keys,
        *[
            F.when(wins, F.when(~F.col("_gone"), F.col(f"_new_{c}"))).otherwise(F.col(c)).alias(c)
            for c in values
        ],
        F.when(wins, F.col("_seq")).otherwise(F.col("last_seq")).alias("last_seq"),
        F.when(wins, F.col("_gone")).otherwise(F.col("deleted")).alias("deleted"),
    )


def live_rows(snapshot: DataFrame) -> DataFrame:
    """Rows of the table that a snapshot stands for."""
    return snapshot.filter(~F.col("deleted")).drop("last_seq", "deleted")
