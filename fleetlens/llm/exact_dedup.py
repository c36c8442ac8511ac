"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every partition of the input (a sender) sorts the distinct 64-bit hashes of its texts and cuts
   them by range into one run per owner. A run travels as Golomb-Rice coded gaps: about
   log2(range / hashes) + 2 bits for a hash instead of 64.
2. An owner merges the runs it receives and answers each sender with a bitmap: one bit per hash of the
   run, set where another sender sent that hash too.
3. Rows whose hash is marked, or occurs twice in their own partition, are suspects. Only their
   texts are shuffled, combined by whole text before the shuffle, and compared byte by byte.

A text that fills a third of the table is one hash in each run and one row per task in step 3. The
number of owners follows the row count, so a run set fits into a task at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import work_folder

#: Hashes that one owner is meant to receive.
HASHES_PER_OWNER = 1_000_000


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """(parameter, bits) of the gaps of sorted distinct uint64 ``values``.

    A gap is its quotient by 2**parameter in unary (ones, then a zero) and its remainder.
    """
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = max(1, int(values[-1]) // len(values))
    k = max(0, mean.bit_length() - 1)
    high = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(high + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    low = np.unpackbits(gaps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return k, np.packbits(np.concatenate([low[:, :k].ravel(), unary])).tobytes()


def rice_decode(count: int, k: int, data: bytes) -> np.ndarray:
    """The values that ``rice_encode`` got."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    low = np.zeros((count, 64), np.uint8)
    low[:, :k] = bits[: count * k].reshape(count, k)
    low = np.packbits(low, axis=1, bitorder="little").view("<u8").ravel()
    stops = np.flatnonzero(bits[count * k :] == 0)[:count]
    high = (np.diff(stops, prepend=-1) - 1).astype(np.uint64)
    return np.cumsum((high << np.uint64(k)) + low, dtype=np.uint64)


def _runs(hashed: DataFrame, owners: int) -> DataFrame:
    """One row per (sender, owner): the coded hashes and which of them occur twice there."""
    width = -(-(1 << 64) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            senders = batch.column(0).to_numpy()
            values = batch.column(1).to_numpy().view(np.uint64)
            for sender in np.unique(senders):
                parts.setdefault(int(sender), []).append(values[senders == sender])
        for sender, pieces in parts.items():
            values, counts = np.unique(np.concatenate(pieces), return_counts=True)
            owner = (values // np.uint64(width)).astype(np.int64)
            edges = np.searchsorted(owner, np.arange(owners + 1))
            for o in np.unique(owner).tolist():
                a, b = int(edges[o]), int(edges[o + 1])
                k, data = rice_encode(values[a:b] - np.uint64(o * width))
                twice = np.packbits(counts[a:b] > 1).tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "sender": pa.array([sender], pa.int64()),
                        "owner": pa.array([o], pa.int64()),
                        "n": pa.array([b - a], pa.int64()),
                        "k": pa.array([k], pa.int64()),
                        "data": pa.array([data], pa.binary()),
                        "twice": pa.array([twice], pa.binary()),
                    }
                )

    return hashed.select("sender", "h").mapInArrow(
        run, "sender long, owner long, n long, k long, data binary, twice binary"
    )


def _answers(runs: DataFrame) -> DataFrame:
    """(sender, owner, n, k, data, marks): bit i is set if hash i of the run is a suspect."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("sender").reset_index(drop=True)
        values = [
            rice_decode(int(n), int(k), data)
            for n, k, data in zip(table["n"], table["k"], table["data"])
        ]
        _, back, counts = np.unique(
            np.concatenate(values), return_inverse=True, return_counts=True
        )
        shared, at, marks = counts[back] > 1, 0, []
        for n, twice in zip(table["n"], table["twice"]):
            own = np.unpackbits(np.frombuffer(twice, np.uint8))[: int(n)].astype(bool)
            marks.append(np.packbits(own | shared[at : at + int(n)]).tobytes())
            at += int(n)
        return table.assign(marks=marks)[["sender", "owner", "n", "k", "data", "marks"]]

    return runs.groupBy("owner").applyInPandas(
        run, "sender long, owner long, n long, k long, data binary, marks binary"
    )


def _suspects(answers: DataFrame, owners: int) -> DataFrame:
    """(sender, h): the marked hashes of each sender, read off its bitmaps."""
    width = -(-(1 << 64) // owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hit = np.unpackbits(np.frombuffer(row["marks"], np.uint8))[: row["n"]].astype(bool)
                if hit.any():
                    values = rice_decode(row["n"], row["k"], row["data"])[hit]
                    values = (values + np.uint64(row["owner"] * width)).view(np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "sender": pa.array(np.full(len(values), row["sender"]), pa.int64()),
                            "h": pa.array(values, pa.int64()),
                        }
                    )

    return answers.select("sender", "owner", "n", "k", "data", "marks").mapInArrow(
        run, "sender long, h long"
    )


def exact_duplicates(
    rows: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    hashes_per_owner: int = HASHES_PER_OWNER,
    normalise: Column | None = None,
) -> DataFrame:
    """(``key``, keep_id, group_size, kept, text_sha256), one row for each row of ``rows``.

    Texts are equal when their bytes are equal; ``normalise`` is the compared text (default:
    the text itself, null as empty). Of equal texts the row with the largest key stays; a null key
    is smaller than any other. Of repeated rows with that same key exactly one stays. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    folder = work_folder(spark, "exact-dedup")
    body = normalise if normalise is not None else F.coalesce(F.col(text), F.lit(""))
    whole = rows.select(F.col(key).alias("id"), body.cast("string").alias("body"))
    whole = whole.withColumn("h", F.xxhash64("body"))
    whole.select(
        "id",
        "h",
        F.sha2("body", 256).alias("sha"),
        F.spark_partition_id().cast("long").alias("sender"),
        F.monotonically_increasing_id().alias("at"),
    ).write.parquet(f"{folder}/hashed")
    hashed = spark.read.parquet(f"{folder}/hashed")
    owners = max(2, -(-hashed.count() // hashes_per_owner))
    _answers(_runs(hashed, owners)).write.parquet(f"{folder}/answers")
    marked = _suspects(spark.read.parquet(f"{folder}/answers"), owners)
    suspects = hashed.join(marked, ["sender", "h"], "left_semi").select("id", "h")
    # A row key is unique, so this join meets no hot key; nulls match nulls.
    ids = suspects.select(F.xxhash64(F.col("id").isNull(), "id").alias("row"), "h").distinct()
    texts = whole.withColumn("row", F.xxhash64(F.col("id").isNull(), "id")).join(
        ids, ["row", "h"], "left_semi"
    )
    groups = (
        texts.groupBy("h", "body")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("h", F.sha2("body", 256).alias("sha"), "keep_id", "group_size")
    )
    groups.write.parquet(f"{folder}/groups")
    joined = hashed.join(spark.read.parquet(f"{folder}/groups"), ["h", "sha"], "left")
    alone = F.col("group_size").isNull()
    stays = joined.filter(~alone & F.col("id").eqNullSafe(F.col("keep_id")))
    first = stays.groupBy("h", "sha").agg(F.min("at").alias("first"))
    first = first.select("first", F.lit(True).alias("_stays"))
    return joined.join(first, joined["at"] == first["first"], "left").select(
        F.col("id").alias(key),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.coalesce("_stays", F.lit(False))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
