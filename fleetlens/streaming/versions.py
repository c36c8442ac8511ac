"""Small tables that a ``foreachBatch`` sink carries from one micro-batch to the next.

Two folders take turns: batch n reads what batch n - 1 wrote and overwrites the other folder, which
holds what batch n - 2 wrote. So a batch that Spark runs again after a failure gives the same
result, nothing piles up, and there is nothing to delete. Batch numbers of a checkpoint rise by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@contextmanager
def adaptive(spark: SparkSession) -> Iterator[None]:
    """Sizes the tasks of a sink's own jobs by their data: a stream with state turns that off for its batches.

    The stream's number of tasks is fixed with its state, so each small step of a sink would take as many.
    The batch itself has to be evaluated before.
    """
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class VersionedTable:
    def __init__(self, path: str, schema: str | T.StructType):
        self.path = path
        self.schema = schema

    def folder(self, version: int) -> str:
        return f"{self.path}/{'even' if version % 2 == 0 else 'odd'}"

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        """Version ``version``, one of the last two; before the first batch, an empty table."""
        if version < 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self.folder(version))

    def write(self, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.folder(version))


class BucketedTable:
    """A table by keys, of which a batch writes only the buckets that its rows fall into.

    A bucket is a hash of the keys. A batch writes new versions of the buckets it touches, and a small
    index, a row per bucket at most, names the version of each bucket. A batch that runs again starts from
    the same index and overwrites its own version, so nothing is applied twice.
    """

    def __init__(self, path: str, schema: str | T.StructType, keys: Sequence[str], buckets: int = 16):
        self.path, self.keys, self.buckets = path, list(keys), buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.index = VersionedTable(f"{path}/index", "bucket int, version long")
        self.staged = VersionedTable(f"{path}/staged", self.schema)

    def _rows(self, spark: SparkSession, index: DataFrame, newest: int) -> DataFrame:
        stored = T.StructType([*self.schema]).add("version", "long").add("bucket", "integer")
        if index.isEmpty():
            return spark.createDataFrame([], T.StructType([*self.schema]).add("bucket", "integer"))
        rows = spark.read.schema(stored).parquet(f"{self.path}/rows")
        # A filter on folder names: what a batch that runs again is about to overwrite is not listed.
        rows = rows.filter(F.col("version") <= F.lit(newest))
        return rows.join(F.broadcast(index), ["bucket", "version"]).select(*self.schema.names, "bucket")

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        """The table after batch ``version``."""
        return self._rows(spark, self.index.read(spark, version), version).drop("bucket")

    def update(
        self, version: int, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]
    ) -> None:
        """Batch ``version``: in each bucket with new ``rows`` the table becomes ``merge(before, rows)``.

        Both tables that ``merge`` gets, and the one it returns, have the columns of the table and ``bucket``.
        """
        spark = rows.sparkSession
        # The batch is evaluated once, though its rows are read for their buckets too.
        self.staged.write(version, rows.select(*self.schema.names))
        with adaptive(spark):
            rows = self.staged.read(spark, version)
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
            new = rows.select(*self.schema.names, bucket)
            index = self.index.read(spark, version - 1)
            touched = new.select("bucket").distinct()
            before = self._rows(spark, index.join(touched, "bucket", "left_semi"), version - 1)
            merge(before, new).write.mode("overwrite").partitionBy("bucket").parquet(
                f"{self.path}/rows/version={version}"
            )
            now = touched.withColumn("version", F.lit(version).cast("long"))
            self.index.write(version, index.join(touched, "bucket", "left_anti").unionByName(now))

    def replace(self, version: int, rows: DataFrame) -> None:
        """Batch ``version``: ``rows``, one per key, take the place of the rows with their keys."""
        self.update(version, rows, lambda old, new: old.join(new, self.keys, "left_anti").unionByName(new))
