"""Change streams: replay removal and a snapshot that stays current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators import transactions
from fleetlens.operators.changes import apply_changes, as_snapshot, dedup_changes, latest_changes
from fleetlens.streaming.versions import BucketedTable, VersionedTable, adaptive


def stream_dedup_changes(changes: DataFrame, delay: str, salts: int = 1) -> DataFrame:
    """First arrival of each (``source``, ``seq``); replays within ``delay`` of it are dropped.

    The state holds the ids inside the watermark. Run it in append mode. If a single change may be
    replayed so often that its copies overload a task, ``salts`` above 1 drops copies in two steps,
    first among the input partitions that share a salt; that costs a second state of up to
    ``salts`` entries per id.
    """
    marked = changes.withWatermark("ts", delay)
    if salts > 1:
        salted = marked.withColumn("_salt", F.spark_partition_id() % F.lit(salts))
        marked = salted.dropDuplicatesWithinWatermark(["source", "seq", "_salt"]).drop("_salt")
    return marked.dropDuplicatesWithinWatermark(["source", "seq"])


class SnapshotSink:
    """``foreachBatch`` sink that keeps a table current from a stream of changes.

    The latest change per key lies in a ``BucketedTable``; the base stays as it is and ``snapshot`` merges
    both. Outdated versions stay until ``fold``: it writes the snapshot as a table, from which a new
    sink with a new path and checkpoint goes on; ``last_seq`` keeps replayed changes harmless.
    """

    def __init__(self, path: str, base: DataFrame, *keys: str, buckets: int = 64):
        self.base = base if "last_seq" in base.columns else as_snapshot(base)
        self.path, self.keys = path, keys
        fields = [f for f in self.base.schema if f.name not in ("last_seq", "deleted")]
        schema = T.StructType(fields).add("seq", "long").add("op", "string")
        self.delta = BucketedTable(path, schema, keys, buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.delta.update(
            batch_id, batch, lambda old, new: latest_changes(old.unionByName(new), *self.keys)
        )

    def snapshot(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The table after batch ``batch_id``, with tombstones."""
        return apply_changes(self.base, self.delta.read(spark, batch_id), *self.keys)

    def fold(self, spark: SparkSession, batch_id: int, target: str) -> DataFrame:
        """Write the snapshot after batch ``batch_id`` to ``target`` as the base of a new sink."""
        self.snapshot(spark, batch_id).write.parquet(target)
        return spark.read.parquet(target)


class AppliedSink:
    """``foreachBatch`` sink that passes each change once, however late a replay comes.

    What was passed is kept as intervals of ids per source, not id by id: state grows with the gaps, not with
    the history, and needs no delay after which replays would pass again. New rows go to ``{path}/rows``;
    ``applied`` and ``gaps`` tell what a source has sent and what is missing in between.
    """

    def __init__(self, path: str, source: str = "source int", width: int = transactions.WIDTH):
        self.path, self.keys, self.width = path, [f.split()[0] for f in source.split(",")], width
        self.sets = VersionedTable(f"{path}/applied", f"{source}, low long, high long")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Like the tables of a sink, two folders take turns.
        staged = VersionedTable(f"{self.path}/staged", batch.schema)
        staged.write(batch_id, batch)
        with adaptive(spark):
            held, known = staged.read(spark, batch_id), self.sets.read(spark, batch_id - 1)
            tasks = transactions.tasks_for(held) + transactions.tasks_for(known)
            once = dedup_changes(held, [*self.keys, "seq"])
            found = transactions.contains(once, known, self.keys, width=self.width, tasks=tasks)
            target = f"{self.path}/rows/batch={batch_id}"
            found.filter("NOT applied").drop("applied").write.mode("overwrite").parquet(target)
            # What was not passed again is in the set already.
            fresh = spark.read.schema(batch.schema).parquet(target)
            seen = transactions.transaction_set(fresh, self.keys, width=self.width)
            self.sets.write(batch_id, transactions.union(known, seen, self.keys, self.width))

    def applied(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self.sets.read(spark, batch_id)

    def gaps(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return transactions.gaps(self.applied(spark, batch_id), self.keys, self.width)
