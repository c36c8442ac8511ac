"""Current status per node from a stream of reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.streaming.versions import BucketedTable


def stream_latest_status(reports: DataFrame, keys: Sequence[str] = ("node_id",)) -> DataFrame:
    """Newest report per node by ``ts``, then ``seq``; late reports cannot replace newer ones.

    The aggregate is combined before the shuffle and its state is one row per node. Run it in
    update mode.
    """
    payload = [c for c in reports.columns if c not in (*keys, "ts", "seq")]
    newest = F.max(F.struct("ts", "seq", *payload)).alias("_newest")
    return reports.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


class CurrentStatusSink:
    """``foreachBatch`` sink that keeps one current row per node from the stream in update mode.

    A batch writes only the buckets of the nodes that it reports.
    """

    def __init__(self, path: str, schema: str, keys: Sequence[str] = ("node_id",), buckets: int = 64):
        self.table = BucketedTable(path, schema, keys, buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.table.replace(batch_id, batch)

    def current(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return self.table.read(spark, batch_id)
