"""Session settings and the folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


SHUFFLE_PARTITION_BYTES = 200 * 1024 * 1024


def build_session(
    app: str = "fleetlens",
    master: str | None = None,
    shuffle_bytes: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the settings the operators need.

    ``shuffle_bytes`` is the size of the largest table to be shuffled. It sets the number of
    shuffle partitions, which AQE merges where they turn out small.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    if shuffle_bytes:
        partitions = max(200, -(-shuffle_bytes // SHUFFLE_PARTITION_BYTES))
        settings.setdefault("spark.sql.shuffle.partitions", str(partitions))
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="fleetlens-")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    A session on a cluster must set it; only a local one without it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
