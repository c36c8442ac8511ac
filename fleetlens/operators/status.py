"""Status rows: union of the three shapes, listing, rollup, latest row, availability."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.functions.scalars import is_true, truthy_coalesce

KIND_RANK = {"primary": 0, "docker": 1, "remote": 2}


def status_union(primary: DataFrame, docker: DataFrame, remote: DataFrame) -> DataFrame:
    """The primary, container and remote status shapes as one table with ``kind`` and ``up``."""
    shapes = {"primary": primary, "docker": docker, "remote": remote}
    merged = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [shape.withColumn("kind", F.lit(kind)) for kind, shape in shapes.items()],
    )
    return merged.withColumn("up", is_true(F.coalesce("running", "mysql_running")))


def status_listing(status: DataFrame) -> DataFrame:
    """Listing order of a cluster: primary, containers, remotes, each in list order."""
    rank = F.when(F.col("kind") == "primary", KIND_RANK["primary"])
    for kind in ("docker", "remote"):
        rank = rank.when(F.col("kind") == kind, KIND_RANK[kind])
    return status.withColumn("kind_rank", rank).orderBy("cluster_id", "kind_rank", "pos")


def status_rollup(status: DataFrame) -> DataFrame:
    """Per cluster and kind: all nodes, nodes up, nodes reachable."""
    return status.groupBy("cluster_id", "kind").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("up").alias("running"),
        F.count_if(is_true(F.col("reachable"))).alias("reachable"),
    )


def latest_status(reports: DataFrame, keys: Sequence[str] = ("node_id",)) -> DataFrame:
    """Newest report per node by ``ts``, then ``seq``.

    The rank test is applied per task before the shuffle, so a busy node sends one row per task.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("seq").desc())
    return reports.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def gate_remote_probe(
    ssh_user: Column, ssh_ok: Column, service_active: Column, version_ok: Column, version: Column
) -> dict[str, Column]:
    """Probe columns that count only when the step before them passed."""
    accessible = F.nullif(ssh_user, F.lit("")).isNotNull() & is_true(ssh_ok)
    return {
        "ssh_accessible": accessible,
        "mysql_running": accessible & is_true(service_active),
        "mysql_version": F.when(accessible & is_true(version_ok), version),
    }


def reachable_connections(nodes: DataFrame) -> DataFrame:
    """Connection columns of the primary (unchecked) and of every reachable secondary."""
    usable = (F.col("role") == fv.ROLE_PRIMARY) | is_true(F.col("reachable"))
    return nodes.filter(usable).select(
        "cluster_id", "node_id", "role", "host", "port", F.lit("root").alias("user")
    )


def plugin_rows(plugins: DataFrame, name: str) -> DataFrame:
    """Name and status of one plugin; the name is compared without regard to case."""
    return plugins.select("cluster_id", "node_id", "plugin_name", "plugin_status").filter(
        F.lower("plugin_name") == name.lower()
    )


def availability(nodes: DataFrame, checks: DataFrame, label: str) -> DataFrame:
    """Every node with its plugin check.

    ``nodes`` holds ``cluster_id, pos, node_id, role, reachable``; ``checks`` holds
    ``cluster_id, pos, found, error``. The primary is not tested for reachability, has its own
    wording, and does not pass on an error text.
    """
    primary = F.col("role") == fv.ROLE_PRIMARY
    unreachable = ~primary & ~is_true(F.col("reachable"))
    failed = F.col("error").isNotNull()
    available = ~unreachable & ~failed & is_true(F.col("found"))
    return (
        nodes.join(checks, ["cluster_id", "pos"], "left")
        .withColumn("available", available)
        .withColumn(
            "message",
            F.when(primary & available, fv.MESSAGES["plugin_there"] % label)
            .when(primary, fv.MESSAGES["plugin_absent"] % label)
            .when(unreachable, fv.MSG_UNREACHABLE)
            .when(failed, F.col("error"))
            .when(available, fv.MESSAGES["available"] % label)
            .otherwise(fv.MESSAGES["not_installed"] % label),
        )
        .select("cluster_id", "pos", "node_id", "available", "message")
    )


def program_path(
    explicit: Column, bin_dir: Column, found: Column, program: str, default: str
) -> Column:
    """Path of a program: configured path, then the bin directory, then lookup, then default."""
    return truthy_coalesce(
        explicit,
        F.when(bin_dir != "", F.concat_ws("/", bin_dir, F.lit(program))),
        found,
        F.lit(default),
    )
