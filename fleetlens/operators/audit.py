"""Audits: identities, settings drift, group membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.functions.scalars import truthy_coalesce
from fleetlens.functions.skew import join_per_group


def identities(nodes: DataFrame) -> DataFrame:
    """One row per node and identity it must not share within its cluster."""

    def entry(field: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"))

    return nodes.select(
        "cluster_id",
        "pos",
        F.inline(
            F.array(
                entry("node_id", F.col("node_id")),
                entry("server_id", truthy_coalesce(F.col("server_id"), F.col("node_id"), empty=0)),
                entry("endpoint", F.concat_ws(":", "host", F.col("port").cast("string"))),
                entry("docker_ip", F.col("docker_ip")),
                entry("container_name", F.col("container_name")),
            )
        ),
    ).filter(F.col("value").isNotNull())


def duplicate_identities(nodes: DataFrame) -> DataFrame:
    """Identities held by several nodes of a cluster, with their count and outer positions."""
    return (
        identities(nodes)
        .groupBy("cluster_id", "field", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("pos").alias("first_pos"),
            F.max("pos").alias("last_pos"),
        )
        .filter(F.col("n") > 1)
    )


def duplicate_members(nodes: DataFrame) -> DataFrame:
    """The nodes behind ``duplicate_identities``, one row each, however many share a value."""
    keys = ["cluster_id", "field", "value"]
    salted = identities(nodes).withColumn("_salt", F.pmod(F.xxhash64("pos"), F.lit(32)))
    # Counts per salt are few rows per value, however many nodes share it.
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    shared = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    shared = shared.filter("_all > 1").select(*keys, "_salt")
    return salted.join(shared, [*keys, "_salt"], "left_semi").drop("_salt")


def octet_overflows(nodes: DataFrame) -> DataFrame:
    """Container addresses whose last part is not a valid octet."""
    octet = F.substring_index("docker_ip", ".", -1).cast("int")
    return nodes.filter(octet > fv.MAX_OCTET).select(
        "cluster_id",
        F.lit("docker_ip").alias("field"),
        F.col("docker_ip").alias("value"),
        F.lit(1).cast("long").alias("n"),
        F.col("pos").alias("first_pos"),
        F.col("pos").alias("last_pos"),
    )


def credential_mismatches(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Nodes whose credential hash differs from that of their cluster."""
    expected = clusters.select("cluster_id", F.col("credential_hash").alias("_expected"))
    return (
        join_per_group(nodes, expected, ["cluster_id"], ["pos"])
        .filter(~F.col("credential_hash").eqNullSafe(F.col("_expected")))
        .select(
            "cluster_id",
            F.lit("credential").alias("field"),
            F.lit(None).cast("string").alias("value"),
            F.lit(1).cast("long").alias("n"),
            F.col("pos").alias("first_pos"),
            F.col("pos").alias("last_pos"),
        )
    )


def identity_audit(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """All identity findings: duplicate, octet_overflow, credential_differs."""
    findings = {
        "duplicate": duplicate_identities(nodes),
        "octet_overflow": octet_overflows(nodes),
        "credential_differs": credential_mismatches(nodes, clusters),
    }
    first, *others = [rows.withColumn("finding", F.lit(name)) for name, rows in findings.items()]
    for rows in others:
        first = first.unionByName(rows)
    return first


def expected_settings(nodes: DataFrame) -> DataFrame:
    """Settings each node should have: those of its file and, for containers, of its command line.

    Command-line entries repeat file keys with equal values; ``source = 'file'`` has each key once.
    """

    def entries(source: str, values: dict[str, Column]) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(source).alias("source"),
                    F.lit(key).alias("key"),
                    value.cast("string").alias("value"),
                )
                for key, value in values.items()
            ]
        )

    primary = F.col("role") == fv.ROLE_PRIMARY
    effective = truthy_coalesce(F.col("server_id"), F.col("node_id"), empty=0)
    file_entries = entries(
        "file",
        {
            "server-id": F.when(primary, F.col("server_id")).otherwise(effective),
            "port": F.when(primary, F.col("port")).otherwise(fv.SERVER_PORT),
            **{key: F.lit(value) for key, value in fv.SHARED_SETTINGS.items()},
        },
    )
    flag_entries = entries(
        "command_line",
        {"server-id": effective, **{k: F.lit(v) for k, v in fv.CONTAINER_FLAGS.items()}},
    )
    container = ~primary & (F.col("node_type") == fv.TYPE_CONTAINER)
    return nodes.select(
        "cluster_id",
        "pos",
        F.inline(F.when(container, F.concat(file_entries, flag_entries)).otherwise(file_entries)),
    )


def settings_drift(expected: DataFrame, observed: DataFrame, *node: str) -> DataFrame:
    """Expected against observed settings: ok, missing, extra, changed.

    ``-`` and ``_`` in a key mean the same. ``node`` names the columns that identify a node.
    """

    def side(settings: DataFrame, name: str) -> DataFrame:
        return settings.select(
            *node,
            F.translate("key", "_", "-").alias("key"),
            F.col("value").alias(name),
            F.lit(True).alias(f"_{name}"),
        )

    joined = side(expected, "expected").join(side(observed, "observed"), [*node, "key"], "full_outer")
    return joined.select(
        *node,
        "key",
        "expected",
        "observed",
        F.when(F.col("_observed").isNull(), "missing")
        .when(F.col("_expected").isNull(), "extra")
        .when(F.col("expected").eqNullSafe(F.col("observed")), "ok")
        .otherwise("changed")
        .alias("drift"),
    )


def reconcile_members(desired: DataFrame, actual: DataFrame, *member: str) -> DataFrame:
    """Desired against actual group members: add, keep, remove; repeated members count once."""
    want = desired.select(*member).distinct().withColumn("_want", F.lit(True))
    have = actual.select(*member).distinct().withColumn("_have", F.lit(True))
    return want.join(have, list(member), "full_outer").select(
        *member,
        F.when(F.col("_have").isNull(), "add")
        .when(F.col("_want").isNull(), "remove")
        .otherwise("keep")
        .alias("action"),
    )
