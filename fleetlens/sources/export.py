"""Status export as JSON: one text per status row, or the status tree of each cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.ranking import number_chunk
from fleetlens.functions.scalars import is_true, json_or_raw

JSON_TYPES = (T.StringType, T.BooleanType, T.NumericType, T.StructType, T.ArrayType, T.MapType, T.VariantType)


#: Fields of a node in the tree, by kind.
FIELDS = {
    "primary": ("node_id", "hostname", "host", "port", "node_type", "running", "reachable"),
    "docker": ("node_id", "container_name", "docker_ip", "host_port", "running", "reachable"),
    "remote": (
        "node_id", "host", "reachable", "ssh_accessible", "mysql_running", "mysql_version",
    ),
}


def _text_of(rows: DataFrame, names: list[str] | tuple[str, ...]) -> Column:
    fields = [
        F.col(n) if isinstance(rows.schema[n].dataType, JSON_TYPES) else F.col(n).cast("string").alias(n)
        for n in names
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def status_tree(clusters: DataFrame, status: DataFrame, width: int = 4096) -> DataFrame:
    """One document per cluster: its name, primary, secondaries by kind, and what the group says.

    ``clusters`` holds ``cluster_id, cluster_name, cluster_output``; ``status`` is a ``status_union``.
    The output of the group counts only while the primary runs; it is an object if it is valid
    JSON, else a text. A cluster without status rows has a null primary and empty lists. Lists are
    joined from pieces of ``width`` positions, so only finished texts of one document meet.
    """
    node = F.when(F.col("kind") == "primary", _text_of(status, FIELDS["primary"]))
    for kind in ("docker", "remote"):
        node = node.when(F.col("kind") == kind, _text_of(status, FIELDS[kind]))
    pieces = (
        status.select(
            "cluster_id", "kind", "pos", "running", number_chunk("pos", width).alias("piece"), node.alias("node")
        )
        .groupBy("cluster_id", "kind", "piece")
        .agg(
            F.expr("listagg(node, ',') WITHIN GROUP (ORDER BY pos)").alias("nodes"),
            F.count(F.lit(1)).alias("n"),
            F.max(is_true(F.col("running"))).alias("runs"),
        )
    )
    first = F.col("kind") == "primary"
    parts = pieces.groupBy("cluster_id").agg(
        F.max(F.when(first, F.col("nodes"))).alias("primary"),
        F.max(F.when(first, F.col("runs"))).alias("runs"),
        F.sum(F.when(~first, F.col("n"))).alias("total"),
        *[
            F.expr(f"listagg(nodes, ',') WITHIN GROUP (ORDER BY piece) FILTER (WHERE kind = '{kind}')").alias(kind)
            for kind in ("docker", "remote")
        ],
    )
    said = json_or_raw(F.col("cluster_output"), F.col("runs"))
    group = F.coalesce(F.to_json(said["parsed"]), _quoted(said["raw"]), F.lit("null"))
    return clusters.join(parts, "cluster_id", "left").select(
        "cluster_id",
        F.concat(
            F.lit('{"cluster_name":'),
            F.coalesce(_quoted(F.col("cluster_name")), F.lit("null")),
            F.lit(',"primary":'),
            F.coalesce("primary", F.lit("null")),
            F.lit(',"secondaries":{"docker":['),
            F.coalesce("docker", F.lit("")),
            F.lit('],"remote":['),
            F.coalesce("remote", F.lit("")),
            F.lit('],"total_nodes":'),
            F.coalesce("total", F.lit(0)).cast("string"),
            F.lit('},"cluster":'),
            F.when(said["raw"].isNull() & said["parsed"].isNull(), F.lit("null")).otherwise(group),
            F.lit("}"),
        ).alias("status_json"),
    )


def status_export(status: DataFrame) -> DataFrame:
    """One JSON text per status row; values that JSON has no type for are written as text."""
    text = _text_of(status, status.columns)
    return status.select("cluster_id", "kind", "pos", text.alias("status_json"))
