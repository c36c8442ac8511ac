"""Node lists: listing, filtering, deriving and addressing the nodes of many clusters.

A node table has one row per (``cluster_id``, ``pos``). Position 0 is the primary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.functions.ranking import expand_slots, group_position, number_chunk
from fleetlens.functions.scalars import is_true, truthy_coalesce


def explode_nodes(docs: DataFrame, *keep: str) -> DataFrame:
    """All nodes of every cluster, primary first, then the secondaries in list order.

    ``docs`` holds ``cluster_id``, ``primary`` (nullable struct) and ``secondaries`` (array).
    """
    element = docs.schema["secondaries"].dataType.elementType.simpleString()
    empty = F.array().cast(f"array<{element}>")
    nodes = F.filter(
        F.concat(F.array("primary"), F.coalesce("secondaries", empty)), lambda n: n.isNotNull()
    )
    return docs.select("cluster_id", *keep, F.posexplode(nodes).alias("pos", "node")).select(
        "cluster_id", *keep, "pos", "node.*"
    )


def nodes_by_type(nodes: DataFrame, node_type: str) -> DataFrame:
    """Secondaries of one deployment type."""
    return nodes_by_role(nodes, fv.ROLE_SECONDARY).filter(F.col("node_type") == node_type)


def nodes_by_role(nodes: DataFrame, role: str) -> DataFrame:
    return nodes.filter(F.col("role") == role)


def drop_nodes(nodes: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove requested secondaries: (nodes kept, requests not found).

    ``requests`` holds ``cluster_id, node_id``. If several secondaries share the id, only the
    first of them goes.
    """
    wanted = requests.select("cluster_id", "node_id").distinct()
    secondaries = nodes_by_role(nodes, fv.ROLE_SECONDARY)
    first = (
        secondaries.join(wanted, ["cluster_id", "node_id"], "left_semi")
        .groupBy("cluster_id", "node_id")
        .agg(F.min("pos").alias("pos"))
    )
    dropped = F.col("pos").eqNullSafe(F.col("_first")) & (F.col("role") == fv.ROLE_SECONDARY)
    kept = (
        nodes.join(first.withColumnRenamed("pos", "_first"), ["cluster_id", "node_id"], "left")
        .filter(~is_true(dropped))
        .select(*nodes.columns)
    )
    not_found = wanted.join(first, ["cluster_id", "node_id"], "left_anti").withColumn(
        "message", F.format_string(fv.MESSAGES["node_not_found"], "node_id")
    )
    return kept, not_found


def infer_node_type(node_type: Column, host: Column, ssh_user: Column) -> Column:
    """An explicit type wins; else remote if host and SSH user are given, else container."""
    given = (F.coalesce(host, F.lit("")) != "") & (F.coalesce(ssh_user, F.lit("")) != "")
    return F.coalesce(
        node_type, F.when(given, fv.TYPE_REMOTE).otherwise(fv.TYPE_CONTAINER)
    )


def derive_secondaries(rows: DataFrame, default_network: str | None = None) -> DataFrame:
    """Full node columns from ``node_id, node_type, host, ssh_user, ssh_key_path`` and what the cluster
    gives: ``docker_base_ip, docker_network, credential_hash``.

    Container nodes get name, address and port from their id, and the cluster's network. All other
    types are treated as remote machines, whose network is ``default_network``.
    """
    blank = F.lit(None).cast("string")
    container = F.col("node_type") == fv.TYPE_CONTAINER
    number = F.col("node_id") - 1
    name = F.format_string("mysql-secondary-%d", number)
    host = truthy_coalesce(F.col("host"), F.lit(fv.LOOPBACK))
    return rows.withColumns(
        {
            "hostname": F.when(container, name).otherwise(
                truthy_coalesce(F.col("host"), F.format_string("secondary-%d", number))
            ),
            "role": F.lit(fv.ROLE_SECONDARY),
            "node_type": F.when(container, fv.TYPE_CONTAINER).otherwise(fv.TYPE_REMOTE),
            "host": F.when(container, fv.LOOPBACK).otherwise(host),
            "port": F.when(container, F.col("node_id") + fv.CONTAINER_PORT_BASE)
            .otherwise(fv.SERVER_PORT)
            .cast("int"),
            "ssh_user": F.when(~container, F.col("ssh_user")),
            "ssh_key_path": F.when(~container, F.col("ssh_key_path")),
            "ssh_port": F.lit(fv.NODE_DEFAULTS["ssh_port"]),
            "container_name": F.when(container, name),
            "docker_network": F.when(container, F.col("docker_network")).otherwise(
                F.lit(default_network).cast("string")
            ),
            "docker_ip": F.when(
                container,
                F.concat_ws(
                    ".",
                    F.col("docker_base_ip"),
                    (F.col("node_id") + fv.CONTAINER_OCTET_BASE).cast("string"),
                ),
            ),
            "server_id": F.col("node_id"),
            "data_dir": blank,
            "config_file": blank,
            "local_address": blank,
            "group_seeds": blank,
            "credential_hash": F.col("credential_hash"),
        }
    ).drop("docker_base_ip")


def derive_container_nodes(rows: DataFrame) -> DataFrame:
    """Container nodes from ``node_id, docker_base_ip, docker_network, credential_hash``."""
    blank = F.lit(None).cast("string")
    return derive_secondaries(
        rows.withColumns(
            {
                "node_type": F.lit(fv.TYPE_CONTAINER),
                "host": blank,
                "ssh_user": blank,
                "ssh_key_path": blank,
            }
        )
    )


def derive_remote_nodes(rows: DataFrame, default_network: str | None = None) -> DataFrame:
    """Remote machine nodes from ``node_id, host, ssh_user, ssh_key_path, credential_hash``."""
    blank = F.lit(None).cast("string")
    return derive_secondaries(
        rows.withColumns(
            {
                "node_type": F.lit(fv.TYPE_REMOTE),
                "docker_base_ip": blank,
                "docker_network": blank,
            }
        ),
        default_network,
    )


def derive_primary_nodes(clusters: DataFrame) -> DataFrame:
    """Primary node of each cluster from ``cluster_id, hostname, primary_type, base_dir``."""
    return clusters.select(
        "cluster_id",
        F.lit(0).alias("pos"),
        F.lit(1).alias("node_id"),
        "hostname",
        F.lit(fv.ROLE_PRIMARY).alias("role"),
        F.col("primary_type").alias("node_type"),
        F.lit(fv.LOOPBACK).alias("host"),
        F.lit(fv.SERVER_PORT).alias("port"),
        F.lit(1).alias("server_id"),
        F.when(
            F.col("primary_type") == fv.TYPE_BINARY,
            F.concat_ws("/", "base_dir", F.lit("data"), F.lit("primary")),
        ).alias("data_dir"),
    )


def connection_uri(host: Column, port: Column, user: str = "root") -> Column:
    """``user@host:port``; the password is left out on purpose."""
    return F.concat(F.lit(f"{user}@"), host, F.lit(":"), port.cast("string"))


def local_address(address: Column, hostname: Column) -> Column:
    """The given address if not empty, else the host name with the constant server port."""
    return truthy_coalesce(address, F.concat(hostname, F.lit(f":{fv.SERVER_PORT}")))


def effective_image(use_custom_image: Column, docker_image: Column, version: Column) -> Column:
    return F.when(use_custom_image, docker_image).otherwise(F.concat(F.lit("mysql:"), version))


def node_defaults(nodes: DataFrame) -> DataFrame:
    """Fill ``server_id`` and ``container_name``; ``effective_server_id`` also replaces 0."""
    server_id = F.coalesce("server_id", "node_id")
    return nodes.withColumns(
        {
            "server_id": server_id,
            "container_name": F.coalesce(
                "container_name",
                F.when(
                    F.col("node_type") == fv.TYPE_CONTAINER,
                    F.format_string("mysql-node-%d", "node_id"),
                ),
            ),
            "effective_server_id": truthy_coalesce(server_id, F.col("node_id"), empty=0),
        }
    )


def node_counts(nodes: DataFrame) -> DataFrame:
    """Nodes per cluster: all, secondaries, and secondaries per type."""
    secondary = F.col("role") == fv.ROLE_SECONDARY
    return nodes.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.count_if(secondary).alias("secondary_count"),
        F.count_if(secondary & (F.col("node_type") == fv.TYPE_CONTAINER)).alias("docker_count"),
        F.count_if(secondary & (F.col("node_type") == fv.TYPE_REMOTE)).alias("remote_count"),
    )


def group_seeds(nodes: DataFrame, width: int = 4096) -> DataFrame:
    """Comma list of local addresses per cluster, primary first.

    Lists are built per chunk of positions and then joined, so only finished pieces of the
    one output text meet in a task.
    """
    pieces = (
        nodes.select(
            "cluster_id",
            "pos",
            number_chunk("pos", width).alias("piece"),
            local_address(F.col("local_address"), F.col("hostname")).alias("address"),
        )
        .groupBy("cluster_id", "piece")
        .agg(F.expr("listagg(address, ',') WITHIN GROUP (ORDER BY pos)").alias("seeds"))
    )
    return pieces.groupBy("cluster_id").agg(
        F.expr("listagg(seeds, ',') WITHIN GROUP (ORDER BY piece)").alias("group_seeds")
    )


def number_nodes(new_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids for new secondaries in ``pos`` order: count of present secondaries + 1 + position.

    The rule looks at the count only, so ids can repeat after a removal; see ``identity_audit``.
    """
    present = (
        nodes_by_role(nodes, fv.ROLE_SECONDARY)
        .groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("_present"))
    )
    numbered = group_position(
        new_nodes, ["cluster_id"], ["pos"], number_chunk("pos"), "_position", per_group=present
    )
    return numbered.withColumn(
        "node_id", F.coalesce("_present", F.lit(0)) + F.col("_position") + 1
    ).drop("_present", "_position")


def _mark_tail(nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """Container nodes with ``_tail``: is the node one of the last ``k`` of its cluster?"""
    ranked = group_position(
        nodes_by_type(nodes, fv.TYPE_CONTAINER),
        ["cluster_id"],
        ["pos"],
        number_chunk("pos"),
        "_position",
        total="_all",
        per_group=limits.select("cluster_id", F.col("k").alias("_k")),
    )
    tail = F.coalesce(F.col("_all") - F.col("_position") < F.col("_k"), F.lit(False))
    return ranked.withColumn("_tail", tail).drop("_all", "_position", "_k")


def tail_removal(nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """The last ``k`` container nodes of each cluster by position; ``limits`` holds ``cluster_id, k``."""
    return _mark_tail(nodes, limits).filter("_tail").drop("_tail")


def allocate_remote_first(
    requests: DataFrame,
    remote_hosts: DataFrame,
    nodes: DataFrame | None = None,
    default_network: str | None = None,
) -> DataFrame:
    """Fill each cluster's requested slots: remote hosts first, containers for the rest.

    ``requests`` holds ``cluster_id, count`` and the cluster's columns for derived nodes;
    ``remote_hosts`` holds
    ``cluster_id, pos, host, ssh_user, ssh_key_path`` with positions from 0. Surplus hosts are
    not used. ``nodes`` gives the secondaries already present.
    """
    if nodes is None:
        wanted = requests.withColumn("_present", F.lit(0).cast("long"))
    else:
        counts = node_counts(nodes).select("cluster_id", F.col("secondary_count").alias("_present"))
        wanted = requests.join(counts, "cluster_id", "left").fillna(0, ["_present"])
    hosts = remote_hosts.select(
        "cluster_id",
        F.col("pos").cast("long").alias("slot"),
        "host",
        "ssh_user",
        "ssh_key_path",
        F.lit(fv.TYPE_REMOTE).alias("node_type"),
    )
    return derive_secondaries(
        expand_slots(wanted, "count", "slot")
        .join(hosts, ["cluster_id", "slot"], "left")
        .withColumn("node_id", (F.col("_present") + F.col("slot") + 2).cast("int"))
        .withColumn("node_type", F.coalesce("node_type", F.lit(fv.TYPE_CONTAINER))),
        default_network,
    ).drop("_present", "count")


def scale_plan(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per cluster: what scaling to ``target`` secondaries would change.

    Only container nodes are added or removed, so ``current_count`` exceeds the target when a
    cluster has more remote machines than the target.
    """
    counts = node_counts(nodes).select(
        "cluster_id", "secondary_count", "docker_count", "remote_count"
    )
    plan = targets.join(counts, "cluster_id", "left").fillna(
        0, ["secondary_count", "docker_count", "remote_count"]
    )
    change = F.col("docker_target") - F.col("docker_count")
    return (
        plan.withColumn(
            "docker_target",
            F.greatest(F.col("target").cast("long") - F.col("remote_count"), F.lit(0).cast("long")),
        )
        .withColumns(
            {
                "previous_count": F.col("secondary_count"),
                "add_count": F.greatest(change, F.lit(0).cast("long")),
                "remove_count": F.greatest(-change, F.lit(0).cast("long")),
                "current_count": F.col("secondary_count") + change,
                "message": F.when(
                    change == 0, F.format_string(fv.MESSAGES["already_scaled"], "docker_count")
                ).otherwise(F.format_string(fv.MESSAGES["scaled"], "docker_target")),
            }
        )
        .drop("secondary_count")
    )


#: What a derived node takes over from its cluster.
OF_CLUSTER = ("docker_base_ip", "docker_network", "credential_hash")


def plan_additions(plan: DataFrame) -> DataFrame:
    """Container nodes that a plan adds; ``plan`` also holds the cluster's columns for them."""
    slots = expand_slots(
        plan.select("cluster_id", *OF_CLUSTER, "previous_count", "add_count"),
        "add_count",
        "slot",
    ).withColumn("node_id", (F.col("previous_count") + F.col("slot") + 2).cast("int"))
    return derive_container_nodes(slots).drop("previous_count", "add_count")


def _removal_limits(plan: DataFrame) -> DataFrame:
    return plan.select("cluster_id", F.col("remove_count").alias("k"))


def plan_removals(plan: DataFrame, nodes: DataFrame) -> DataFrame:
    """Container nodes that a plan removes, taken from the end."""
    return tail_removal(nodes, _removal_limits(plan))


def apply_scale_plan(plan: DataFrame, nodes: DataFrame) -> DataFrame:
    """Secondaries after a plan: those kept, then the added ones behind the last position.

    The added ones have every node column; what ``nodes`` holds besides (such as whether a node was
    reached) is not known for them and null.
    """
    secondaries = nodes_by_role(nodes, fv.ROLE_SECONDARY)
    containers = _mark_tail(nodes, _removal_limits(plan)).filter("NOT _tail").drop("_tail")
    others = secondaries.filter(~F.col("node_type").eqNullSafe(fv.TYPE_CONTAINER))
    kept = others.unionByName(containers)
    last = secondaries.groupBy("cluster_id").agg(F.max("pos").alias("_last"))
    placed = plan.join(last, "cluster_id", "left").withColumn(
        "_last", F.coalesce("_last", F.lit(0))
    )
    slots = expand_slots(
        placed.select("cluster_id", *OF_CLUSTER, "previous_count", "add_count", "_last"),
        "add_count",
        "slot",
    ).withColumns(
        {
            "node_id": (F.col("previous_count") + F.col("slot") + 2).cast("int"),
            "pos": F.col("_last") + F.col("slot") + 1,
        }
    )
    added = derive_container_nodes(slots).drop("previous_count", "add_count", "_last", "slot")
    observed = {
        f.name: F.lit(None).cast(f.dataType)
        for f in nodes.schema
        if f.name not in added.columns
    }
    added = added.withColumns(observed)
    return kept.select(*nodes.columns).unionByName(added.select(*nodes.columns))
