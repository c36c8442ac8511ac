"""Node listing, derivation, numbering and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.operators import nodes as ops
from fleetlens.plans.registry import query
from fleetlens.plans.views import Fleet
from fleetlens.sources import documents

LONG = "long"
NETWORK = "cluster-net"
NODE_COLUMNS = [key for key in fv.NODE_KEYS if key != fv.NODE_SECRET_KEY] + ["credential_hash"]

ADDRESSES = """
    coalesce(nullif(local_address, ''), concat(hostname, ':3306'))"""


def nested_documents(f: Fleet) -> DataFrame:
    """One row per cluster with nested nodes, read from its document."""
    node = ", ".join(
        f"{c}: {'int' if c in fv.NODE_INT_KEYS else 'string'}" for c in fv.NODE_KEYS if c != fv.NODE_SECRET_KEY
    )
    docs = documents.encode_cluster_docs(f.v_cluster.select("cluster_id", "cluster_name"), f.v_node)
    nested = F.from_json("doc", f"primary struct<{node}>, secondaries array<struct<{node}>>")
    return docs.select("cluster_id", nested.alias("_d")).select("cluster_id", "_d.*")


@query(
    "prj1_explode_nodes",
    """SELECT n.* EXCLUDE (cluster_id, pos, credential_hash, reachable), n.cluster_id,
              CAST(CASE WHEN p.cluster_id IS NULL THEN n.pos - 1 ELSE n.pos END AS INT) AS pos
       FROM {v_node} n JOIN {v_cluster} c ON c.cluster_id = n.cluster_id
            LEFT JOIN (SELECT DISTINCT cluster_id FROM {v_primary}) p ON p.cluster_id = n.cluster_id""",
)
def explode_nodes(f: Fleet) -> DataFrame:
    return ops.explode_nodes(nested_documents(f))


@query(
    "prj2_nodes_by_type",
    """SELECT cluster_id, pos, node_id, node_type, host, port FROM {v_node}
       WHERE role = 'secondary' AND node_type = 'remote_machine'
       UNION ALL
       SELECT cluster_id, pos, node_id, node_type, host, port FROM {v_node}
       WHERE role = 'secondary' AND node_type = 'docker_container'
       UNION ALL
       SELECT cluster_id, pos, node_id, 'any', host, port FROM {v_node}
       WHERE role = 'secondary'""",
)
def nodes_by_type(f: Fleet) -> DataFrame:
    columns = ["cluster_id", "pos", "node_id", "node_type", "host", "port"]
    remote = ops.nodes_by_type(f.v_node, fv.TYPE_REMOTE).select(columns)
    container = ops.nodes_by_type(f.v_node, fv.TYPE_CONTAINER).select(columns)
    everyone = ops.nodes_by_role(f.v_node, fv.ROLE_SECONDARY).withColumn("node_type", F.lit("any"))
    return remote.unionByName(container).unionByName(everyone.select(columns))


@query(
    "prj3_drop_nodes",
    """WITH wanted AS (SELECT DISTINCT cluster_id, node_id FROM {v_drop_request}),
         ranked AS (SELECT n.*, row_number() OVER (PARTITION BY cluster_id, node_id, role
                                                   ORDER BY pos) AS rn FROM {v_node} n),
         kept AS (SELECT r.* FROM ranked r LEFT JOIN wanted w USING (cluster_id, node_id)
                  WHERE w.node_id IS NULL OR r.role = 'primary' OR r.rn > 1)
       SELECT cluster_id, node_id, pos, 'kept' AS message FROM kept
       UNION ALL
       SELECT cluster_id, node_id, NULL, concat('Node ', node_id, ' not found')
       FROM wanted WHERE (cluster_id, node_id) NOT IN
            (SELECT (cluster_id, node_id) FROM {v_secondary})""",
)
def drop_nodes(f: Fleet) -> DataFrame:
    kept, missing = ops.drop_nodes(f.v_node, f.v_drop_request)
    return kept.select("cluster_id", "node_id", "pos", F.lit("kept").alias("message")).unionByName(
        missing, allowMissingColumns=True
    )


@query(
    "prj5_derive_container_node",
    """SELECT request_id, node_id, concat('mysql-secondary-', node_id - 1) AS container_name,
              concat('mysql-secondary-', node_id - 1) AS hostname, '127.0.0.1' AS host,
              CAST(33060 + node_id AS INT) AS port,
              concat(docker_base_ip, '.', 10 + node_id) AS docker_ip, node_id AS server_id,
              'secondary' AS role, 'docker_container' AS node_type, docker_network, credential_hash,
              22 AS ssh_port, CAST(NULL AS VARCHAR) AS ssh_user, CAST(NULL AS VARCHAR) AS ssh_key_path,
              CAST(NULL AS VARCHAR) AS data_dir, CAST(NULL AS VARCHAR) AS config_file,
              CAST(NULL AS VARCHAR) AS local_address, CAST(NULL AS VARCHAR) AS group_seeds
       FROM {v_request}""",
)
def derive_container_node(f: Fleet) -> DataFrame:
    return ops.derive_container_nodes(f.v_request).select("request_id", *NODE_COLUMNS)


@query(
    "prj6_derive_remote_node",
    """SELECT request_id, node_id,
              CASE WHEN host IS NULL OR host = '' THEN concat('secondary-', node_id - 1)
                   ELSE host END AS hostname,
              CASE WHEN host IS NULL OR host = '' THEN '127.0.0.1' ELSE host END AS host,
              3306 AS port, ssh_user, ssh_key_path, node_id AS server_id, 'secondary' AS role,
              'remote_machine' AS node_type, 'cluster-net' AS docker_network, credential_hash,
              22 AS ssh_port, CAST(NULL AS VARCHAR) AS container_name,
              CAST(NULL AS VARCHAR) AS docker_ip, CAST(NULL AS VARCHAR) AS data_dir,
              CAST(NULL AS VARCHAR) AS config_file, CAST(NULL AS VARCHAR) AS local_address,
              CAST(NULL AS VARCHAR) AS group_seeds
       FROM {v_request}""",
)
def derive_remote_node(f: Fleet) -> DataFrame:
    return ops.derive_remote_nodes(f.v_request, NETWORK).select("request_id", *NODE_COLUMNS)


@query(
    "prj7_infer_node_type",
    """SELECT request_id,
              CASE WHEN node_type IS NOT NULL THEN node_type
                   WHEN host <> '' AND ssh_user <> '' THEN 'remote_machine'
                   ELSE 'docker_container' END AS node_type
       FROM {v_request}""",
)
def infer_node_type(f: Fleet) -> DataFrame:
    inferred = ops.infer_node_type(F.col("node_type"), F.col("host"), F.col("ssh_user"))
    return f.v_request.select("request_id", inferred.alias("node_type"))


@query(
    "prj8_addresses",
    f"""SELECT cluster_id, pos, concat('root@', host, ':', port) AS uri,
               {ADDRESSES} AS local_address
        FROM {{v_node}}""",
)
def addresses(f: Fleet) -> DataFrame:
    return f.v_node.select(
        "cluster_id",
        "pos",
        ops.connection_uri(F.col("host"), F.col("port")).alias("uri"),
        ops.local_address(F.col("local_address"), F.col("hostname")).alias("local_address"),
    )


@query(
    "prj9_effective_image",
    """SELECT cluster_id, CASE WHEN use_custom_image THEN docker_image
                               ELSE concat('mysql:', mysql_version) END AS image
       FROM {v_cluster}""",
)
def effective_image(f: Fleet) -> DataFrame:
    image = ops.effective_image(
        F.col("use_custom_image"), F.col("docker_image"), F.col("mysql_version")
    )
    return f.v_cluster.select("cluster_id", image.alias("image"))


@query(
    "prj10_node_defaults",
    """SELECT cluster_id, pos, CASE WHEN server_id IS NULL THEN node_id ELSE server_id END AS server_id,
              CASE WHEN container_name IS NULL AND node_type = 'docker_container'
                   THEN concat('mysql-node-', node_id) ELSE container_name END AS container_name,
              CASE WHEN server_id IS NULL OR server_id = 0 THEN node_id
                   ELSE server_id END AS effective_server_id
       FROM {v_node}""",
)
def node_defaults(f: Fleet) -> DataFrame:
    return ops.node_defaults(f.v_node).select(
        "cluster_id", "pos", "server_id", "container_name", "effective_server_id"
    )


@query(
    "prj15_derive_primary_node",
    """SELECT cluster_id, 0 AS pos, 1 AS node_id, hostname, 'primary' AS role,
              primary_type AS node_type, '127.0.0.1' AS host, 3306 AS port, 1 AS server_id,
              CASE WHEN primary_type = 'local_binary'
                   THEN concat(base_dir, '/data/primary') END AS data_dir
       FROM {v_cluster}""",
)
def derive_primary_node(f: Fleet) -> DataFrame:
    return ops.derive_primary_nodes(f.v_cluster)


@query(
    "ag1_node_counts",
    """SELECT cluster_id, count(*) AS node_count,
              count(*) FILTER (WHERE role = 'secondary') AS secondary_count,
              count(*) FILTER (WHERE role = 'secondary' AND node_type = 'docker_container')
                AS docker_count,
              count(*) FILTER (WHERE role = 'secondary' AND node_type = 'remote_machine')
                AS remote_count
       FROM {v_node} GROUP BY cluster_id""",
)
def node_counts(f: Fleet) -> DataFrame:
    return ops.node_counts(f.v_node)


@query(
    "ag2_group_seeds",
    f"""SELECT cluster_id, string_agg({ADDRESSES}, ',' ORDER BY pos) AS group_seeds
        FROM {{v_node}} GROUP BY cluster_id""",
)
def group_seeds(f: Fleet) -> DataFrame:
    return ops.group_seeds(f.v_node)


@query(
    "wn1_number_nodes",
    """SELECT r.request_id, r.cluster_id,
              coalesce(s.n, 0) + row_number() OVER (PARTITION BY r.cluster_id ORDER BY r.pos) + 1
                AS node_id
       FROM {v_request} r LEFT JOIN
            (SELECT cluster_id, count(*) AS n FROM {v_secondary} GROUP BY cluster_id) s
            ON r.cluster_id = s.cluster_id""",
)
def number_nodes(f: Fleet) -> DataFrame:
    return ops.number_nodes(f.v_request.drop("node_id"), f.v_node).select(
        "request_id", "cluster_id", "node_id"
    )


@query(
    "wn2_tail_removal",
    """SELECT cluster_id, pos, node_id FROM
         (SELECT n.*, row_number() OVER (PARTITION BY cluster_id ORDER BY pos DESC) AS rn
          FROM {v_secondary} n WHERE node_type = 'docker_container') n
       JOIN {v_cluster} c USING (cluster_id) WHERE rn <= target""",
)
def tail_removal(f: Fleet) -> DataFrame:
    limits = f.v_cluster.select("cluster_id", F.col("target").alias("k"))
    return ops.tail_removal(f.v_node, limits).select("cluster_id", "pos", "node_id")


@query(
    "jn1_allocate_remote_first",
    """WITH slots AS (SELECT cluster_id, docker_base_ip, docker_network, credential_hash,
                             unnest(range(target)) AS slot
                      FROM {v_cluster} WHERE target > 0)
       SELECT s.cluster_id, s.slot, CAST(s.slot + 2 AS INT) AS node_id,
              CASE WHEN h.pos IS NULL THEN 'docker_container' ELSE 'remote_machine' END AS node_type,
              CASE WHEN h.pos IS NULL THEN '127.0.0.1' ELSE h.host END AS host,
              CAST(CASE WHEN h.pos IS NULL THEN 33062 + s.slot ELSE 3306 END AS INT) AS port,
              CASE WHEN h.pos IS NULL THEN concat('mysql-secondary-', s.slot + 1)
                   ELSE h.host END AS hostname,
              CASE WHEN h.pos IS NULL THEN concat(docker_base_ip, '.', 12 + s.slot) END AS docker_ip,
              h.ssh_user, h.ssh_key_path, s.credential_hash, 'secondary' AS role, 22 AS ssh_port,
              CASE WHEN h.pos IS NULL THEN docker_network ELSE 'cluster-net' END AS docker_network,
              CASE WHEN h.pos IS NULL THEN concat('mysql-secondary-', s.slot + 1) END AS container_name,
              CAST(s.slot + 2 AS INT) AS server_id, CAST(NULL AS VARCHAR) AS data_dir,
              CAST(NULL AS VARCHAR) AS config_file, CAST(NULL AS VARCHAR) AS local_address,
              CAST(NULL AS VARCHAR) AS group_seeds
       FROM slots s LEFT JOIN {v_remote_host} h ON h.cluster_id = s.cluster_id AND h.pos = s.slot""",
)
def allocate_remote_first(f: Fleet) -> DataFrame:
    requests = f.v_cluster.select("cluster_id", F.col("target").alias("count"), *ops.OF_CLUSTER)
    placed = ops.allocate_remote_first(requests, f.v_remote_host, default_network=NETWORK)
    return placed.select("cluster_id", "slot", *NODE_COLUMNS)


PLAN = """counts AS (SELECT c.cluster_id, c.docker_base_ip, c.docker_network, c.credential_hash,
                    c.target, count(n.pos) AS secondaries,
                    count(*) FILTER (WHERE n.node_type = 'docker_container') AS docker,
                    count(*) FILTER (WHERE n.node_type = 'remote_machine') AS remote
             FROM {v_cluster} c LEFT JOIN {v_secondary} n ON n.cluster_id = c.cluster_id
             GROUP BY ALL),
         plan AS (SELECT *, CASE WHEN target > remote THEN target - remote ELSE 0 END AS docker_target
                  FROM counts)"""


def targets(f: Fleet) -> DataFrame:
    return f.v_cluster.select("cluster_id", "target", *ops.OF_CLUSTER)


@query(
    "pl1_scale_plan",
    f"""WITH {PLAN}
        SELECT cluster_id, target, secondaries AS previous_count, docker_target,
               greatest(docker_target - docker, 0) AS add_count,
               greatest(docker - docker_target, 0) AS remove_count,
               remote + docker_target AS current_count,
               CASE WHEN docker = docker_target THEN concat('Already have ', docker, ' Docker nodes')
                    ELSE concat('Scaled to ', docker_target, ' Docker nodes') END AS message
        FROM plan""",
)
def scale_plan(f: Fleet) -> DataFrame:
    return ops.scale_plan(targets(f), f.v_node).select(
        "cluster_id", "target", "previous_count", "docker_target", "add_count", "remove_count",
        "current_count", "message",
    )


@query(
    "pl1_scale_plan_rows",
    f"""WITH {PLAN},
        added AS (SELECT cluster_id, CAST(secondaries + 2 + unnest(range(docker_target - docker)) AS INT)
                           AS node_id
                  FROM plan WHERE docker_target > docker),
        removed AS (SELECT n.cluster_id, n.node_id, n.pos,
                           row_number() OVER (PARTITION BY n.cluster_id ORDER BY n.pos DESC) AS rn
                    FROM {{v_secondary}} n WHERE n.node_type = 'docker_container')
        SELECT cluster_id, node_id, 'add' AS change FROM added
        UNION ALL
        SELECT r.cluster_id, r.node_id, 'remove' FROM removed r JOIN plan p
               ON p.cluster_id = r.cluster_id WHERE r.rn <= p.docker - p.docker_target""",
)
def scale_plan_rows(f: Fleet) -> DataFrame:
    plan = ops.scale_plan(targets(f), f.v_node)
    added = ops.plan_additions(plan).select("cluster_id", "node_id", F.lit("add").alias("change"))
    removed = ops.plan_removals(plan, f.v_node)
    return added.unionByName(
        removed.select("cluster_id", "node_id", F.lit("remove").alias("change"))
    )


@query(
    "st2_apply_scale_plan",
    f"""WITH {PLAN},
        ranked AS (SELECT n.*, row_number() OVER (PARTITION BY n.cluster_id, n.node_type
                                                  ORDER BY n.pos DESC) AS rn,
                   FROM {{v_secondary}} n),
        last AS (SELECT cluster_id, max(pos) AS pos FROM {{v_secondary}} GROUP BY cluster_id),
        added AS (SELECT plan.*, unnest(range(docker_target - docker)) AS slot
                  FROM plan WHERE docker_target > docker)
        SELECT r.* EXCLUDE (rn) REPLACE (CAST(r.pos AS BIGINT) AS pos) FROM ranked r JOIN plan p ON p.cluster_id = r.cluster_id
        WHERE r.node_type <> 'docker_container' OR r.rn > p.docker - p.docker_target
        UNION ALL
        SELECT a.cluster_id, coalesce(l.pos, 0) + a.slot + 1, CAST(a.secondaries + 2 + a.slot AS INT),
               concat('mysql-secondary-', a.secondaries + 1 + a.slot), 'secondary',
               'docker_container', '127.0.0.1', CAST(33062 + a.secondaries + a.slot AS INT),
               NULL, NULL, 22, concat('mysql-secondary-', a.secondaries + 1 + a.slot),
               a.docker_network, concat(a.docker_base_ip, '.', 12 + a.secondaries + a.slot),
               CAST(a.secondaries + 2 + a.slot AS INT), NULL, NULL, NULL, NULL, a.credential_hash, NULL
        FROM added a LEFT JOIN last l ON l.cluster_id = a.cluster_id""",
)
def apply_scale_plan(f: Fleet) -> DataFrame:
    plan = ops.scale_plan(targets(f), f.v_node)
    return ops.apply_scale_plan(plan, f.v_node).withColumn("pos", F.col("pos").cast(LONG))
