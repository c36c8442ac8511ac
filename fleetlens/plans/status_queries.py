"""Status union, listing, rollups, latest rows, plugin availability and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.functions import scalars as sc
from fleetlens.operators import status as ops
from fleetlens.plans.registry import query
from fleetlens.plans.views import Fleet
from fleetlens.sources.export import status_tree

UNION = """u AS (
      SELECT cluster_id, pos, node_id, 'primary' AS kind, hostname AS name, port, reachable,
             running AS up_flag FROM {v_status_p}
      UNION ALL
      SELECT cluster_id, pos, node_id, 'docker', container_name, host_port, reachable, running
      FROM {v_status_d}
      UNION ALL
      SELECT cluster_id, pos, node_id, 'remote', host, NULL, reachable, mysql_running
      FROM {v_status_r})"""


def union(f: Fleet) -> DataFrame:
    return ops.status_union(f.v_status_p, f.v_status_d, f.v_status_r)


@query(
    "st1_status_union",
    f"""WITH {UNION}
        SELECT cluster_id, pos, node_id, kind, name, port, reachable,
               coalesce(up_flag, FALSE) AS up FROM u""",
)
def status_union(f: Fleet) -> DataFrame:
    return union(f).select(
        "cluster_id", "pos", "node_id", "kind",
        F.coalesce("hostname", "container_name", "host").alias("name"),
        F.coalesce("port", "host_port").alias("port"), "reachable", "up",
    )


@query(
    "so1_status_listing",
    f"""WITH {UNION}
        SELECT cluster_id, pos, node_id, kind,
               CAST(CASE kind WHEN 'primary' THEN 0 WHEN 'docker' THEN 1 ELSE 2 END AS INT)
                 AS kind_rank,
               CASE WHEN up_flag THEN '✓' ELSE '✗' END AS running_glyph,
               CASE WHEN reachable THEN '✓' ELSE '✗' END AS reachable_glyph
        FROM u ORDER BY cluster_id, kind_rank, pos""",
)
def status_listing(f: Fleet) -> DataFrame:
    return ops.status_listing(union(f)).select(
        "cluster_id", "pos", "node_id", "kind", "kind_rank",
        sc.status_glyph(F.col("up")).alias("running_glyph"),
        sc.status_glyph(F.col("reachable")).alias("reachable_glyph"),
    )


@query(
    "ag7_status_rollup",
    f"""WITH {UNION}
        SELECT cluster_id, kind, count(*) AS total, count(*) FILTER (WHERE up_flag) AS running,
               count(*) FILTER (WHERE reachable) AS reachable
        FROM u GROUP BY cluster_id, kind""",
)
def status_rollup(f: Fleet) -> DataFrame:
    return ops.status_rollup(union(f))


LATEST = """SELECT node_id, ts, seq, ok, value FROM
         (SELECT p.*, row_number() OVER (PARTITION BY node_id ORDER BY ts DESC, seq DESC) AS rn
          FROM {v_probe} p) WHERE rn = 1"""


@query("wn4_latest_status", LATEST)
def latest_status(f: Fleet) -> DataFrame:
    return ops.latest_status(f.v_probe).select("node_id", "ts", "seq", "ok", "value")


@query(
    "prj4_reachable_connections",
    """SELECT cluster_id, node_id, role, host, port, 'root' AS user FROM {v_node}
       WHERE role = 'primary' OR reachable""",
)
def reachable_connections(f: Fleet) -> DataFrame:
    return ops.reachable_connections(f.v_node)


@query(
    "prj11_plugin_rows",
    """SELECT cluster_id, node_id, plugin_name, plugin_status FROM {v_plugin}
       WHERE plugin_name IN ('economy', 'ECONOMY')""",
)
def plugin_rows(f: Fleet) -> DataFrame:
    return ops.plugin_rows(f.v_plugin, "Economy")


@query(
    "prj14_gate_remote_probe",
    """SELECT command_id, coalesce(ssh_user, '') <> '' AND ok AS ssh_accessible,
              coalesce(ssh_user, '') <> '' AND ok AND coalesce(output LIKE '%active%', FALSE)
                AS mysql_running,
              CASE WHEN coalesce(ssh_user, '') <> '' AND ok AND units <> ''
                   THEN concat('mysql  Ver 8.0.', regexp_extract(version, '8\\.0\\.([0-9]+)', 1)) END
                AS mysql_version
       FROM {v_command}""",
)
def gate_remote_probe(f: Fleet) -> DataFrame:
    gated = ops.gate_remote_probe(
        F.col("ssh_user"),
        F.col("ok"),
        sc.service_active_loose(F.col("output"), F.col("ok")),
        F.col("units") != "",
        sc.clean_version(F.col("version"), F.col("ok")),
    )
    return f.v_command.select("command_id", *[column.alias(name) for name, column in gated.items()])


@query(
    "jn2_availability",
    """SELECT n.cluster_id, n.pos, n.node_id,
              (n.role = 'primary' OR n.reachable) AND c.error IS NULL AND coalesce(c.found, FALSE)
                AS available,
              CASE WHEN n.role = 'primary' AND c.found AND c.error IS NULL
                   THEN 'Engine plugin is available'
                   WHEN n.role = 'primary' THEN 'Engine plugin is not installed'
                   WHEN NOT n.reachable THEN 'Node not reachable'
                   WHEN c.error IS NOT NULL THEN c.error WHEN c.found THEN 'Engine available'
                   ELSE 'Engine not installed' END AS message
       FROM {v_node} n LEFT JOIN {v_check} c ON c.cluster_id = n.cluster_id AND c.pos = n.pos""",
)
def availability(f: Fleet) -> DataFrame:
    return ops.availability(f.v_node, f.v_check, "Engine")


@query(
    "jn7_program_path",
    """SELECT command_id,
              CASE WHEN ssh_user <> '' THEN ssh_user WHEN units <> '' THEN concat(units, '/mysqld')
                   WHEN output <> '' THEN output ELSE '/usr/sbin/mysqld' END AS path
       FROM {v_command}""",
)
def program_path(f: Fleet) -> DataFrame:
    path = ops.program_path(
        F.col("ssh_user"), F.col("units"), F.col("output"), "mysqld", "/usr/sbin/mysqld"
    )
    return f.v_command.select("command_id", path.alias("path"))


@query(
    "src6_status_export",
    """WITH p AS (
         SELECT cluster_id, to_json(struct_pack(node_id := node_id, hostname := hostname, host := host,
                    port := port, node_type := node_type, running := running,
                    reachable := reachable))::VARCHAR AS node, running
         FROM {v_status_p}),
       d AS (
         SELECT cluster_id, count(*) AS n, string_agg(to_json(struct_pack(node_id := node_id,
                    container_name := container_name, docker_ip := docker_ip,
                    host_port := host_port, running := running,
                    reachable := reachable))::VARCHAR, ',' ORDER BY pos) AS nodes
         FROM {v_status_d} GROUP BY cluster_id),
       r AS (
         SELECT cluster_id, count(*) AS n, string_agg(to_json(struct_pack(node_id := node_id,
                    host := host, reachable := reachable, ssh_accessible := ssh_accessible,
                    mysql_running := mysql_running,
                    mysql_version := mysql_version))::VARCHAR, ',' ORDER BY pos) AS nodes
         FROM {v_status_r} GROUP BY cluster_id)
       SELECT c.cluster_id, concat('{{"cluster_name":"', c.cluster_name, '","primary":',
                coalesce(p.node, 'null'), ',"secondaries":{{"docker":[', coalesce(d.nodes, ''),
                '],"remote":[', coalesce(r.nodes, ''), '],"total_nodes":',
                coalesce(d.n, 0) + coalesce(r.n, 0), '}},"cluster":',
                CASE WHEN p.running AND c.cluster_id % 3 = 0
                     THEN concat('"no json ', c.cluster_id, '"')
                     WHEN p.running THEN concat('{{"members":', c.cluster_id, '}}')
                     ELSE 'null' END, '}}') AS status_json
       FROM {v_cluster} c LEFT JOIN p ON p.cluster_id = c.cluster_id
            LEFT JOIN d ON d.cluster_id = c.cluster_id LEFT JOIN r ON r.cluster_id = c.cluster_id""",
)
def export_status(f: Fleet) -> DataFrame:
    told = F.when(
        F.col("cluster_id") % 3 == 0, F.concat(F.lit("no json "), F.col("cluster_id"))
    ).otherwise(F.concat(F.lit('{"members": '), F.col("cluster_id"), F.lit("}")))
    clusters = f.v_cluster.select("cluster_id", "cluster_name", told.alias("cluster_output"))
    return status_tree(clusters, union(f))


@query(
    "sc1_classify_output",
    """SELECT command_id,
              CASE WHEN message LIKE '%already configured%' THEN 'already_done'
                   WHEN ok THEN 'ok' ELSE 'failed' END AS configured,
              CASE WHEN message LIKE '%is already part%' THEN 'already_done'
                   WHEN ok THEN 'ok' ELSE 'failed' END AS added,
              CASE WHEN message LIKE '%does not exist%' THEN 'not_found'
                   WHEN ok THEN 'ok' ELSE 'failed' END AS created,
              CASE WHEN NOT ok AND message ILIKE '%already exists%' THEN 'already_done'
                   WHEN ok THEN 'ok' ELSE 'failed' END AS installed
       FROM {v_command}""",
)
def classify_output(f: Fleet) -> DataFrame:
    rules = {
        "configured": fv.CONFIGURE_RULES,
        "added": fv.ADD_RULES,
        "created": fv.CREATE_RULES,
        "installed": fv.INSTALL_RULES,
    }
    return f.v_command.select(
        "command_id",
        *[
            sc.classify_output(F.col("message"), F.col("ok"), rule).alias(name)
            for name, rule in rules.items()
        ],
    )


@query(
    "sc1_classify_documents",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'licensed'
                           WHEN contains(text, 'the ') THEN 'english'
                           WHEN n_chars > 500 THEN 'ok' ELSE 'failed' END AS outcome
       FROM {documents}""",
)
def classify_documents(f: Fleet) -> DataFrame:
    rules = [("licensed", ["LICENSE"], True, False), ("english", ["the "], False, False)]
    outcome = sc.classify_output(F.col("text"), F.col("n_chars") > 500, rules)
    return f.documents.select("doc_id", outcome.alias("outcome"))


@query(
    "sc2_has_plugin",
    """SELECT doc_id, contains(lower(text), 'license') AS mentioned,
              contains(lower(text), 'license') AND n_chars > 500 AS mentioned_and_ok
       FROM {documents}""",
)
def has_plugin(f: Fleet) -> DataFrame:
    return f.documents.select(
        "doc_id",
        sc.has_plugin(F.col("text"), "License").alias("mentioned"),
        sc.has_plugin(F.col("text"), "License", F.col("n_chars") > 500).alias("mentioned_and_ok"),
    )


@query(
    "sc3_kv_last_token",
    rf"""SELECT doc_id, coalesce(list_filter(list_transform(
              list_filter(string_split(text, chr(10)), lambda line: contains(lower(line), 'the')),
              lambda line: string_split_regex(trim(line, '{fv.WHITESPACE}'), '{fv.WHITESPACE_CLASS.replace("{", "{{").replace("}", "}}")}+')),
              lambda tokens: len(tokens) >= 2)[1][-1], 'none') AS token
         FROM {{documents}}""",
)
def kv_last_token(f: Fleet) -> DataFrame:
    return f.documents.select("doc_id", sc.kv_last_token(F.col("text"), "The", "none").alias("token"))


@query(
    "sc4_service_state",
    """SELECT command_id,
              coalesce(replace(replace(output, chr(10), ''), ' ', '') = 'active', FALSE) AS strict,
              ok AND coalesce(contains(output, 'active'), FALSE) AS loose,
              coalesce(output = 'true', FALSE) AS container,
              CASE WHEN contains(units, 'mysql.service') THEN 'mysql' ELSE 'mysqld' END AS service
       FROM {v_command}""",
)
def service_state(f: Fleet) -> DataFrame:
    output = F.col("output")
    return f.v_command.select(
        "command_id",
        sc.service_active(output).alias("strict"),
        sc.service_active_loose(output, F.col("ok")).alias("loose"),
        sc.container_running(output).alias("container"),
        sc.service_name(F.col("units")).alias("service"),
    )


@query(
    "sc5_size_mb",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              round_even(l_orderkey * 131072 / 1048576, 2) AS size_mb
       FROM {lineitem}""",
)
def size_mb(f: Fleet) -> DataFrame:
    return f.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        sc.size_mb(F.col("l_orderkey") * 131072).alias("size_mb"),
    )


@query(
    "sc6_json_or_raw",
    """SELECT event_id, available AND json_valid(text) AS is_json,
              CASE WHEN available AND json_valid(text)
                   THEN CAST(CASE WHEN json_valid(text) THEN text END ->> '$.k' AS INT) END AS k,
              CASE WHEN available AND NOT json_valid(text) THEN text END AS raw
       FROM {v_json}""",
)
def json_or_raw(f: Fleet) -> DataFrame:
    split = f.v_json.select(
        "event_id", sc.json_or_raw(F.col("text"), F.col("available")).alias("s")
    )
    return split.select(
        "event_id",
        F.col("s.parsed").isNotNull().alias("is_json"),
        F.try_variant_get("s.parsed", "$.k", "int").alias("k"),
        F.col("s.raw").alias("raw"),
    )


@query(
    "sc7_truthy_coalesce",
    """SELECT request_id,
              CASE WHEN host <> '' THEN host WHEN ssh_user <> '' THEN ssh_user
                   ELSE ssh_key_path END AS first_text,
              CASE WHEN pos = 0 THEN node_id ELSE pos END AS first_number
       FROM {v_request}""",
)
def truthy_coalesce(f: Fleet) -> DataFrame:
    return f.v_request.select(
        "request_id",
        sc.truthy_coalesce(F.col("host"), F.col("ssh_user"), F.col("ssh_key_path")).alias(
            "first_text"
        ),
        sc.truthy_coalesce(F.col("pos"), F.col("node_id"), empty=0).alias("first_number"),
    )


@query(
    "sc10_status_glyph",
    """SELECT cluster_id, pos, kind, CASE WHEN up THEN '✓' ELSE '✗' END AS glyph
       FROM (SELECT cluster_id, pos, 'primary' AS kind, running AS up FROM {v_status_p}
             UNION ALL SELECT cluster_id, pos, 'docker', running FROM {v_status_d}
             UNION ALL SELECT cluster_id, pos, 'remote', mysql_running FROM {v_status_r})""",
)
def status_glyph(f: Fleet) -> DataFrame:
    return union(f).select(
        "cluster_id", "pos", "kind", sc.status_glyph(F.col("up")).alias("glyph")
    )


@query(
    "sc11_clean_version",
    rf"""SELECT command_id, CASE WHEN ok THEN trim(version, '{fv.WHITESPACE}') END AS version
         FROM {{v_command}}""",
)
def clean_version(f: Fleet) -> DataFrame:
    return f.v_command.select(
        "command_id", sc.clean_version(F.col("version"), F.col("ok")).alias("version")
    )
