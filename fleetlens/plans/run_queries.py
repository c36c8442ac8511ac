"""Runs, steps, probes, audits, sources and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.functions import scalars as sc
from fleetlens.operators import audit, changes, probes, runs
from fleetlens.operators.nodes import node_defaults
from fleetlens.plans.registry import query
from fleetlens.plans.views import Fleet
from fleetlens.session import work_folder
from fleetlens.sources import documents, hosts, logs, settings

SALT = "salt"
NETWORK = "cluster-net"
ENGINE = "engine"


@query(
    "ag3_setup_rollup",
    """SELECT run_id,
              coalesce(bool_and(coalesce(success, FALSE)) FILTER (WHERE setup_name <> 'save_config'),
                       TRUE) AS success,
              count(*) AS step_count,
              count(*) FILTER (WHERE NOT coalesce(success, FALSE)) AS failed_steps
       FROM {v_step} GROUP BY run_id""",
)
def setup_rollup(f: Fleet) -> DataFrame:
    return runs.setup_rollup(f.v_step.withColumnRenamed("setup_name", "name"))


@query(
    "ag3_setup_rollup_strict",
    """SELECT run_id, bool_and(coalesce(success, FALSE)) AS success, count(*) AS step_count,
              count(*) FILTER (WHERE NOT coalesce(success, FALSE)) AS failed_steps
       FROM {v_step} GROUP BY run_id""",
)
def strict_setup_rollup(f: Fleet) -> DataFrame:
    return runs.setup_rollup(f.v_step.withColumnRenamed("setup_name", "name"), strict=True)


@query(
    "ag4_replication_rollup",
    """SELECT run_id,
              coalesce(bool_and(coalesce(success, FALSE)) FILTER
                       (WHERE replication_name IN ('configure_primary', 'create_cluster')), TRUE)
                AS success,
              count(*) FILTER (WHERE NOT coalesce(success, FALSE)) AS failed_steps,
              count(*) FILTER (WHERE NOT coalesce(success, FALSE) AND replication_name LIKE 'add%')
                AS failed_secondary_steps
       FROM {v_step} GROUP BY run_id""",
)
def replication_rollup(f: Fleet) -> DataFrame:
    return runs.replication_rollup(f.v_step.withColumnRenamed("replication_name", "name"))


@query(
    "ag5_start_rollup",
    """WITH t AS (SELECT run_id,
                coalesce(bool_and(coalesce(success, FALSE)) FILTER (WHERE part = 'primary'), FALSE) AS p,
                coalesce(bool_and(coalesce(success, FALSE)) FILTER (WHERE part = 'docker'), TRUE) AS d,
                coalesce(bool_and(coalesce(success, FALSE)) FILTER (WHERE part = 'remote'), TRUE) AS r,
                bool_and(coalesce(success, FALSE)) FILTER (WHERE part = 'replication') AS g,
                count(*) FILTER (WHERE part = 'remote' AND NOT coalesce(success, FALSE)) AS fr
              FROM {v_step} GROUP BY run_id)
       SELECT run_id, p AND d AND r AND coalesce(g, TRUE) AS success, p AS primary_success,
              CASE WHEN p THEN d END AS docker_success, CASE WHEN p THEN r END AS remote_success,
              CASE WHEN p THEN fr END AS failed_remote, CASE WHEN p THEN g END AS replication_success
       FROM t""",
)
def start_rollup(f: Fleet) -> DataFrame:
    return runs.start_rollup(f.v_step)


@query(
    "ag5_stop_rollup",
    """SELECT run_id,
              coalesce(bool_and(coalesce(success, FALSE)) FILTER (WHERE part = 'primary'), TRUE)
                AS success,
              count(*) FILTER (WHERE NOT coalesce(success, FALSE)) AS failed_parts
       FROM {v_step} GROUP BY run_id""",
)
def stop_rollup(f: Fleet) -> DataFrame:
    return runs.stop_rollup(f.v_step)


@query(
    "ag6_install_summary",
    """WITH t AS (SELECT n.cluster_id,
                         coalesce(bool_and(i.success) FILTER (WHERE i.pos IS NOT NULL), TRUE) AS success,
                         count(*) FILTER (WHERE i.success) AS installed,
                         1 + count(*) FILTER (WHERE n.role = 'secondary') AS total
                  FROM {v_node} n LEFT JOIN {v_install} i
                       ON i.cluster_id = n.cluster_id AND i.pos = n.pos
                  GROUP BY n.cluster_id)
       SELECT *, concat('Installed on ', installed, '/', total, ' nodes') AS summary FROM t""",
)
def install_summary(f: Fleet) -> DataFrame:
    return runs.install_summary(f.v_node, f.v_install)


@query(
    "prj12_failed_steps",
    """SELECT run_id, seq, concat(setup_name, ': ', coalesce(error, 'Unknown error')) AS line
       FROM {v_step} WHERE success IS NULL OR NOT success
       UNION ALL
       SELECT run_id, seq, concat(CASE part WHEN 'primary' THEN 'Primary' WHEN 'docker' THEN 'Docker'
                                  ELSE concat('Remote ', host) END, ': ', coalesce(error, 'none'))
       FROM {v_step} WHERE part <> 'replication' AND (success IS NULL OR NOT success)""",
)
def failed_steps(f: Fleet) -> DataFrame:
    steps = runs.failed_steps(f.v_step.withColumnRenamed("setup_name", "name"))
    parts = f.v_step.withColumn("message", F.coalesce("error", F.lit("none")))
    columns = ["run_id", "seq", "line"]
    return steps.select(columns).unionByName(runs.failed_parts(parts).select(columns))


@query(
    "jn6_timeout_budget",
    """SELECT seq, kind, budget_seconds,
              CASE WHEN budget_seconds IS NULL THEN 'no_budget'
                   WHEN duration_seconds > budget_seconds THEN 'timed_out' ELSE 'within' END AS verdict
       FROM (SELECT *, CAST(CASE kind WHEN 'tcp_probe' THEN 5 WHEN 'sql_statement' THEN 30
                            WHEN 'service_restart' THEN 120 WHEN 'add_to_group' THEN 300 END AS INT)
                        AS budget_seconds
             FROM {v_step})""",
)
def timeout_budget(f: Fleet) -> DataFrame:
    return runs.timeout_budget(f.v_step).select("seq", "kind", "budget_seconds", "verdict")


@query(
    "jn7_resolve_candidate",
    """WITH d(i, directory) AS (VALUES (0, 'build'), (1, 'build/Release'), (2, 'build/Debug'),
              (3, 'plugins'), (4, '/usr/lib/mysql/plugin'), (5, '/usr/lib64/mysql/plugin'),
              (6, '/usr/local/mysql/lib/plugin')),
         n(j, file_name) AS (VALUES (0, 'ha_engine.so'), (1, 'ha_engine_storage_engine.so')),
         c AS (SELECT CAST(i * 2 + j AS INT) AS candidate_rank,
                      concat(directory, '/', file_name) AS path
               FROM d, n),
         first AS (SELECT group_id, min(candidate_rank) AS candidate_rank FROM {v_candidate}
                   WHERE found GROUP BY group_id)
       SELECT g.group_id, CASE WHEN c.path LIKE '/%' THEN c.path
                               ELSE '/srv/g' || g.group_id || '/' || c.path END AS path,
              c.candidate_rank,
              CASE WHEN c.path IS NULL THEN 'no candidate exists' END AS reason
       FROM (SELECT DISTINCT group_id FROM {v_candidate}) g
            LEFT JOIN first USING (group_id) LEFT JOIN c USING (candidate_rank)""",
)
def resolve_candidate(f: Fleet) -> DataFrame:
    candidates = runs.plugin_candidates(ENGINE)
    pairs = F.array(
        *[
            (F.lit(f"{d}/{n}") if d.startswith("/") else F.concat(F.col("_home"), F.lit(f"/{d}/{n}")))
            for d, n in candidates
        ]
    )
    home = F.concat(F.lit("/srv/g"), F.col("group_id"))
    existing = f.v_candidate.filter("found").withColumn("_home", home).select(
        "group_id", F.element_at(pairs, F.col("candidate_rank") + 1).alias("path")
    )
    groups = f.v_candidate.select(
        "group_id", F.concat(home, F.lit("/cluster")).alias("base_dir")
    ).distinct()
    return runs.resolve_candidate(groups, existing, candidates)


@query(
    "jn8_remote_host_outcome",
    """WITH t AS (SELECT *, CASE WHEN NOT reachable THEN concat('Cannot reach ', host)
              WHEN coalesce(NOT running, TRUE) AND NOT start_ok
              THEN concat('Cannot start MySQL on ', host, ': ', start_message)
              WHEN NOT configure_ok
              THEN concat('Cannot configure MySQL on ', host, ': ', configure_message)
              WHEN coalesce(NOT join_ok, TRUE)
              THEN concat('Cannot add ', host, ' to cluster: ', join_message) END AS stop
              FROM {v_attempt})
       SELECT attempt_id, stop IS NULL AS success,
              coalesce(stop, concat('Successfully added ', host, ' as secondary node')) AS message
       FROM t""",
)
def remote_host_outcome(f: Fleet) -> DataFrame:
    return runs.remote_host_outcome(f.v_attempt).select("attempt_id", "success", "message")


@query(
    "sc9_result_message",
    """SELECT seq, concat('Started ', seq, ' Docker containers') AS started,
              concat('Scaled from ', seq, ' to ', seq + 1, ' nodes') AS scaled,
              concat('Removed node ', seq) AS removed
       FROM {v_step}""",
)
def result_message(f: Fleet) -> DataFrame:
    seq = F.col("seq")
    return f.v_step.select(
        "seq",
        sc.result_message("containers_started", seq).alias("started"),
        sc.result_message("cluster_scaled", seq, seq + 1).alias("scaled"),
        sc.result_message("node_removed", seq).alias("removed"),
    )


POLLS = 3
HORIZON = 10 * 24 * 3600

READINESS = """
    WITH seen AS (
        SELECT s.node_id, s.start_id, s.ts, p.ts AS poll_ts, p.ok,
               row_number() OVER (PARTITION BY s.start_id ORDER BY p.ts, p.seq) AS rn
        FROM {v_start} s LEFT JOIN {v_poll} p
             ON p.node_id = s.node_id AND p.ts > s.ts AND p.ts <= s.ts + INTERVAL 10 DAY),
    first AS (
        SELECT start_id, min(poll_ts) AS ready_ts, min(rn) AS polls_used
        FROM seen WHERE ok AND rn <= 3 GROUP BY start_id)
    SELECT s.node_id, s.start_id, s.ts, f.start_id IS NOT NULL AS ready, f.ready_ts, f.polls_used,
           CASE WHEN f.start_id IS NULL THEN 'MySQL started but not responding'
                ELSE 'MySQL started successfully' END AS message
    FROM {v_start} s LEFT JOIN first f ON f.start_id = s.start_id"""


@query("jn3_readiness", READINESS)
def readiness(f: Fleet) -> DataFrame:
    settled = probes.readiness(f.v_start, f.v_poll, POLLS, HORIZON)
    return settled.drop("polls_after")


@query(
    "jn3_stopped",
    READINESS.replace("WHERE ok AND rn", "WHERE NOT ok AND rn")
    .replace("MySQL started but not responding", "MySQL still running after stop command")
    .replace("MySQL started successfully", "MySQL stopped successfully"),
)
def stopped(f: Fleet) -> DataFrame:
    settled = probes.readiness(f.v_start, f.v_poll, POLLS, HORIZON, action="stop")
    return settled.drop("polls_after")


STREAKS = """
    WITH marked AS (
        SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END)
                    OVER (PARTITION BY node_id ORDER BY ts, seq) AS oks
        FROM {v_probe}),
    fails AS (
        SELECT *, row_number() OVER (PARTITION BY node_id, oks ORDER BY ts, seq) AS rn
        FROM marked WHERE NOT ok)
    SELECT f.node_id, min(f.ts) AS start_ts, count(*) AS length,
           max(f.ts) FILTER (WHERE rn = 5) AS unhealthy_ts, any_value(o.ts) AS recovery_ts
    FROM fails f LEFT JOIN marked o ON o.ok AND o.node_id = f.node_id AND o.oks = f.oks + 1
    GROUP BY f.node_id, f.oks HAVING count(*) >= 5"""

CHANGES = """
    WITH marked AS (
        SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END)
                    OVER (PARTITION BY node_id ORDER BY ts, seq), 0) AS oks
        FROM {v_probe}),
    streaked AS (
        SELECT *, CASE WHEN ok THEN 0 ELSE sum(CASE WHEN ok THEN 0 ELSE 1 END)
                    OVER (PARTITION BY node_id, oks ORDER BY ts, seq) END AS streak
        FROM marked),
    stated AS (
        SELECT *, CASE WHEN streak >= 5 THEN 'unhealthy' WHEN oks > 0 THEN 'healthy'
                       ELSE 'starting' END AS to_status
        FROM streaked),
    stepped AS (
        SELECT *, lag(to_status, 1, 'starting') OVER (PARTITION BY node_id ORDER BY ts, seq)
                    AS from_status
        FROM stated)
    SELECT node_id, ts, seq, from_status, to_status FROM stepped WHERE from_status <> to_status"""


@query("wn3_unhealthy_streaks", STREAKS)
def unhealthy_streaks(f: Fleet) -> DataFrame:
    return probes.unhealthy_streaks(f.v_probe)


@query("wn3_health_changes", CHANGES)
def health_changes(f: Fleet) -> DataFrame:
    return probes.health_changes(f.v_probe)


@query(
    "ag8_identity_audit",
    """WITH v AS (
         SELECT cluster_id, pos, 'node_id' AS field, CAST(node_id AS VARCHAR) AS value FROM {v_node}
         UNION ALL
         SELECT cluster_id, pos, 'server_id', CAST(CASE WHEN server_id IS NULL OR server_id = 0
                THEN node_id ELSE server_id END AS VARCHAR) FROM {v_node}
         UNION ALL
         SELECT cluster_id, pos, 'endpoint', concat(host, ':', port) FROM {v_node}
         UNION ALL
         SELECT cluster_id, pos, 'docker_ip', docker_ip FROM {v_node}
         UNION ALL
         SELECT cluster_id, pos, 'container_name', container_name FROM {v_node})
       SELECT 'duplicate' AS finding, cluster_id, field, value, count(*) AS n,
              min(pos) AS first_pos, max(pos) AS last_pos
       FROM v WHERE value IS NOT NULL GROUP BY cluster_id, field, value HAVING count(*) > 1
       UNION ALL
       SELECT 'octet_overflow', cluster_id, 'docker_ip', docker_ip, 1, pos, pos FROM {v_node}
       WHERE docker_ip IS NOT NULL AND node_id >= 246
       UNION ALL
       SELECT 'credential_differs', n.cluster_id, 'credential', NULL, 1, n.pos, n.pos
       FROM {v_node} n JOIN {v_cluster} c ON c.cluster_id = n.cluster_id
       WHERE n.credential_hash IS DISTINCT FROM c.credential_hash""",
)
def identity_audit(f: Fleet) -> DataFrame:
    return audit.identity_audit(f.v_node, f.v_cluster)


@query(
    "ag8_duplicate_members",
    """WITH v AS (
         SELECT cluster_id, pos, 'node_id' AS field, CAST(node_id AS VARCHAR) AS value FROM {v_node}
         UNION ALL
         SELECT cluster_id, pos, 'server_id', CAST(CASE WHEN server_id IS NULL OR server_id = 0
                THEN node_id ELSE server_id END AS VARCHAR) FROM {v_node}
         UNION ALL
         SELECT cluster_id, pos, 'endpoint', concat(host, ':', port) FROM {v_node}
         UNION ALL
         SELECT cluster_id, pos, 'docker_ip', docker_ip FROM {v_node}
         UNION ALL
         SELECT cluster_id, pos, 'container_name', container_name FROM {v_node})
       SELECT cluster_id, pos, field, value FROM v WHERE value IS NOT NULL
       QUALIFY count(*) OVER (PARTITION BY cluster_id, field, value) > 1""",
)
def duplicate_members(f: Fleet) -> DataFrame:
    return audit.duplicate_members(f.v_node)


@query(
    "prj13_expected_settings",
    """WITH shared(key, value) AS (VALUES ('bind-address', '0.0.0.0'), ('log-bin', 'mysql-bin'),
              ('binlog-format', 'ROW'), ('gtid-mode', 'ON'), ('enforce-gtid-consistency', 'ON'),
              ('relay-log', 'mysql-relay-bin'), ('relay-log-recovery', '1'),
              ('default-storage-engine', 'InnoDB'), ('innodb_buffer_pool_size', '1G'),
              ('innodb_log_file_size', '256M'), ('max_connections', '200'),
              ('max_allowed_packet', '256M')),
         flag(key, value) AS (SELECT * FROM shared WHERE key IN ('log-bin', 'gtid-mode',
              'enforce-gtid-consistency', 'binlog-format', 'relay-log')),
         n AS (SELECT *, CAST(CASE WHEN role = 'secondary' AND coalesce(server_id, 0) = 0
                                   THEN node_id ELSE server_id END AS VARCHAR) AS sid
               FROM {v_node})
       SELECT cluster_id, pos, 'file' AS source, key, value FROM n, shared
       UNION ALL
       SELECT cluster_id, pos, 'file', 'server-id', sid FROM n
       UNION ALL
       SELECT cluster_id, pos, 'file', 'port', '3306' FROM n
       UNION ALL
       SELECT cluster_id, pos, 'command_line', key, value FROM n, flag
       WHERE node_type = 'docker_container'
       UNION ALL
       SELECT cluster_id, pos, 'command_line', 'server-id', sid FROM n
       WHERE node_type = 'docker_container'""",
)
def expected_settings(f: Fleet) -> DataFrame:
    return audit.expected_settings(f.v_node)


@query(
    "jn4_settings_drift",
    """WITH o AS (SELECT node, replace(key, '_', '-') AS key, value, TRUE AS seen FROM {v_observed}),
            e AS (SELECT *, TRUE AS seen FROM {v_expected})
       SELECT coalesce(e.node, o.node) AS node, coalesce(e.key, o.key) AS key,
              e.value AS expected, o.value AS observed,
              CASE WHEN o.seen IS NULL THEN 'missing' WHEN e.seen IS NULL THEN 'extra'
                   WHEN e.value IS NOT DISTINCT FROM o.value THEN 'ok' ELSE 'changed' END AS drift
       FROM e FULL JOIN o ON e.node = o.node AND e.key = o.key""",
)
def settings_drift(f: Fleet) -> DataFrame:
    return audit.settings_drift(f.v_expected, f.v_observed, "node")


@query(
    "jn4_settings_drift_of_files",
    """WITH shared(key, value) AS (VALUES ('bind-address', '0.0.0.0'), ('log-bin', 'mysql-bin'),
              ('binlog-format', 'ROW'), ('gtid-mode', 'ON'), ('enforce-gtid-consistency', 'ON'),
              ('relay-log', 'mysql-relay-bin'), ('relay-log-recovery', '1'),
              ('default-storage-engine', 'InnoDB'), ('innodb-buffer-pool-size', '1G'),
              ('innodb-log-file-size', '256M'), ('max-allowed-packet', '256M')),
         n AS (SELECT *, CAST(CASE WHEN coalesce(server_id, 0) = 0 THEN node_id ELSE server_id END
                              AS VARCHAR) AS sid FROM {v_node}),
         pairs AS (
           SELECT cluster_id, pos, key, value AS expected, NULL AS observed, 'missing' AS drift
           FROM n, shared
           UNION ALL
           SELECT cluster_id, pos, 'server-id', sid, CAST(node_id AS VARCHAR),
                  CASE WHEN sid = CAST(node_id AS VARCHAR) THEN 'ok' ELSE 'changed' END FROM n
           UNION ALL
           SELECT cluster_id, pos, 'port', '3306', CAST(port AS VARCHAR),
                  CASE WHEN port = 3306 THEN 'ok' ELSE 'changed' END FROM n
           UNION ALL
           SELECT cluster_id, pos, 'max-connections', '200', CAST(pos AS VARCHAR),
                  CASE WHEN pos = 200 THEN 'ok' ELSE 'changed' END FROM n
           UNION ALL
           SELECT cluster_id, pos, 'skip-name-resolve', NULL, NULL, 'extra' FROM n)
       SELECT * FROM pairs""",
)
def settings_drift_of_files(f: Fleet) -> DataFrame:
    expected = audit.expected_settings(f.v_node).filter("source = 'file'")
    observed = settings.parse_settings(f.v_settings_text, "cluster_id", "pos").filter(
        "section = 'mysqld'"
    )
    return audit.settings_drift(expected, observed, "cluster_id", "pos")


@query(
    "jn5_reconcile_members",
    """WITH w AS (SELECT DISTINCT * FROM {v_member_desired}),
            h AS (SELECT DISTINCT * FROM {v_member_actual})
       SELECT cluster_id, uri, CASE WHEN h.uri IS NULL THEN 'add' WHEN w.uri IS NULL THEN 'remove'
                                    ELSE 'keep' END AS action
       FROM w FULL JOIN h USING (cluster_id, uri)""",
)
def reconcile_members(f: Fleet) -> DataFrame:
    return audit.reconcile_members(f.v_member_desired, f.v_member_actual, "cluster_id", "uri")


DOC = """CASE WHEN s_nationkey = 7 THEN 'not a JSON object'
              WHEN s_nationkey = 8 THEN 'secondaries is not a list' END"""


# Keys that no document gives, so each has its default.
DEFAULTS = {
    k: v
    for k, v in fv.document_defaults(ENGINE, NETWORK).items()
    if k not in ("cluster_name", "mysql_version", "use_custom_image")
}
OTHER_KEYS = ", ".join(
    f"CASE WHEN s_nationkey <> 7 THEN '{DEFAULTS[k]}' END AS {k}"
    if k in DEFAULTS
    else f"CAST(NULL AS VARCHAR) AS {k}"
    for k in fv.DOCUMENT_KEYS
    if k not in ("cluster_name", "mysql_version", "use_custom_image")
)


@query(
    "src1_load_cluster_docs",
    f"""SELECT cluster_id,
               CASE WHEN s_nationkey <> 7 THEN s_name END AS cluster_name,
               CASE WHEN s_nationkey = 7 OR s_nationkey % 3 = 0 THEN NULL
                    WHEN s_nationkey % 3 = 1 THEN '8.0.43'
                    ELSE concat('8.4.', s_nationkey) END AS mysql_version,
               CASE WHEN s_nationkey <> 7 THEN s_nationkey % 2 = 1 END AS use_custom_image,
               {OTHER_KEYS},
               s_nationkey % 4 = 2 AND s_nationkey <> 7 AS has_primary,
               CAST(CASE WHEN s_nationkey > 12 THEN 2 ELSE 0 END AS INT) AS secondaries,
               {DOC} AS reject_reason
        FROM {{v_cluster_doc}}""",
)
def load_cluster_docs(f: Fleet) -> DataFrame:
    docs = documents.decode_documents(f.v_cluster_doc, ENGINE, SALT, NETWORK)
    broken = F.col("reject_reason") == "not a JSON object"
    return docs.select(
        "cluster_id",
        *[F.when(~F.coalesce(broken, F.lit(False)), F.col(c)).alias(c) for c in fv.DOCUMENT_KEYS],
        F.col("primary_json").isNotNull().alias("has_primary"),
        F.size("secondary_jsons").alias("secondaries"),
        "reject_reason",
    )


@query(
    "src2_decode_nodes",
    """WITH r AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'missing role'
                                 WHEN o_orderstatus = 'F' THEN 'invalid node_type'
                                 WHEN o_orderpriority = '2-HIGH' THEN 'unknown zone' END AS reason
                  FROM {v_node_doc})
       SELECT cluster_id, 1 AS pos, reason AS reject_reason,
              CASE WHEN reason IS NULL THEN concat('db', o_custkey) END AS hostname,
              CAST(CASE WHEN reason IS NOT NULL OR o_orderpriority = '3-MEDIUM' THEN NULL
                        WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 3306
                        ELSE o_custkey END AS INT) AS port,
              CASE WHEN reason IS NULL THEN 22 END AS ssh_port,
              CASE WHEN reason IS NULL THEN CAST(cluster_id AS INT) END AS server_id,
              CAST(NULL AS VARCHAR) AS container_name,
              CASE WHEN reason IS NULL THEN 'cluster-net' END AS docker_network
       FROM r""",
)
def decode_nodes(f: Fleet) -> DataFrame:
    docs = documents.decode_documents(f.v_node_doc, ENGINE, SALT, NETWORK)
    checked = node_defaults(documents.check_nodes(docs, SALT, NETWORK))
    good = F.col("reject_reason").isNull()
    return checked.select(
        "cluster_id", "pos", "reject_reason",
        *[
            F.when(good, F.col(c)).alias(c)
            for c in (
                "hostname", "port", "ssh_port", "server_id", "container_name", "docker_network"
            )
        ],
    )


@query(
    "src3_write_cluster_docs",
    """SELECT c.cluster_name, n.pos, n.node_id, n.hostname, n.role, n.node_type, n.host, n.port,
              n.ssh_user, coalesce(n.server_id, n.node_id) AS server_id, n.docker_ip, n.local_address,
              CASE WHEN n.container_name IS NULL AND n.node_type = 'docker_container'
                   THEN concat('mysql-node-', n.node_id) ELSE n.container_name END AS container_name
       FROM {v_node} n JOIN {v_cluster} c ON c.cluster_id = n.cluster_id""",
)
def write_cluster_docs(f: Fleet) -> DataFrame:
    folder = work_folder(f.spark, "documents")
    documents.write_cluster_docs(f.v_cluster, f.v_node, folder)
    docs = documents.load_cluster_docs(f.spark, folder, ENGINE, SALT, NETWORK, one_per_line=True)
    named = docs.withColumn("cluster_id", F.col("cluster_name"))
    good, _ = documents.decode_nodes(named, SALT, NETWORK)
    return good.withColumnRenamed("cluster_id", "cluster_name").select(
        "cluster_name", "pos", "node_id", "hostname", "role", "node_type", "host", "port",
        "ssh_user", "server_id", "docker_ip", "local_address", "container_name",
    )


@query(
    "src5_parse_remote_hosts",
    """SELECT spec_id, CASE WHEN contains(spec, ':') THEN split_part(spec, ':', 1) END AS host,
              nullif(split_part(spec, ':', 2), '') AS ssh_user,
              nullif(split_part(spec, ':', 3), '') AS ssh_key_path,
              CAST(CASE WHEN split_part(spec, ':', 4) <> '' THEN 1 ELSE 0 END AS INT) AS extra_parts,
              CASE WHEN NOT contains(spec, ':') THEN concat('Invalid remote host format: ', spec) END
                AS error
       FROM {v_host_spec}""",
)
def parse_remote_hosts(f: Fleet) -> DataFrame:
    return hosts.parse_remote_hosts(f.v_host_spec).drop("spec")


SETTINGS = """
    SELECT cluster_id, pos, 'mysqld' AS section, 'server-id' AS key,
           CAST(node_id AS VARCHAR) AS value FROM {v_settings_text}
    UNION ALL
    SELECT cluster_id, pos, 'mysqld', 'port', CAST(port AS VARCHAR) FROM {v_settings_text}
    UNION ALL
    SELECT cluster_id, pos, 'mysqld', 'max_connections', CAST(pos AS VARCHAR)
    FROM {v_settings_text}
    UNION ALL
    SELECT cluster_id, pos, 'mysqld', 'skip-name-resolve', NULL FROM {v_settings_text}
    UNION ALL
    SELECT cluster_id, pos, 'client', 'host', host FROM {v_settings_text}"""


@query("sc8_parse_settings", SETTINGS)
def parse_settings(f: Fleet) -> DataFrame:
    return settings.parse_settings(f.v_settings_text, "cluster_id", "pos")


@query(
    "src7_settings_source",
    f"""SELECT cluster_id, CASE WHEN pos = 0 THEN 'primary.cnf' ELSE concat('secondary', pos, '.cnf') END
                 AS file_name, section, key, value,
               CAST(pos + 1 AS INT) AS node_id
        FROM ({SETTINGS})""",
)
def settings_source(f: Fleet) -> DataFrame:
    return settings.settings_of_files(f.v_settings_text, "cluster_id").select(
        "cluster_id", "file_name", "section", "key", "value", "node_id"
    )


@query(
    "src8_parse_tool_logs",
    """SELECT event_id,
              CASE WHEN event_type <> 'purchase' THEN CAST(second AS TIMESTAMP) +
                   CASE event_type WHEN 'click' THEN INTERVAL 42 MILLISECOND
                        WHEN 'signup' THEN INTERVAL 999 MILLISECOND
                        ELSE INTERVAL 0 MILLISECOND END END AS ts,
              CASE event_type WHEN 'click' THEN 'fleet.node' WHEN 'signup' THEN 'fleet' END AS logger,
              CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'INFO'
                   WHEN 'click' THEN 'INFO' WHEN 'signup' THEN 'WARNING' END AS level,
              CASE event_type WHEN 'error' THEN concat('stop ', event_id)
                   WHEN 'view' THEN concat('start ', event_id)
                   WHEN 'click' THEN concat('ping - ', user_id)
                   WHEN 'signup' THEN concat('join ', user_id)
                   ELSE concat('stray text ', event_id) END AS message,
              event_type <> 'purchase' AS parsed
       FROM {v_log}""",
)
def parse_tool_logs(f: Fleet) -> DataFrame:
    return logs.parse_tool_logs(f.v_log.select("event_id", "line")).select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "logger", "level", "message",
        "parsed",
    )


@query("rp1_clone_snapshot", "SELECT * FROM {orders}")
def clone_snapshot(f: Fleet) -> DataFrame:
    return changes.clone_snapshot(f.orders, work_folder(f.spark, "clone"))


@query(
    "rp2_dedup_changes",
    """SELECT * EXCLUDE rn FROM
         (SELECT *, row_number() OVER (PARTITION BY source, seq ORDER BY ts, l_partkey, l_suppkey,
                      l_quantity, l_extendedprice, l_discount, l_tax) AS rn
          FROM {v_replayed}) WHERE rn = 1""",
)
def dedup_changes(f: Fleet) -> DataFrame:
    return changes.dedup_changes(f.v_replayed, order=["ts"])


APPLIED = """
    WITH latest AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seq DESC) AS rn
                       FROM {v_change}) WHERE rn = 1)
    SELECT b.node_id, b.label, b.amount FROM {v_base} b
    WHERE b.node_id NOT IN (SELECT node_id FROM latest)
    UNION ALL
    SELECT node_id, label, amount FROM latest WHERE op <> 'delete'"""


@query("rp3_apply_changes", APPLIED)
def apply_changes(f: Fleet) -> DataFrame:
    snapshot = changes.as_snapshot(f.v_base)
    return changes.live_rows(changes.apply_changes(snapshot, f.v_change, "node_id"))
