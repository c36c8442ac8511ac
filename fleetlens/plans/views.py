"""Fleet views of the given tables.

The texts are plain SQL that Spark and DuckDB both run. ``{name}`` stands for a table or for
another view. Every view reads all rows of its table; its size grows with the table.

- A cluster is a supplier; its secondaries are 300 consecutive orders, and every remainder
  in the texts only varies the content of a row.
- Probes, starts, polls, steps, log lines and changes are events.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "v_cluster": """
        SELECT s_suppkey AS cluster_id, s_name AS cluster_name,
               concat('8.0.', s_nationkey) AS mysql_version,
               concat('10.', s_nationkey, '.0') AS docker_base_ip,
               concat('net-', s_nationkey) AS docker_network,
               concat('registry/db:', s_nationkey) AS docker_image,
               s_acctbal >= 4000 AS use_custom_image,
               concat('/srv/', s_name) AS base_dir,
               concat('host-', s_suppkey) AS hostname,
               CASE WHEN s_nationkey % 2 = 0 THEN 'local_systemctl'
                    ELSE 'local_binary' END AS primary_type,
               s_acctbal >= 500 AS has_primary,
               concat('h', s_nationkey % 3) AS credential_hash,
               CAST(s_nationkey * 13 AS INT) AS target
        FROM {supplier}""",
    "v_secondary": """
        SELECT cluster_id, pos, node_id,
               CASE WHEN remote THEN concat('db', o_custkey)
                    ELSE concat('mysql-secondary-', pos) END AS hostname,
               'secondary' AS role,
               CASE WHEN remote THEN 'remote_machine' ELSE 'docker_container' END AS node_type,
               CASE WHEN remote THEN concat('db', o_custkey) ELSE '127.0.0.1' END AS host,
               CAST(CASE WHEN remote THEN 3306 ELSE 33060 + node_id END AS INT) AS port,
               CASE WHEN remote AND o_orderstatus <> 'F' THEN 'ops' END AS ssh_user,
               CASE WHEN remote AND o_orderstatus = 'P' THEN '/keys/ops' END AS ssh_key_path,
               22 AS ssh_port,
               CASE WHEN NOT remote AND o_orderstatus <> 'O'
                    THEN concat('mysql-secondary-', pos) END AS container_name,
               'cluster-net' AS docker_network,
               CASE WHEN NOT remote THEN concat('10.0.0.', 10 + node_id) END AS docker_ip,
               CAST(CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_totalprice < 50000 THEN 0
                         ELSE node_id END AS INT) AS server_id,
               CAST(NULL AS STRING) AS data_dir, CAST(NULL AS STRING) AS config_file,
               CASE o_orderpriority WHEN '3-MEDIUM' THEN '' WHEN '2-HIGH' THEN NULL
                    ELSE concat('10.9.', pos, ':33061') END AS local_address,
               CAST(NULL AS STRING) AS group_seeds,
               CASE WHEN o_custkey % 7 > 0 THEN concat('h', o_custkey % 3) END AS credential_hash,
               o_totalprice > 100000 AS reachable
        FROM (SELECT orders.*,
                     CAST(floor(o_orderkey / 300) AS BIGINT) AS cluster_id,
                     CAST(1 + o_orderkey % 300 AS INT) AS pos,
                     CAST(CASE WHEN o_orderkey % 300 > 0 AND o_orderstatus = 'P'
                                    AND o_orderpriority = '5-LOW'
                               THEN 1 + o_orderkey % 300 ELSE 2 + o_orderkey % 300 END AS INT)
                       AS node_id,
                     o_orderpriority IN ('1-URGENT', '2-HIGH') AS remote
              FROM {orders} AS orders) AS o""",
    "v_primary": """
        SELECT cluster_id, 0 AS pos, 1 AS node_id, hostname, 'primary' AS role,
               primary_type AS node_type, '127.0.0.1' AS host, 3306 AS port,
               CAST(NULL AS STRING) AS ssh_user, CAST(NULL AS STRING) AS ssh_key_path,
               22 AS ssh_port, CAST(NULL AS STRING) AS container_name,
               'cluster-net' AS docker_network, CAST(NULL AS STRING) AS docker_ip,
               1 AS server_id, CAST(NULL AS STRING) AS data_dir,
               CAST(NULL AS STRING) AS config_file, CAST(NULL AS STRING) AS local_address,
               CAST(NULL AS STRING) AS group_seeds, credential_hash, has_primary AS reachable
        FROM {v_cluster} AS c WHERE has_primary""",
    "v_node": "SELECT * FROM {v_primary} AS p UNION ALL SELECT * FROM {v_secondary} AS s",
    "v_request": """
        SELECT o_orderkey AS request_id,
               CAST(floor(o_orderkey / 300) AS BIGINT) AS cluster_id,
               CAST(o_orderkey % 300 AS INT) AS pos,
               CAST(2 + o_orderkey % 300 AS INT) AS node_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'docker_container'
                    WHEN '2-HIGH' THEN 'remote_machine' END AS node_type,
               CASE WHEN o_orderstatus = 'F' THEN '' WHEN o_totalprice > 400000 THEN NULL
                    ELSE concat('db', o_custkey) END AS host,
               CASE WHEN o_orderstatus = 'O' THEN 'ops' WHEN o_totalprice > 200000 THEN '' END
                 AS ssh_user,
               CASE WHEN o_orderstatus = 'O' THEN '/keys/ops' END AS ssh_key_path,
               concat('172.', 16 + o_custkey % 16, '.0') AS docker_base_ip,
               concat('net-', o_custkey % 5) AS docker_network,
               CASE WHEN o_custkey % 4 > 0 THEN concat('h', o_custkey % 4) END AS credential_hash
        FROM {orders} AS o""",
    "v_remote_host": """
        SELECT CAST(floor(c_custkey / 30) AS BIGINT) AS cluster_id,
               CAST(c_custkey % 30 AS INT) AS pos,
               concat('db', c_custkey) AS host, lower(c_mktsegment) AS ssh_user,
               CASE WHEN c_acctbal > 0 THEN '/keys/ops' END AS ssh_key_path
        FROM {customer} AS c""",
    "v_drop_request": """
        SELECT CAST(floor(c_custkey / 30) AS BIGINT) AS cluster_id,
               CAST(2 + (c_custkey * 7) % 400 AS INT) AS node_id
        FROM {customer} AS c""",
    "v_host_spec": """
        SELECT c_custkey AS spec_id,
               CASE WHEN c_acctbal < 1000 THEN c_name
                    WHEN c_acctbal < 4000 THEN concat(c_name, ':', c_mktsegment, ':/k:x')
                    WHEN c_acctbal < 7000 THEN concat(c_name, ':', c_mktsegment, ':/k')
                    ELSE concat(c_name, ':', c_mktsegment) END AS spec
        FROM {customer} AS c""",
    "v_status_p": """
        SELECT cluster_id, 0 AS pos, 1 AS node_id, hostname, '127.0.0.1' AS host, 3306 AS port,
               primary_type AS node_type, use_custom_image AS running, has_primary AS reachable
        FROM {v_cluster} AS c""",
    "v_status_d": """
        SELECT cluster_id, pos, node_id, hostname AS container_name, docker_ip,
               port AS host_port, server_id IS NOT NULL AS running, reachable
        FROM {v_secondary} AS s WHERE node_type = 'docker_container'""",
    "v_status_r": """
        SELECT cluster_id, pos, node_id, host, reachable,
               ssh_user IS NOT NULL AS ssh_accessible,
               CASE WHEN ssh_user IS NOT NULL THEN server_id IS NULL END AS mysql_running,
               CASE WHEN ssh_key_path IS NOT NULL THEN '8.0.43' END AS mysql_version
        FROM {v_secondary} AS s WHERE node_type = 'remote_machine'""",
    "v_command": """
        SELECT o_orderkey AS command_id, o_totalprice > 60000 AS ok,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'active'
                    WHEN '2-HIGH' THEN 'inactive' WHEN '3-MEDIUM' THEN concat(' active', chr(10))
                    WHEN '4-NOT SPECIFIED' THEN 'true' END AS output,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'mysql.service enabled'
                    WHEN '2-HIGH' THEN 'mysqld.service enabled' ELSE '' END AS units,
               CASE o_orderstatus WHEN 'F' THEN '' WHEN 'P' THEN 'ops' END AS ssh_user,
               concat(' mysql  Ver 8.0.', o_custkey % 50, chr(9), chr(10)) AS version,
               CASE o_orderpriority
                    WHEN '1-URGENT' THEN 'Instance is already configured'
                    WHEN '2-HIGH' THEN 'It IS ALREADY PART of a group'
                    WHEN '3-MEDIUM' THEN 'cluster does not exist'
                    WHEN '4-NOT SPECIFIED' THEN 'ERROR 1125: Function ALREADY EXISTS'
                    ELSE concat('done ', o_orderkey) END AS message
        FROM {orders} AS o""",
    "v_probe": """
        SELECT user_id AS node_id, ts, event_id AS seq,
               event_type IN ('signup', 'view') AS ok, event_type, value
        FROM {events} AS e""",
    "v_start": """
        SELECT user_id AS node_id, event_id AS start_id, ts
        FROM {events} AS e WHERE event_type = 'signup'""",
    "v_poll": """
        SELECT user_id AS node_id, event_id AS seq, ts, event_type = 'view' AS ok
        FROM {events} AS e WHERE event_type <> 'signup'""",
    "v_step": """
        SELECT concat(user_id, '/', CAST(CAST(ts AS DATE) AS STRING)) AS run_id,
               event_id AS seq,
               CASE event_type WHEN 'view' THEN 'save_config'
                    WHEN 'signup' THEN 'create_directories' WHEN 'click' THEN 'generate_configs'
                    ELSE 'generate_docker_compose' END AS setup_name,
               CASE event_type WHEN 'view' THEN 'configure_primary'
                    WHEN 'signup' THEN 'create_cluster'
                    ELSE concat('add_secondary_', user_id) END AS replication_name,
               CASE event_type WHEN 'signup' THEN 'primary' WHEN 'view' THEN 'docker'
                    WHEN 'click' THEN 'remote' WHEN 'purchase' THEN 'remote'
                    ELSE 'replication' END AS part,
               CASE event_type WHEN 'signup' THEN 'tcp_probe' WHEN 'view' THEN 'sql_statement'
                    WHEN 'click' THEN 'service_restart' WHEN 'purchase' THEN 'add_to_group'
                    ELSE 'unlisted' END AS kind,
               CASE WHEN value < 2 THEN NULL ELSE value >= 12 END AS success,
               CASE WHEN value > 6 THEN concat('exit ', event_id % 256) END AS error,
               concat('db', user_id) AS host,
               value AS duration_seconds
        FROM {events} AS e""",
    "v_log": """
        SELECT event_id,
               CASE event_type
                    WHEN 'error' THEN concat('[', second, '] ERROR: stop ', event_id)
                    WHEN 'view' THEN concat('[', second, '] start ', event_id)
                    WHEN 'click' THEN concat(second, ',042 - fleet.node - INFO - ping - ', user_id)
                    WHEN 'signup' THEN concat(second, ',999 - fleet - WARNING - join ', user_id)
                    ELSE concat('stray text ', event_id) END AS line,
               second, event_type, user_id
        FROM (SELECT events.*, CAST(date_trunc('second', ts) AS STRING) AS second
              FROM {events} AS events) AS e""",
    "v_json": """
        SELECT event_id, value > 8 AS available,
               CASE WHEN event_type = 'click' THEN substring(props, 1, length(props) - 1)
                    ELSE props END AS text
        FROM {events} AS e""",
    "v_plugin": """
        SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS cluster_id,
               CAST(p_partkey % 20 AS INT) AS node_id,
               CASE WHEN p_size % 3 = 0 THEN upper(p_type) ELSE lower(p_type) END AS plugin_name,
               CASE WHEN p_size > 25 THEN 'ACTIVE' ELSE 'DISABLED' END AS plugin_status
        FROM {part} AS p""",
    "v_check": """
        SELECT CAST(floor(o_orderkey / 300) AS BIGINT) AS cluster_id,
               CAST(1 + o_orderkey % 300 AS INT) AS pos,
               o_orderstatus = 'P' AS found,
               CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'timed out' END AS error
        FROM {orders} AS o WHERE o_orderpriority <> '5-LOW'
        UNION ALL
        SELECT s_suppkey AS cluster_id, 0 AS pos, s_nationkey % 2 = 0 AS found,
               CASE WHEN s_nationkey % 5 = 0 THEN 'timed out' END AS error
        FROM {supplier} AS s""",
    "v_install": """
        SELECT CAST(floor(o_orderkey / 300) AS BIGINT) AS cluster_id,
               CAST(1 + o_orderkey % 300 AS INT) AS pos,
               o_orderkey % 300 < 250 OR o_totalprice > 9000 AS success
        FROM {orders} AS o WHERE o_orderpriority <> '5-LOW'""",
    "v_member_desired": """
        SELECT c_nationkey AS cluster_id, concat('root@db', c_custkey, ':3306') AS uri
        FROM {customer} AS c WHERE c_acctbal > 0""",
    "v_member_actual": """
        SELECT c_nationkey AS cluster_id, concat('root@db', o_custkey, ':3306') AS uri
        FROM {orders} AS o JOIN {customer} AS c ON o_custkey = c_custkey
        WHERE o_orderstatus <> 'P' OR o_totalprice > 300000""",
    "v_observed": """
        SELECT p_partkey AS node, CASE WHEN p_size > 25 THEN 'log-bin' ELSE 'log_bin' END AS key,
               CASE WHEN p_size > 45 THEN NULL WHEN p_size % 5 = 0 THEN p_type ELSE p_brand END
                 AS value
        FROM {part} AS p WHERE p_size <> 7
        UNION ALL
        SELECT p_partkey AS node, 'sync_binlog' AS key, p_brand AS value
        FROM {part} AS p WHERE p_size = 11""",
    "v_expected": """
        SELECT p_partkey AS node, 'log-bin' AS key,
               CASE WHEN p_size > 48 THEN NULL ELSE p_brand END AS value
        FROM {part} AS p""",
    "v_candidate": """
        SELECT CAST(floor(p_partkey / 14) AS BIGINT) AS group_id,
               CAST(p_partkey % 14 AS INT) AS candidate_rank, p_size % 7 = 0 AS found
        FROM {part} AS p""",
    "v_attempt": """
        SELECT o_orderkey AS attempt_id, concat('db', o_custkey) AS host,
               o_orderpriority <> '1-URGENT' AS reachable,
               CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'O' END AS running,
               o_totalprice > 100000 AS start_ok, concat('start ', o_orderkey) AS start_message,
               o_orderpriority <> '2-HIGH' AS configure_ok, 'no grant' AS configure_message,
               CASE WHEN o_totalprice > 60000 THEN o_orderpriority <> '5-LOW' END AS join_ok,
               concat('join ', o_custkey) AS join_message
        FROM {orders} AS o""",
    "v_change": """
        SELECT user_id AS node_id, event_id AS seq, ts,
               CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert'
                    ELSE 'update' END AS op,
               event_type AS label, value AS amount
        FROM {events} AS e""",
    "v_base": """
        SELECT c_custkey AS node_id, c_mktsegment AS label, c_acctbal AS amount
        FROM {customer} AS c""",
    "v_replayed": """
        SELECT l_linenumber AS source, l_orderkey AS seq, l_shipdate AS ts, l_partkey,
               l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax
        FROM {lineitem} AS l""",
    "v_settings_text": """
        SELECT cluster_id, pos,
               CASE WHEN pos = 0 THEN 'primary.cnf' ELSE concat('secondary', pos, '.cnf') END
                 AS file_name, node_id,
               concat('# head', chr(10), '[mysqld]', chr(10), 'server-id = ', node_id, chr(10),
                      chr(10), '  port=', port, chr(10), '# port = 1', chr(10),
                      'max_connections = 10', chr(10), 'skip-name-resolve', chr(10),
                      '[client]', chr(10), 'host = ', host, chr(10), '[mysqld]', chr(10),
                      'max_connections = ', pos, chr(10)) AS text, host, port
        FROM {v_node} AS s""",
    "v_cluster_doc": """
        SELECT s_suppkey AS cluster_id, s_nationkey, s_name,
               CASE WHEN s_nationkey = 7 THEN concat('not json ', s_name)
                    ELSE concat('{{"cluster_name":"', s_name, '"',
                         CASE WHEN s_nationkey % 3 = 0 THEN ',"mysql_version":null'
                              WHEN s_nationkey % 3 = 1 THEN ''
                              ELSE concat(',"mysql_version":"8.4.', s_nationkey, '"') END,
                         CASE WHEN s_nationkey % 2 = 0 THEN ',"use_custom_image":false' ELSE '' END,
                         CASE WHEN s_nationkey = 8 THEN ',"secondaries":null'
                              WHEN s_nationkey > 12 THEN ',"secondaries":[{{}},{{}}]' ELSE '' END,
                         CASE WHEN s_nationkey % 4 = 0 THEN ',"primary":null'
                              WHEN s_nationkey % 4 = 1 THEN ',"primary":{{}}'
                              WHEN s_nationkey % 4 = 2 THEN ',"primary":{{"node_id":1}}'
                              ELSE '' END, '}}') END AS doc
        FROM {supplier} AS s""",
    "v_node_doc": """
        SELECT o_orderkey AS cluster_id, o_custkey, o_orderpriority, o_orderstatus,
               concat('{{"secondaries":[{{"node_id":', o_orderkey, ',"hostname":"db', o_custkey,
                      '","node_type":"',
                      CASE WHEN o_orderstatus = 'F' THEN 'cloud' ELSE 'remote_machine' END, '"',
                      CASE WHEN o_orderpriority = '1-URGENT' THEN ''
                           ELSE ',"role":"secondary"' END,
                      CASE o_orderpriority WHEN '2-HIGH' THEN ',"zone":"a"'
                           WHEN '3-MEDIUM' THEN ',"port":null' WHEN '4-NOT SPECIFIED' THEN ''
                           ELSE concat(',"port":"', o_custkey, '"') END, '}}]}}') AS doc
        FROM {orders} AS o""",
}


def _names(text: str) -> list[str]:
    return sorted({field for _, field, _, _ in Formatter().parse(text) if field})


class Fleet:
    """The tables of one folder and the views on them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name]
            return self.spark.sql(text, **{n: getattr(self, n) for n in _names(text)})
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        raise AttributeError(name)


def duckdb_sql(body: str) -> str:
    """``body`` with the views it names in front as common table expressions."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _names(text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                ordered.append(name)

    visit(body)
    named = {name: name for name in [*VIEWS, *TABLES]}
    heads = ", ".join(f"{name} AS ({VIEWS[name].format_map(named)})" for name in ordered)
    main = body.format_map(named)
    if not heads:
        return main
    glue = ", " if main.lstrip().upper().startswith("WITH ") else " "
    rest = main.lstrip()[5:] if glue == ", " else main
    return f"WITH {heads}{glue}{rest}"
