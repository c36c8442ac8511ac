"""Declared schemas of the tables the operators take; pass them to ``spark.read.schema``."""

from __future__ import annotations

CLUSTER = (
    "cluster_id long, cluster_name string, mysql_version string, mysql_database string, "
    "mysql_user string, docker_network_name string, docker_network_subnet string, "
    "docker_base_ip string, docker_image string, use_custom_image boolean, base_dir string, "
    "config_dir string, data_dir string, logs_dir string, docker_dir string, mysql_bin_dir string, "
    "mysqld_path string, mysql_client_path string, mysqlsh_path string, credential_hash string"
)
NODE = (
    "cluster_id long, pos int, node_id int, hostname string, role string, node_type string, "
    "host string, port int, ssh_user string, ssh_key_path string, ssh_port int, "
    "container_name string, docker_network string, docker_ip string, server_id int, "
    "data_dir string, config_file string, local_address string, group_seeds string, "
    "credential_hash string"
)
REMOTE_HOST = "cluster_id long, pos int, host string, ssh_user string, ssh_key_path string"
OF_CLUSTER = "docker_base_ip string, docker_network string, credential_hash string"
NODE_REQUEST = f"cluster_id long, count int, {OF_CLUSTER}"
SCALE_TARGET = f"cluster_id long, target int, {OF_CLUSTER}"
DROP_REQUEST = "cluster_id long, node_id int"

STATUS_PRIMARY = (
    "cluster_id long, pos int, node_id int, hostname string, host string, port int, "
    "node_type string, running boolean, reachable boolean, service_status string"
)
STATUS_DOCKER = (
    "cluster_id long, pos int, node_id int, container_name string, docker_ip string, "
    "host_port int, running boolean, reachable boolean"
)
STATUS_REMOTE = (
    "cluster_id long, pos int, node_id int, host string, reachable boolean, "
    "ssh_accessible boolean, mysql_running boolean, mysql_version string"
)
PLUGIN = "cluster_id long, node_id int, plugin_name string, plugin_status string"
PLUGIN_CHECK = "cluster_id long, pos int, found boolean, error string"
INSTALL_RESULT = "cluster_id long, pos int, success boolean, message string"

PROBE = "node_id long, ts timestamp, seq long, ok boolean"
START = "node_id long, start_id long, ts timestamp"
STEP = "run_id string, seq long, name string, success boolean, message string, error string"
RUN_PART = "run_id string, part string, host string, success boolean, message string"
TIMED_STEP = "run_id string, seq long, kind string, duration_seconds double"
BUDGET = "kind string, budget_seconds int"
SETTING = "cluster_id long, pos int, key string, value string"
MEMBER = "cluster_id long, uri string"
CANDIDATE_GROUP = "group_id long, base_dir string"
EXISTING_FILE = "group_id long, path string"
CHANGE_HEAD = "source string, seq long, op string, ts timestamp"
