"""Constants the operators must agree on with the managed tool.

Everything here is plain data. Values that carry the name of the managed
storage engine are built from an ``engine`` argument.
"""

from __future__ import annotations

# --- fixed values: enums -------------------------------------------------
ROLE_PRIMARY = "primary"
ROLE_SECONDARY = "secondary"
ROLES = [ROLE_PRIMARY, ROLE_SECONDARY]

TYPE_SERVICE = "local_systemctl"
TYPE_BINARY = "local_binary"
TYPE_REMOTE = "remote_machine"
TYPE_CONTAINER = "docker_container"
NODE_TYPES = [TYPE_SERVICE, TYPE_BINARY, TYPE_REMOTE, TYPE_CONTAINER]

# --- fixed values: node record ------------------------------------------
REQUIRED_NODE_KEYS = ["node_id", "hostname", "role", "node_type"]
NODE_KEYS = [
    "node_id",
    "hostname",
    "role",
    "node_type",
    "host",
    "port",
    "mysql_root_password",
    "ssh_user",
    "ssh_key_path",
    "ssh_port",
    "container_name",
    "docker_network",
    "docker_ip",
    "server_id",
    "data_dir",
    "config_file",
    "local_address",
    "group_seeds",
]
NODE_INT_KEYS = ["node_id", "port", "ssh_port", "server_id"]
NODE_DEFAULTS = {
    "host": "127.0.0.1",
    "port": 3306,
    "ssh_port": 22,
}
NODE_SECRET_KEY = "mysql_root_password"


def node_record_defaults(network: str) -> dict[str, object]:
    """Values of node record keys that are absent; ``network`` names the default network."""
    return {**NODE_DEFAULTS, "docker_network": network}


LOOPBACK = "127.0.0.1"
SERVER_PORT = 3306
CONTAINER_PORT_BASE = 33060
CONTAINER_OCTET_BASE = 10
MAX_OCTET = 255

# --- fixed values: cluster document -------------------------------------
DOCUMENT_KEYS = [
    "cluster_name",
    "mysql_version",
    "mysql_database",
    "mysql_user",
    "docker_network_name",
    "docker_network_subnet",
    "docker_base_ip",
    "docker_image",
    "use_custom_image",
    "base_dir",
    "config_dir",
    "data_dir",
    "logs_dir",
    "docker_dir",
    "mysql_bin_dir",
    "mysqld_path",
    "mysql_client_path",
    "mysqlsh_path",
]
DOCUMENT_SECRET_KEY = "mysql_root_password"


def document_defaults(engine: str, network: str) -> dict[str, object]:
    """Values of cluster document keys that are absent.

    ``engine`` names the storage engine, ``network`` the default network.
    """
    return {
        "cluster_name": f"{engine}_cluster",
        "mysql_version": "8.0.43",
        "mysql_database": "testdb",
        "mysql_user": "clusteruser",
        "docker_network_name": network,
        "docker_network_subnet": "172.20.0.0/16",
        "docker_base_ip": "172.20.0",
        "docker_image": f"mysql-{engine}-ubuntu:8.0.43",
        "use_custom_image": True,
        "base_dir": ".",
        "config_dir": "./config",
        "data_dir": "./data",
        "logs_dir": "./logs",
        "docker_dir": "./docker",
    }


# --- fixed values: settings files ---------------------------------------
SHARED_SETTINGS = {
    "bind-address": "0.0.0.0",
    "log-bin": "mysql-bin",
    "binlog-format": "ROW",
    "gtid-mode": "ON",
    "enforce-gtid-consistency": "ON",
    "relay-log": "mysql-relay-bin",
    "relay-log-recovery": "1",
    "default-storage-engine": "InnoDB",
    "innodb_buffer_pool_size": "1G",
    "innodb_log_file_size": "256M",
    "max_connections": "200",
    "max_allowed_packet": "256M",
}
CONTAINER_FLAGS = {
    "log-bin": "mysql-bin",
    "gtid-mode": "ON",
    "enforce-gtid-consistency": "ON",
    "binlog-format": "ROW",
    "relay-log": "mysql-relay-bin",
}

# --- fixed values: command outcome rules ---------------------------------
# (outcome, words to look for, ignore case, only when the command failed)
CONFIGURE_RULES = [
    ("already_done", ["already configured", "already been configured"], False, False),
]
ADD_RULES = [
    ("already_done", ["already a member", "is already part"], False, False),
]
CREATE_RULES = [
    ("not_found", ["not found", "does not exist", "standalone instance"], False, False),
]
INSTALL_RULES = [
    ("already_done", ["already exists", "duplicate"], True, True),
]

# --- fixed values: run steps that decide success --------------------------
SETUP_UNCOUNTED_STEPS = ["save_config"]
REPLICATION_COUNTED_STEPS = ["configure_primary", "create_cluster"]

# --- fixed values: message templates --------------------------------------
MESSAGES = {
    "containers_started": "Started %d Docker containers",
    "cluster_scaled": "Scaled from %d to %d nodes",
    "already_scaled": "Already have %d Docker nodes",
    "scaled": "Scaled to %d Docker nodes",
    "installed": "Installed on %d/%d nodes",
    "node_not_found": "Node %d not found",
    "node_removed": "Removed node %d",
    "plugin_there": "%s plugin is available",
    "plugin_absent": "%s plugin is not installed",
    "available": "%s available",
    "not_installed": "%s not installed",
    "host_added": "Successfully added %s as secondary node",
    "host_unreachable": "Cannot reach %s",
    "host_not_started": "Cannot start MySQL on %s: %s",
    "host_not_configured": "Cannot configure MySQL on %s: %s",
    "host_not_joined": "Cannot add %s to cluster: %s",
}
MSG_UNKNOWN_ERROR = "Unknown error"
MSG_UNREACHABLE = "Node not reachable"
# action: (message when the awaited state was seen, message when it was not)
POLL_MESSAGES = {
    "start": ("MySQL started successfully", "MySQL started but not responding"),
    "restart": ("MySQL restarted successfully", "MySQL restarted but not responding"),
    "stop": ("MySQL stopped successfully", "MySQL still running after stop command"),
}
MSG_BAD_REMOTE_HOST = "Invalid remote host format: %s"

GLYPH_YES = "✓"
GLYPH_NO = "✗"

# --- fixed values: polling and health check -------------------------------
READY_POLLS = 30
READY_HORIZON_SECONDS = 180
HEALTH_RETRIES = 5

# --- fixed values: seconds allowed per command kind ------------------------
COMMAND_BUDGETS = {
    "tcp_probe": 5,
    "service_start": 60,
    "service_stop": 60,
    "service_restart": 120,
    "sql_statement": 30,
    "shell_script": 120,
    "primary_plugin_copy": 30,
    "primary_plugin_permission": 10,
    "ssh_command": 30,
    "remote_service_start": 60,
    "remote_service_stop": 60,
    "configure_remote": 120,
    "configure_container": 120,
    "add_to_group": 300,
    "remove_from_group": 60,
    "remove_container": 30,
    "plugin_check": 30,
    "containers_up": 300,
    "containers_down": 120,
    "container_inspect": 10,
    "image_inspect": 30,
    "image_build": 1200,
    "image_build_automatic": 600,
    "container_plugin_copy": 60,
    "container_plugin_permission": 30,
    "container_plugin_install": 30,
    "remote_plugin_copy": 120,
    "remote_plugin_move": 60,
    "remote_plugin_install": 30,
}

# --- fixed values: places searched for the plugin file, first wins ---------
# Relative entries are below the parent of the base directory.
PLUGIN_DIRECTORIES = [
    "build",
    "build/Release",
    "build/Debug",
    "plugins",
    "/usr/lib/mysql/plugin",
    "/usr/lib64/mysql/plugin",
    "/usr/local/mysql/lib/plugin",
]
PLUGIN_FILE_TEMPLATES = ["ha_%s.so", "ha_%s_storage_engine.so"]
DEFAULT_PLUGIN_DIR = "/usr/lib/mysql/plugin"

# --- fixed values: white space removed by strip() and split() --------------
WHITESPACE_RANGES = [
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
]
WHITESPACE = "".join(chr(c) for lo, hi in WHITESPACE_RANGES for c in range(lo, hi + 1))
WHITESPACE_CLASS = "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in WHITESPACE_RANGES) + "]"
