from fleetlens.operators import runs, status
from pyspark.sql import functions as F

STEP = "run_id string, name string, success boolean, error string"


def only(frame, column):
    return {r.run_id: r[column] for r in frame.collect()}


def test_saving_the_document_does_not_count(spark):
    steps = spark.createDataFrame(
        [("a", "create_directories", True, None), ("a", "save_config", False, "disk full"),
         ("b", "create_directories", False, None), ("c", "save_config", False, None),
         ("d", "generate_configs", None, None)],
        STEP,
    )
    assert only(runs.setup_rollup(steps), "success") == {"a": True, "b": False, "c": True, "d": False}
    assert only(runs.setup_rollup(steps, strict=True), "success")["a"] is False
    lines = {r.line for r in runs.failed_steps(steps).collect()}
    assert lines == {
        "save_config: disk full", "create_directories: Unknown error",
        "save_config: Unknown error", "generate_configs: Unknown error",
    }


def test_failed_secondary_does_not_fail_replication(spark):
    steps = spark.createDataFrame(
        [("a", "configure_primary", True, None), ("a", "create_cluster", True, None),
         ("a", "configure_secondary_2", False, None), ("b", "configure_primary", False, None)],
        STEP,
    )
    rolled = runs.replication_rollup(steps)
    assert only(rolled, "success") == {"a": True, "b": False}
    assert only(rolled, "failed_secondary_steps") == {"a": 1, "b": 0}
    assert only(runs.replication_rollup(steps, strict=True), "success")["a"] is False


def test_start_and_stop(spark):
    parts = spark.createDataFrame(
        [("ok", "primary", True), ("ok", "docker", True), ("ok", "remote", True),
         ("one", "primary", True), ("one", "remote", True), ("one", "remote", False),
         ("repl", "primary", True), ("repl", "replication", False),
         ("dead", "primary", False), ("dead", "docker", True)],
        "run_id string, part string, success boolean",
    )
    started = runs.start_rollup(parts)
    assert only(started, "success") == {"ok": True, "one": False, "repl": False, "dead": False}
    assert only(started, "docker_success")["dead"] is None
    assert only(started, "failed_remote")["one"] == 1
    assert only(runs.stop_rollup(parts), "success") == {"ok": True, "one": True, "repl": True, "dead": False}
    assert only(runs.stop_rollup(parts, strict=True), "success")["one"] is False


def test_failed_parts_of_a_start(spark):
    parts = spark.createDataFrame(
        [("primary", None, False, "dead"), ("docker", None, None, "m"), ("remote", "h1", False, "no ssh"),
         ("remote", "h2", True, "fine"), ("replication", None, False, "x")],
        "part string, host string, success boolean, message string",
    )
    assert {r.line for r in runs.failed_parts(parts).collect()} == {
        "Primary: dead", "Docker: m", "Remote h1: no ssh",
    }


def test_install_counts_silent_nodes(spark):
    nodes = spark.createDataFrame(
        [(1, 0, "primary"), (1, 1, "secondary"), (1, 2, "secondary")], "cluster_id long, pos int, role string"
    )
    results = spark.createDataFrame([(1, 0, True), (1, 1, True)], "cluster_id long, pos int, success boolean")
    row = runs.install_summary(nodes, results).first()
    assert (row.success, row.summary) == (True, "Installed on 2/3 nodes")


def test_budgets_from_a_table(spark):
    steps = spark.createDataFrame([("a", 5.0), ("a", 5.1), ("z", 1.0)], "kind string, duration_seconds double")
    budgets = spark.createDataFrame([("a", 5)], "kind string, budget_seconds int")
    expected = {(5.0, "within"), (5.1, "timed_out"), (1.0, "no_budget")}
    for table in (budgets, {"a": 5}):
        rows = runs.timeout_budget(steps, table).collect()
        assert {(r.duration_seconds, r.verdict) for r in rows} == expected


def test_first_existing_candidate(spark):
    candidates = runs.plugin_candidates("engine")
    assert candidates[1] == ("build", "ha_engine_storage_engine.so") and len(candidates) == 14
    existing = spark.createDataFrame(
        [
            (1, "/srv/db/plugins/ha_engine.so"), (1, "/srv/db/build/ha_engine_storage_engine.so"),
            (1, "/usr/lib/mysql/plugin/ha_engine.so"), (2, "/elsewhere/build/ha_engine.so"),
            (3, "build/Debug/ha_engine.so"), (4, "/plugins/ha_engine.so"),
            (5, "/usr/lib64/mysql/plugin/ha_engine.so"), (5, "/a/cluster/build/ha_engine.so"),
        ],
        "group_id long, path string",
    )
    bases = [(1, "/srv/db/cluster/"), (2, "/srv/x"), (3, "cluster"), (4, "/cluster"), (5, "/a/cluster")]
    groups = spark.createDataFrame(bases, "group_id long, base_dir string")
    rows = {r.group_id: r for r in runs.resolve_candidate(groups, existing, candidates).collect()}
    assert rows[1].path == "/srv/db/build/ha_engine_storage_engine.so"
    assert rows[2].path is None and rows[2].reason == "no candidate exists"
    assert [rows[i].path for i in (3, 4, 5)] == [
        "build/Debug/ha_engine.so", "/plugins/ha_engine.so", "/usr/lib64/mysql/plugin/ha_engine.so",
    ]


def test_first_failure_of_a_remote_host_gives_the_message(spark):
    schema = (
        "host string, reachable boolean, running boolean, start_ok boolean, start_message string,"
        " configure_ok boolean, configure_message string, join_ok boolean, join_message string"
    )
    rows = [
        ("a", None, True, True, "s", True, "c", True, "j"), ("b", True, False, False, "s", True, "c", True, "j"),
        ("c", True, True, None, None, True, "c", True, "j"), ("d", True, True, None, None, False, None, True, "j"),
        ("e", True, None, True, None, True, "c", False, "j"),
    ]
    got = {r.host: (r.success, r.message) for r in runs.remote_host_outcome(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "a": (False, "Cannot reach a"), "b": (False, "Cannot start MySQL on b: s"),
        "c": (True, "Successfully added c as secondary node"), "d": (False, "Cannot configure MySQL on d: "),
        "e": (False, "Cannot add e to cluster: j"),
    }


def test_program_path_priority(spark):
    rows = [("/x/mysqld", "/b", "/f"), (None, "/b", "/f"), ("", "", "/f"), (None, None, None)]
    frame = spark.createDataFrame(rows, "e string, b string, f string")
    path = status.program_path(F.col("e"), F.col("b"), F.col("f"), "mysqld", "/usr/sbin/mysqld")
    assert [r[0] for r in frame.select(path).collect()] == ["/x/mysqld", "/b/mysqld", "/f", "/usr/sbin/mysqld"]


def test_latest_status_breaks_ties_by_sequence(spark):
    rows = [(1, "2024-01-01", 1, "a"), (1, "2024-01-01", 2, "b"), (1, "2023-01-01", 3, "c")]
    frame = spark.createDataFrame(rows, "node_id long, ts string, seq long, v string")
    assert [r.v for r in status.latest_status(frame).collect()] == ["b"]
