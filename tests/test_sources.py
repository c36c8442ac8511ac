import json

import pytest
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.sources import documents, hosts, logs, settings, sql_nodes

ENGINE, SALT, NETWORK = "engine", "salt", "net"


def decode(spark, *docs):
    raw = spark.createDataFrame([(f"c{i}", d) for i, d in enumerate(docs)], "cluster_id string, doc string")
    return documents.decode_documents(raw, ENGINE, SALT, NETWORK)


def test_absent_key_takes_the_default_and_null_stays_null(spark):
    rows = decode(spark, "{}", '{"mysql_version": null, "cluster_name": "x"}').orderBy("cluster_id").collect()
    assert (rows[0].mysql_version, rows[0].cluster_name) == ("8.0.43", "engine_cluster")
    assert (rows[1].mysql_version, rows[1].cluster_name) == (None, "x")
    assert rows[0].use_custom_image is True and rows[0].base_dir == "." and rows[0].mysqld_path is None
    assert rows[0].secondary_jsons == [] and rows[0].primary_json is None


def test_primary_and_secondaries_forms(spark):
    docs = ['{"primary": {}}', '{"primary": null}', '{"primary": {"node_id": 1}}', '{"secondaries": null}', "[1]", "{broken"]
    rows = decode(spark, *docs).orderBy("cluster_id").collect()
    assert [r.primary_json is None for r in rows[:3]] == [True, True, False]
    assert [r.reject_reason for r in rows[3:]] == [
        "secondaries is not a list", "not a JSON object", "not a JSON object",
    ]


def test_node_rejects_carry_a_reason(spark):
    good = {"node_id": 2, "hostname": "h", "role": "secondary", "node_type": "docker_container"}
    nodes = [
        good,
        {**good, "port": None},
        {**good, "role": "boss"},
        {**good, "node_type": None},
        {**good, "zone": 1},
        {k: v for k, v in good.items() if k != "node_id"},
        {**good, "port": "many"},
        {**good, "hostname": None, "port": "33062"},
    ]
    docs = decode(spark, json.dumps({"secondaries": nodes, "primary": {**good, "role": "primary"}}))
    accepted, rejected = documents.decode_nodes(docs, SALT, NETWORK)
    assert {r.pos: (r.port, r.ssh_port) for r in accepted.collect()} == {
        0: (3306, 22), 1: (3306, 22), 2: (None, 22), 8: (33062, 22),
    }
    assert {r.pos: r.reject_reason for r in rejected.collect()} == {
        3: "invalid role", 4: "invalid node_type", 5: "unknown zone", 6: "missing node_id",
        7: "not a number port",
    }


def test_node_records_without_role_are_rejected(spark):
    doc = {
        "primary": {"node_id": 1, "hostname": "primary", "node_type": "local_systemctl"},
        "secondaries": [{"node_id": 2, "hostname": "mysql-secondary-1", "node_type": "docker_container"}],
    }
    accepted, rejected = documents.decode_nodes(decode(spark, json.dumps(doc)), SALT, NETWORK)
    assert accepted.count() == 0
    assert {r.reject_reason for r in rejected.collect()} == {"missing role"}


def test_passwords_never_enter_a_table(spark):
    doc = '{"mysql_root_password": "secret1", "secondaries": [{"node_id": 1, "hostname": "h", "role": "secondary", "node_type": "remote_machine", "mysql_root_password": "secret1"}]}'
    docs = decode(spark, doc)
    nodes, _ = documents.decode_nodes(docs, SALT, NETWORK)
    assert nodes.first().credential_hash == docs.first().credential_hash
    assert "secret1" not in str(nodes.collect()) and "mysql_root_password" not in docs.columns


def test_files_and_lines_round_trip(spark, tmp_path):
    nodes = [
        {"node_id": i, "hostname": f"h{i}", "role": "secondary", "node_type": "remote_machine", "port": None}
        for i in range(2, 5)
    ]
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps({"cluster_name": "one", "secondaries": nodes}, indent=2))
    docs = documents.load_cluster_docs(spark, str(folder), ENGINE, SALT, NETWORK)
    assert docs.first().cluster_id == "one.json"
    accepted, _ = documents.decode_nodes(docs, SALT, NETWORK)
    out = str(tmp_path / "out")
    documents.write_cluster_docs(docs, accepted, out)
    again = documents.load_cluster_docs(spark, out, ENGINE, SALT, NETWORK, one_per_line=True)
    decoded, rejected = documents.decode_nodes(again, SALT, NETWORK)
    assert rejected.count() == 0
    columns = [k for k in fv.NODE_KEYS if k != fv.NODE_SECRET_KEY] + ["pos"]
    assert sorted(map(str, decoded.select(columns).collect())) == sorted(
        map(str, accepted.select(columns).collect())
    )
    assert again.select(fv.DOCUMENT_KEYS).first() == docs.select(fv.DOCUMENT_KEYS).first()
    text = json.loads(spark.read.text(out).first().value)
    assert text["secondaries"][0]["port"] is None and text["primary"] is None


def test_host_specs(spark):
    specs = ["h:u", "h:u:/k", "h:u:/k:x:y", "h", "", "fe80::1:u", "h:"]
    frame = spark.createDataFrame([(s,) for s in specs], "spec string")
    rows = {r.spec: r for r in hosts.parse_remote_hosts(frame).collect()}
    for spec in specs:
        parts = spec.split(":")
        row = rows[spec]
        if len(parts) < 2:
            assert row.error == f"Invalid remote host format: {spec}" and row.host is None
        else:
            assert (row.host, row.ssh_user) == (parts[0], parts[1])
            assert row.ssh_key_path == (parts[2] if len(parts) > 2 else None)
            assert row.extra_parts == max(len(parts) - 3, 0)


def test_settings_files(spark, tmp_path):
    (tmp_path / "primary.cnf").write_text(
        "port = 1\n[mysqld]\n# Server\nserver-id = 1\nopts = a=b # no comment\n\nport=3306\nport = 3307\nskip\n"
    )
    (tmp_path / "secondary4.cnf").write_text("[mysqld]\r\nserver-id = 5\r\n")
    (tmp_path / "other.cnf").write_text("# nothing\n")
    rows = settings.settings_source(spark, str(tmp_path)).collect()
    assert {(r.node_id, r.section, r.key, r.value) for r in rows} == {
        (1, "", "port", "1"), (1, "mysqld", "server-id", "1"), (1, "mysqld", "opts", "a=b # no comment"),
        (1, "mysqld", "port", "3307"), (1, "mysqld", "skip", None), (5, "mysqld", "server-id", "5"),
    }


def test_log_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "2024-05-01 10:00:00,123 - fleet.node - WARNING - a - b\n"
        "[2024-05-01 10:00:01] ERROR: bad\n[2024-05-01 10:00:02] fine\n"
        "2024-13-01 10:00:00,123 - x - INFO - no such month\nTraceback\n"
    )
    rows = logs.read_tool_logs(spark, str(tmp_path)).collect()
    assert [(r.logger, r.level, r.message, r.parsed) for r in rows] == [
        ("fleet.node", "WARNING", "a - b", True),
        (None, "ERROR", "bad", True),
        (None, "INFO", "fine", True),
        (None, None, "2024-13-01 10:00:00,123 - x - INFO - no such month", False),
        (None, None, "Traceback", False),
    ]
    assert str(rows[0].ts) == "2024-05-01 10:00:00.123000"


class Answers:
    """A stand-in for a DB-API connection: no server and no database is involved."""

    def __init__(self, host, port):
        if host == "down":
            raise OSError("connection refused")
        self.lost = host == "lost"
        self.rows = [] if host == "empty" else [(host, port + i, None) for i in range(5)]

    def cursor(self):
        return self

    def execute(self, sql):
        if sql != "SELECT 1":
            raise ValueError(sql)

    def fetchmany(self, n):
        if self.lost and len(self.rows) < 5:
            raise OSError("lost")
        head, self.rows = self.rows[:n], self.rows[n:]
        return head

    def close(self):
        pass


def test_node_sql_source_reports_failing_nodes(spark):
    nodes = spark.createDataFrame(
        [(1, 1, "up", 10), (1, 2, "down", 10), (1, 3, "lost", 10), (2, 1, "empty", 10)],
        "cluster_id long, node_id int, host string, port int",
    )
    answers = sql_nodes.node_sql_source(nodes, "SELECT 1", Answers, fetch_rows=2, concurrency=3)
    rows = sorted(answers.collect(), key=str)
    good = [r for r in rows if r.answer is not None and r.node_id == 1]
    assert [(r.row_no, r.answer) for r in sorted(good, key=lambda r: r.row_no)] == [
        (i, f"up\t{10 + i}\tNULL") for i in range(5)
    ]
    assert sorted((r.cluster_id, r.node_id, r.ok, r.row_no, r.message) for r in rows if r.last) == [
        (1, 1, True, 5, None), (1, 2, False, 0, "connection refused"), (1, 3, False, 2, "lost"),
        (2, 1, True, 0, None),
    ]
    complete = sql_nodes.complete_answers(answers)
    assert {(r.cluster_id, r.node_id) for r in complete.collect()} == {(1, 1)} and complete.count() == 5


def test_plugin_answers_feed_the_plugin_test(spark):
    from fleetlens.functions.scalars import has_plugin

    frame = spark.createDataFrame([("ENGINE\tDISABLED",), (None,)], "answer string")
    assert [r[0] for r in frame.select(has_plugin(F.col("answer"), "engine")).collect()] == [True, False]


@pytest.mark.parametrize("key", fv.REQUIRED_NODE_KEYS)
def test_every_required_key(spark, key):
    good = {"node_id": 2, "hostname": "h", "role": "secondary", "node_type": "docker_container"}
    good.pop(key)
    _, rejected = documents.decode_nodes(decode(spark, json.dumps({"secondaries": [good]})), SALT, NETWORK)
    assert rejected.first().reject_reason == f"missing {key}"


def test_status_tree(spark):
    from fleetlens.operators.status import status_union
    from fleetlens.sources.export import status_tree

    primary = spark.createDataFrame(
        [(1, 0, 1, "h", "127.0.0.1", 3306, "local_binary", True, True), (2, 0, 1, "h", "x", 1, "t", False, None)],
        "cluster_id long, pos int, node_id int, hostname string, host string, port int, node_type string, running boolean, reachable boolean",
    )
    docker = spark.createDataFrame(
        [(1, p, p + 1, f"c{p}", "10.0.0.1", 1, True, None) for p in (2, 1, 12)],
        "cluster_id long, pos int, node_id int, container_name string, docker_ip string, host_port int, running boolean, reachable boolean",
    )
    remote = spark.createDataFrame(
        [(1, 3, 4, "db", True, True, None, 'v"8')],
        "cluster_id long, pos int, node_id int, host string, reachable boolean, ssh_accessible boolean, mysql_running boolean, mysql_version string",
    )
    clusters = spark.createDataFrame(
        [(1, 'a"b', '{"x": [1, null]}'), (2, "b", "{}"), (3, None, None)], "cluster_id long, cluster_name string, cluster_output string"
    )
    rows = status_tree(clusters, status_union(primary, docker, remote), width=5).collect()
    one, two, three = (json.loads(r.status_json) for r in sorted(rows, key=lambda r: r.cluster_id))
    assert one["cluster_name"] == 'a"b' and one["cluster"] == {"x": [1, None]}
    assert [n["container_name"] for n in one["secondaries"]["docker"]] == ["c1", "c2", "c12"]
    assert one["secondaries"]["total_nodes"] == 4 and one["secondaries"]["remote"][0]["mysql_version"] == 'v"8'
    assert one["primary"]["node_type"] == "local_binary" and two["cluster"] is None
    assert three == {"cluster_name": None, "primary": None, "secondaries": {"docker": [], "remote": [], "total_nodes": 0}, "cluster": None}


def test_the_last_of_repeated_keys_wins(spark):
    text = '{"cluster_name":"a","cluster_name":"b","mysql_version":"1","mysql_version":null,"secondaries":[]}'
    row = decode(spark, text).first()
    assert row["cluster_name"] == "b" and row["mysql_version"] is None and row["reject_reason"] is None
    node = '{"node_id":2,"hostname":"x","role":"secondary","node_type":"cloud","node_type":"remote_machine","port":1,"port":2}'
    good, rejected = documents.decode_nodes(decode(spark, '{"secondaries":[%s]}' % node), SALT, NETWORK)
    assert rejected.count() == 0 and good.first()["port"] == 2
    # Three times one key, and a repeated key between others.
    many = decode(spark, '{"base_dir":"1","cluster_name":"x","base_dir":"2","mysql_version":"v","base_dir":"3"}').first()
    assert (many["base_dir"], many["cluster_name"], many["mysql_version"]) == ("3", "x", "v")


def test_good_and_rejected_nodes_are_stored_in_one_pass(spark, tmp_path):
    node = {"node_id": 2, "hostname": "h", "role": "secondary", "node_type": "remote_machine"}
    texts = [json.dumps({"secondaries": [node, {**node, "role": "x"}, {**node, "zone": 1}]}), "no json", "{}"]
    raw = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "cluster_id string, doc string")
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    docs = documents.decode_documents(raw.mapInArrow(counted, raw.schema), ENGINE, SALT, NETWORK)
    good, rejected = documents.store_nodes(docs, str(tmp_path / "nodes"), SALT, NETWORK)
    plain = documents.decode_nodes(documents.decode_documents(raw, ENGINE, SALT, NETWORK), SALT, NETWORK)
    assert sorted(map(tuple, good.select(*plain[0].columns).collect()), key=str) == sorted(map(tuple, plain[0].collect()), key=str)
    assert sorted(map(tuple, rejected.collect())) == sorted(map(tuple, plain[1].collect())) and rejected.count() == 2
    assert scans.value == 3
