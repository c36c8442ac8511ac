import random

from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.functions.ranking import expand_slots, group_position, number_chunk
from fleetlens.functions.skew import join_per_group
from fleetlens.operators import audit
from fleetlens.operators import nodes as ops

NODE = "cluster_id long, pos int, node_id int, role string, node_type string, host string, port int, hostname string"


def node(cluster, pos, node_id, kind=fv.TYPE_CONTAINER, role=fv.ROLE_SECONDARY):
    return (cluster, pos, node_id, role, kind, "127.0.0.1", 33060 + node_id, f"n{node_id}")


def sorted_rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_group_position_with_one_hot_group(spark):
    seeded = random.Random(1)
    rows = [(1, p) for p in seeded.sample(range(10_000), 3000)]
    rows += [(k, p) for k in range(2, 40) for p in seeded.sample(range(300), 50)]
    frame = spark.createDataFrame(rows, "k long, p long")
    ranked = group_position(frame, ["k"], ["p"], number_chunk("p", 64), "rank", total="n")
    members = {}
    for k, p in rows:
        members.setdefault(k, []).append(p)
    expected = sorted(
        (k, p, i + 1, len(ps)) for k, ps in members.items() for i, p in enumerate(sorted(ps))
    )
    assert sorted_rows(ranked.select("k", "p", "rank", "n")) == expected


def test_group_position_keeps_rows_without_key(spark):
    frame = spark.createDataFrame([(None, 1), (1, 5)], "k long, p long")
    ranked = group_position(frame, ["k"], ["p"], number_chunk("p"), "rank")
    assert {(r.k, r["rank"]) for r in ranked.collect()} == {(None, None), (1, 1)}


def test_join_per_group_equals_plain_join(spark):
    seeded = random.Random(4)
    rows = [(0 if seeded.random() < 0.5 else seeded.randrange(30), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k long, i long")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 30, 2)], "k long, v string")
    for how in ("inner", "left", "left_semi"):
        salted = join_per_group(frame, lookup, ["k"], ["i"], how, salts=8)
        assert sorted(map(str, salted.collect())) == sorted(map(str, frame.join(lookup, "k", how).collect()))


def test_expand_slots_gives_exact_counts(spark):
    counts = {1: 0, 2: -3, 3: 1, 4: 64, 5: 65, 6: 200}
    frame = spark.createDataFrame(list(counts.items()), "k long, n int")
    rows = expand_slots(frame, "n", "slot", width=64).select("k", "slot")
    assert sorted_rows(rows) == [(k, i) for k, n in counts.items() for i in range(n)]


def test_ids_collide_after_a_removal(spark):
    nodes = spark.createDataFrame([node(1, 1, 2), node(1, 2, 3), node(1, 3, 4)], NODE)
    kept, missing = ops.drop_nodes(nodes, spark.createDataFrame([(1, 3), (1, 9)], "cluster_id long, node_id int"))
    assert [r.node_id for r in kept.orderBy("pos").collect()] == [2, 4]
    assert [r.message for r in missing.collect()] == ["Node 9 not found"]
    new = spark.createDataFrame([(1, 4)], "cluster_id long, pos int")
    assert [r.node_id for r in ops.number_nodes(new, kept).collect()] == [4]


def test_drop_takes_only_the_first_match_and_never_the_primary(spark):
    nodes = spark.createDataFrame(
        [node(1, 0, 1, fv.TYPE_SERVICE, fv.ROLE_PRIMARY), node(1, 1, 2), node(1, 2, 2)], NODE
    )
    requests = spark.createDataFrame([(1, 2), (1, 1)], "cluster_id long, node_id int")
    kept, missing = ops.drop_nodes(nodes, requests)
    assert sorted(r.pos for r in kept.collect()) == [0, 2]
    assert [r.node_id for r in missing.collect()] == [1]


def fleet(spark):
    rows = [node(1, 0, 1, fv.TYPE_SERVICE, fv.ROLE_PRIMARY)]
    kinds = [fv.TYPE_CONTAINER, fv.TYPE_REMOTE, fv.TYPE_CONTAINER, fv.TYPE_REMOTE, fv.TYPE_CONTAINER]
    for cluster in range(1, 7):
        rows += [node(cluster, i + 1, i + 2, kind) for i, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, NODE).withColumn("docker_ip", F.lit(None).cast("string"))


def test_scale_plan_cases_and_applied_count(spark):
    nodes = fleet(spark)
    targets = spark.createDataFrame(
        [(1, 5, "10.0.0", "net", "h"), (2, 1, "10.0.0", "net", "h"), (3, 0, "10.0.0", "net", "h"), (4, 9, "10.0.0", "net", "h"), (5, 3, "10.0.0", "net", "h"), (8, 2, "10.0.0", "net", "h")],
        "cluster_id long, target int, docker_base_ip string, docker_network string, credential_hash string",
    )
    plan = ops.scale_plan(targets, nodes)
    by_cluster = {r.cluster_id: r for r in plan.collect()}
    assert by_cluster[1].message == "Already have 3 Docker nodes"
    assert (by_cluster[2].remove_count, by_cluster[2].current_count) == (3, 2)
    assert by_cluster[3].current_count == 2
    assert by_cluster[4].message == "Scaled to 7 Docker nodes"
    assert (by_cluster[8].previous_count, by_cluster[8].add_count) == (0, 2)
    after = ops.apply_scale_plan(plan, nodes.filter("cluster_id <> 6"))
    counts = {r.cluster_id: r["count"] for r in after.groupBy("cluster_id").count().collect()}
    assert counts == {c: r.current_count for c, r in by_cluster.items()}
    assert after.columns == nodes.columns
    removed = ops.plan_removals(plan, nodes).filter("cluster_id = 5").collect()
    assert [r.pos for r in removed] == [3, 5] or {r.pos for r in removed} == {3, 5}
    added = ops.plan_additions(plan).filter("cluster_id = 4").orderBy("node_id").collect()
    assert [(r.node_id, r.container_name, r.docker_ip, r.port) for r in added] == [
        (7, "mysql-secondary-6", "10.0.0.17", 33067),
        (8, "mysql-secondary-7", "10.0.0.18", 33068),
        (9, "mysql-secondary-8", "10.0.0.19", 33069),
        (10, "mysql-secondary-9", "10.0.0.20", 33070),
    ]


def test_plan_makes_no_new_credential_difference(spark):
    nodes = fleet(spark).withColumn("credential_hash", F.lit("h"))
    targets = spark.createDataFrame(
        [(c, 9, "10.0.0", "net", "h") for c in range(1, 7)],
        "cluster_id long, target int, docker_base_ip string, docker_network string, credential_hash string",
    )
    after = ops.apply_scale_plan(ops.scale_plan(targets, nodes), nodes)
    assert audit.credential_mismatches(after, targets).count() == 0
    added = ops.plan_additions(ops.scale_plan(targets, nodes)).first()
    assert (added.docker_network, added.ssh_port, added.credential_hash) == ("net", 22, "h")


def test_more_remote_hosts_than_slots(spark):
    requests = spark.createDataFrame([(1, 2, "10.0.0", "net", "h"), (2, 3, "10.0.0", "net", "h"), (3, 0, "10.0.0", "net", "h")], "cluster_id long, count int, docker_base_ip string, docker_network string, credential_hash string")
    hosts = spark.createDataFrame(
        [(1, i, f"h{i}", "ops", None) for i in range(4)] + [(2, 0, "", "ops", "/k")],
        "cluster_id long, pos int, host string, ssh_user string, ssh_key_path string",
    )
    rows = ops.allocate_remote_first(requests, hosts).orderBy("cluster_id", "slot").collect()
    assert [(r.cluster_id, r.hostname, r.host, r.node_type, r.node_id) for r in rows] == [
        (1, "h0", "h0", fv.TYPE_REMOTE, 2),
        (1, "h1", "h1", fv.TYPE_REMOTE, 3),
        (2, "secondary-1", "127.0.0.1", fv.TYPE_REMOTE, 2),
        (2, "mysql-secondary-2", "127.0.0.1", fv.TYPE_CONTAINER, 3),
        (2, "mysql-secondary-3", "127.0.0.1", fv.TYPE_CONTAINER, 4),
    ]


def test_allocation_continues_behind_present_nodes(spark):
    requests = spark.createDataFrame([(1, 1, "10.0.0", "net", "h"), (9, 1, "10.0.0", "net", "h")], "cluster_id long, count int, docker_base_ip string, docker_network string, credential_hash string")
    hosts = spark.createDataFrame([], "cluster_id long, pos int, host string, ssh_user string, ssh_key_path string")
    rows = ops.allocate_remote_first(requests, hosts, fleet(spark)).collect()
    assert {(r.cluster_id, r.node_id) for r in rows} == {(1, 7), (9, 2)}


def test_zero_server_id(spark):
    rows = [(5, 0, fv.TYPE_REMOTE, None), (6, None, fv.TYPE_CONTAINER, None), (7, 9, fv.TYPE_CONTAINER, "c")]
    frame = spark.createDataFrame(rows, "node_id int, server_id int, node_type string, container_name string")
    got = ops.node_defaults(frame).orderBy("node_id").collect()
    assert [(r.server_id, r.effective_server_id, r.container_name) for r in got] == [
        (0, 5, None),
        (6, 6, "mysql-node-6"),
        (9, 9, "c"),
    ]


def test_seeds_in_order_over_several_pieces(spark):
    rows = [(1, p, f"n{p}", None if p % 2 else f"a{p}") for p in range(20)]
    random.Random(3).shuffle(rows)
    frame = spark.createDataFrame(rows, "cluster_id long, pos int, hostname string, local_address string")
    seeds = ops.group_seeds(frame, width=3).first().group_seeds
    assert seeds == ",".join(f"n{p}:3306" if p % 2 else f"a{p}" for p in range(20))


def test_audit_of_addresses_and_credentials(spark):
    rows = [(1, i, i + 1, i + 1, "127.0.0.1", 33060 + i, f"10.0.0.{11 + i}", None, "x") for i in range(240, 250)]
    nodes = spark.createDataFrame(
        rows,
        "cluster_id long, pos int, node_id int, server_id int, host string, port int, docker_ip string, "
        "container_name string, credential_hash string",
    )
    clusters = spark.createDataFrame([(1, "x")], "cluster_id long, credential_hash string")
    findings = audit.identity_audit(nodes, clusters).collect()
    assert {r.finding for r in findings} == {"octet_overflow"}
    assert sorted(r.first_pos for r in findings) == [245, 246, 247, 248, 249]
    other = spark.createDataFrame([(1, None)], "cluster_id long, credential_hash string")
    assert audit.credential_mismatches(nodes, other).count() == 10
