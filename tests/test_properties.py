"""Seeded random inputs: round trips and exact counts."""

import json
import random

import pytest

from fleetlens import fixed_values as fv
from fleetlens.operators import nodes as ops
from fleetlens.sources import documents

TEXTS = ["a", "", "ü✓", 'quo"te', "back\\slash", "line\nbreak", "x,]}", None]


def random_node(seeded, role):
    node = {
        "node_id": seeded.randrange(1000),
        "hostname": seeded.choice(TEXTS[:-1]),
        "role": role,
        "node_type": seeded.choice(fv.NODE_TYPES),
    }
    optional = [k for k in fv.NODE_KEYS if k not in node and k != fv.NODE_SECRET_KEY]
    for key in seeded.sample(optional, seeded.randrange(len(optional))):
        number = key in fv.NODE_INT_KEYS
        node[key] = seeded.choice([None, 0, 7, 65535]) if number else seeded.choice(TEXTS)
    return node


def python_node(node):
    defaults = fv.node_record_defaults("net")
    full = {k: node.get(k, defaults.get(k)) for k in fv.NODE_KEYS if k != fv.NODE_SECRET_KEY}
    if full["server_id"] is None:
        full["server_id"] = full["node_id"]
    if full["container_name"] is None and full["node_type"] == fv.TYPE_CONTAINER:
        full["container_name"] = f"mysql-node-{full['node_id']}"
    return tuple(full.values())


@pytest.mark.parametrize("seed", range(3))
def test_written_documents_read_back_the_same(spark, tmp_path, seed):
    seeded = random.Random(seed)
    docs, expected = [], {}
    for i in range(40):
        doc = {"cluster_name": f"c{i}"}
        for key in seeded.sample(fv.DOCUMENT_KEYS[1:], 6):
            doc[key] = seeded.choice([True, False]) if key == "use_custom_image" else seeded.choice(TEXTS)
        if seeded.random() < 0.7:
            doc["primary"] = seeded.choice([None, {}, random_node(seeded, "primary")])
        if seeded.random() < 0.8:
            doc["secondaries"] = [random_node(seeded, "secondary") for _ in range(seeded.randrange(12))]
        docs.append((f"c{i}", json.dumps(doc)))
        if doc.get("primary"):
            expected[f"c{i}", 0] = python_node(doc["primary"])
        for pos, node in enumerate(doc.get("secondaries", []), 1):
            expected[f"c{i}", pos] = python_node(node)
    raw = spark.createDataFrame(docs, "cluster_id string, doc string")
    first = documents.decode_documents(raw, "engine", "salt", "net")
    good, rejected = documents.decode_nodes(first, "salt", "net")
    assert rejected.count() == 0
    columns = [k for k in fv.NODE_KEYS if k != fv.NODE_SECRET_KEY]

    def as_dict(nodes):
        return {(r.cluster_id, r.pos): tuple(r[c] for c in columns) for r in nodes.collect()}

    assert as_dict(good) == expected
    out = str(tmp_path / "out")
    documents.encode_cluster_docs(first, good, width=5).select("doc").write.text(out)
    again = documents.load_cluster_docs(spark, out, "engine", "salt", "net", one_per_line=True)
    named = again.withColumn("cluster_id", again.cluster_name)
    assert as_dict(documents.decode_nodes(named, "salt", "net")[0]) == expected
    assert sorted(map(str, again.select(fv.DOCUMENT_KEYS).collect())) == sorted(
        map(str, first.select(fv.DOCUMENT_KEYS).collect())
    )


@pytest.mark.parametrize("seed", range(3))
def test_plans_and_allocations_give_exact_counts(spark, seed):
    seeded = random.Random(seed)
    rows, targets = [], []
    for cluster in range(30):
        for pos in range(1, seeded.randrange(1, 40)):
            kind = seeded.choice([fv.TYPE_CONTAINER, fv.TYPE_REMOTE])
            rows.append((cluster, pos, pos + 1, fv.ROLE_SECONDARY, kind, "h", 1, None))
        targets.append((cluster, seeded.randrange(50), "10.0.0", "net", "h"))
    nodes = spark.createDataFrame(
        rows,
        "cluster_id long, pos int, node_id int, role string, node_type string, host string, port int, docker_ip string",
    )
    wanted = spark.createDataFrame(targets, "cluster_id long, target int, docker_base_ip string, docker_network string, credential_hash string")
    plan = ops.scale_plan(wanted, nodes)
    after = ops.apply_scale_plan(plan, nodes)
    counted = {r.cluster_id: r["count"] for r in after.groupBy("cluster_id").count().collect()}
    for row in plan.collect():
        remote = sum(r[0] == row.cluster_id and r[4] == fv.TYPE_REMOTE for r in rows)
        assert row.current_count == max(row.target, remote) == counted.get(row.cluster_id, 0)
    assert after.groupBy("cluster_id", "pos").count().filter("count > 1").count() == 0
    hosts = spark.createDataFrame(
        [(c, p, f"h{p}", "ops", None) for c in range(30) for p in range(seeded.randrange(20))],
        "cluster_id long, pos int, host string, ssh_user string, ssh_key_path string",
    )
    slots = ops.allocate_remote_first(wanted.withColumnRenamed("target", "count"), hosts)
    filled = {r.cluster_id: r["count"] for r in slots.groupBy("cluster_id").count().collect()}
    assert filled == {c: n for c, n, *_ in targets if n}
