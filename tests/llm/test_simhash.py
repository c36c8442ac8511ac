import random

import pytest
import xxhash
from pyspark.sql import functions as F

from fleetlens.llm import components, queries, simhash


def naive(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    out = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return out - (1 << 64) if out >> 63 else out


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprint():
    rng = random.Random(1)
    texts = ["", None, " \t", "one", "ONE two", "É x\x0by Z", "a b c", "a b c d"]
    texts += [" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(n)) for n in (5, 40, 300)]
    assert [simhash.fingerprint_of(t) for t in texts] == [naive(t) for t in texts]


def test_shingle_hash_is_sparks(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b ñ")).alias("h")).first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest("a b ñ".encode(), 42)


def flipped(value, bits):
    for b in bits:
        value ^= 1 << b
    return value


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("radius,dense", [(3, 32), (3, 2), (2, 1), (1, 4), (5, 3)])
def test_links_are_all_links(spark, radius, dense):
    rng = random.Random(radius * 10 + dense)
    points = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(30):
            points.add(flipped(centre, rng.sample(range(64), rng.randint(0, 5))))
    # Many that share one half.
    low = rng.getrandbits(32)
    points |= {low | (rng.getrandbits(10) << 40) for _ in range(150)}
    points = sorted(signed(p) for p in points)
    table = spark.createDataFrame([(p,) for p in points], "fp long")
    found = {(r["a"], r["b"]) for r in simhash.links(table, radius=radius, dense=dense).collect()}
    want = {
        (a, b)
        for i, a in enumerate(points)
        for b in points[i + 1 :]
        if ((a ^ b) % (1 << 64)).bit_count() <= radius
    }
    assert found == want


def test_components(spark, tmp_path):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    pairs += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 40)]
    table = spark.createDataFrame(pairs, "a long, b long")
    found = components.connected_components(table, f"file://{tmp_path}/rounds")
    nodes = {n for a, b in pairs if a != b for n in (a, b)}
    rows = found.collect()
    assert len(rows) == len(nodes)
    assert {r["node"]: r["root"] for r in rows} == roots(nodes, [p for p in pairs if p[0] != p[1]])
    empty = components.connected_components(table.limit(0), f"file://{tmp_path}/none")
    assert empty.count() == 0


def test_groups_with_nulls(spark):
    rows = [(5, "a b c d e"), (3, "A b\tc d e"), (7, None), (9, " "), (None, "x y z"), (2, "other words")]
    rows += [(2, "other words")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    found = simhash.near_duplicates(table)
    got = sorted((repr(r["doc_id"]), repr(r["component_id"])) for r in found.collect())
    want = [(5, 3), (3, 3), (7, 7), (9, 7), (None, None), (2, 2), (2, 2)]
    assert got == sorted((repr(a), repr(b)) for a, b in want)
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents").collect()
    prints = {d["doc_id"]: naive(d["text"]) for d in docs}
    ids = sorted(prints)
    pairs = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if ((prints[a] ^ prints[b]) % (1 << 64)).bit_count() <= 3
    ]
    want = roots(ids, pairs)
    found = queries.QUERIES["op6_simhash"](spark, folder).collect()
    assert len(found) == len(ids)
    for r in found:
        assert r["fingerprint"] == f"{prints[r['doc_id']] % (1 << 64):016x}"
        assert r["component_id"] == want[r["doc_id"]]
