import hashlib

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import multiset_hash as mh
from fleetlens.llm import ordered_neighbours, queries


def naive(text):
    """Count and lanes of a text's paragraphs."""
    total = [0] * (mh.LANES + 1)
    for line in (text or "").split("\n"):
        if not (p := line.strip(" \t\n\r\x0b\x0c")):
            continue
        digits = "".join(hashlib.sha512(f"{i}:{p}".encode()).hexdigest() for i in range(4))
        values = [int(digits[i : i + 8], 16) for i in range(0, 512, 8)]
        lanes = [1] + [(v >> 16 << 16) + (1 if v % 2 == 0 else 0xFFFF) for v in values]
        total = [(a + b) % (1 << 32) for a, b in zip(total, lanes)]
    return total


def likeness(a, b):
    if a == b:
        return 1.0
    low = [(x - y) % (1 << 16) for x, y in zip(a[1:], b[1:])]
    apart = sum((x - (1 << 16) if x >= 1 << 15 else x) ** 2 for x in low) / mh.LANES
    n = a[0] + b[0]
    return max(0.0, min(1.0, (n - apart) / (n + apart))) if n + apart else 0.0


TEXTS = [None, "", " \n\t\n", "a", "a\n", "a\nb", "b\n a \r\n", "a\na", "a\nb\nc", "ä\n\U0001f600", "\x1cx", "p\n" * 500]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    return mh.with_fingerprints(rows).persist()


def test_vectors(vectors):
    assert {r.k: r.vector for r in vectors.collect()} == {k: naive(t) for k, t in enumerate(TEXTS)}


def test_order_and_blank_lines_play_no_part(vectors):
    v = {r.k: r.f for r in vectors.select("k", mh.fingerprint(F.col("vector")).alias("f")).collect()}
    assert v[0] == v[1] == v[2] and v[3] == v[4] and v[5] == v[6]
    assert len({v[k] for k in (0, 3, 5, 7, 8, 9, 10, 11)}) == 8


def test_fingerprint_is_read_back(vectors):
    back = mh.from_fingerprint(mh.fingerprint(F.col("vector")))
    assert vectors.filter(back != F.col("vector")).count() == 0


def test_insert_and_delete(spark):
    rows = spark.createDataFrame(
        [("a\nb\nc", ["b"], ["d", "a"], "a\nd\na\nc"), ("a", ["a"], None, ""), ("", None, [], None)],
        "text string, gone array<string>, came array<string>, after string",
    )
    changed = mh.insert(mh.delete(mh.vector(F.col("text")), F.col("gone")), F.col("came"))
    assert rows.filter(changed != mh.vector(F.col("after"))).count() == 0


def test_likeness(spark):
    texts = {
        "base": "\n".join(f"line {i}" for i in range(40)),
        "half": "\n".join(f"line {i}" for i in range(20, 60)),
        "most": "\n".join(f"line {i}" for i in range(2, 42)),
        "none": "\n".join(f"other {i}" for i in range(40)),
        "turned": "\n".join(f"line {i}" for i in reversed(range(40))),
        "one": "line 1",
        "void": None,
    }
    rows = mh.with_fingerprints(spark.createDataFrame(list(texts.items()), "k string, text string"))
    pairs = rows.crossJoin(rows.toDF("l", "t", "other")).select(
        "k", "l", mh.likeness(F.col("vector"), F.col("other")).alias("x")
    )
    got = {(r.k, r.l): r.x for r in pairs.collect()}
    assert {k: pytest.approx(likeness(naive(texts[k[0]]), naive(texts[k[1]]))) for k in got} == got
    assert got["base", "turned"] == 1 and got["void", "void"] == 1 and got["one", "void"] == 0
    assert got["base", "none"] < 0.2 < got["base", "half"] < 0.5 < 0.8 < got["base", "most"] < 1
    assert all(got[a, b] == pytest.approx(got[b, a]) for a, b in got)


def follow(ids):
    order = sorted(ids, reverse=True)
    return {a: b for a, b in zip(order, order[1:] + order[:1])}


@pytest.mark.parametrize(
    "ids",
    [[5], list(range(3000)), [0, 1, 2, 9 * 10**18, -(9 * 10**18)], [i * i * i for i in range(400)]],
)
def test_next_rows(spark, monkeypatch, ids):
    monkeypatch.setattr(ordered_neighbours, "CHUNK_ROWS", 3)
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in ordered_neighbours.with_next(rows, "doc_id", ["text"]).collect()}
    assert got == {a: f"t{b}" for a, b in follow(ids).items()}


def test_next_rows_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(ordered_neighbours, "CHUNK_ROWS", 2)
    data = [(7, f"x{i}") for i in range(900)] + [(i, f"t{i}") for i in range(600) if i != 7] + [(None, "n"), (None, "n")]
    rows = spark.createDataFrame(data, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    given = [(r.doc_id, r.h, r.text) for r in rows.collect()]
    order = sorted(given, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1]), reverse=True)
    expected = sorted((str(a[0]), a[2], b[2]) for a, b in zip(order, order[1:] + order[:1]))
    got = ordered_neighbours.with_next(rows, "doc_id", ["text"]).collect()
    assert sorted((str(r.doc_id), r.text, r.next_text) for r in got) == expected
    keyed = rows.select(F.coalesce("doc_id", F.lit(-1)).alias("_key"), F.col("h").alias("_tie"))
    part = ordered_neighbours._chunk(keyed, "_key")[1]
    assert keyed.filter("_key = 7").select(part.alias("part")).distinct().count() > 50


def test_next_rows_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert ordered_neighbours.with_next(rows, "doc_id", ["text"]).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, folder, "documents").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op13_document_fingerprint"](spark, folder).collect()}
    assert got.keys() == docs.keys()
    for doc, after in follow(docs).items():
        text, other, row = docs[doc], docs[after], got[doc]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        v, e, n = naive(text), naive(edited), naive(other)
        assert row.fingerprint == "".join(f"{x:08x}" for x in v)
        assert row.edited_fingerprint == "".join(f"{x:08x}" for x in e)
        assert row.near_edited == pytest.approx(likeness(v, e))
        assert row.near_next == pytest.approx(likeness(v, n))


def test_native(spark):
    frame = queries.QUERIES["op13_document_fingerprint"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
