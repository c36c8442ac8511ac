import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from fleetlens.llm import exact_dedup


@given(st.sets(st.integers(0, 2**64 - 1), max_size=200))
def test_rice_round_trip(values):
    values = np.array(sorted(values), np.uint64)
    k, data = exact_dedup.rice_encode(values)
    assert (exact_dedup.rice_decode(len(values), k, data) == values).all()


def test_rice_is_small():
    values = np.unique(np.random.default_rng(1).integers(0, 2**40, 10_000).astype(np.uint64))
    assert len(exact_dedup.rice_encode(values)[1]) * 8 / len(values) < 40 - 13.3 + 2.5


def expected(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    return {
        t: (max((d for d in docs if d is not None), default=None), len(docs))
        for t, docs in groups.items()
    }


def check(spark, rows, parts=5, **settings):
    table = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, h string")
    found = exact_dedup.exact_duplicates(table.repartition(parts), **settings).collect()
    want = expected(rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert sorted(repr(r["doc_id"]) for r in found) == sorted(repr(d) for d, _ in rows)
    kept = defaultdict(int)
    for r in found:
        keep, size = sha[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (keep, size)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == keep
    assert all(kept[s] == 1 for s in sha)


def test_copies_nulls_and_repeated_rows(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "b"), (5, "b"), (6, "A"), (7, "a ")]
    rows += [(None, "only null"), (None, "only null"), (8, "é" * 50_000), (9, "é" * 50_000)]
    check(spark, rows)
    check(spark, rows, parts=1)


def test_hot_text_and_many_owners(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "hot" if i % 3 == 0 else f"t{rng.integers(0, 400)}") for i in range(1500)]
    check(spark, rows, parts=7, hashes_per_owner=100)


def test_empty(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    found = exact_dedup.exact_duplicates(table)
    assert found.count() == 0
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
