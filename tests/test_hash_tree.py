import random
from collections import Counter

import pytest

from fleetlens.operators import hash_tree

ROW = "id long, label string"
EDGE = (1 << 63) - 1


def make(seed):
    seeded = random.Random(seed)
    rows = [(seeded.randrange(-300, 300), seeded.choice(["a", "b", None])) for _ in range(200)]
    rows += [(None, "n"), (None, None), (EDGE, "e"), (-EDGE - 1, "e")] + rows[:20]
    changed = [r for r in rows if seeded.random() > 0.02]
    changed += [(seeded.randrange(-300, 900), "new") for _ in range(3)]
    return rows, changed


def brute(left, right, width):
    a, b = ({n: Counter(r for r in side if node(r, width) == n) for n in {node(r, width) for r in side}} for side in (left, right))
    return {
        (n, sum(a.get(n, Counter()).values()), sum(b.get(n, Counter()).values()))
        for n in a.keys() | b.keys() if a.get(n) != b.get(n)
    }


def node(row, width):
    return None if row[0] is None else row[0] // width


def frames(spark, *tables):
    return [spark.createDataFrame(rows, ROW) for rows in tables]


def tree(frame, width, fanout, height):
    return hash_tree.grow(hash_tree.leaf_hashes(frame, "id", width), fanout, height)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("height", [0, 3])
def test_differing_ranges(spark, tmp_path, seed, height):
    left, right = make(seed)
    trees = [
        hash_tree.store_tree(tree(frame, 7, 4, height), str(tmp_path / str(n)))
        for n, frame in enumerate(frames(spark, left, right))
    ]
    found = hash_tree.differing_ranges(*trees, 4, height).collect()
    assert {tuple(r) for r in found} == brute(left, right, 7)
    assert len(found) == len(set(found))
    assert hash_tree.differing_ranges(trees[0], trees[0], 4, height).isEmpty()


def test_empty_and_missing_sides(spark):
    full, empty = frames(spark, [(5, "a"), (None, "b")], [])
    pair = [tree(f, 10, 4, 2) for f in (full, empty)]
    assert {tuple(r) for r in hash_tree.differing_ranges(*pair, 4, 2).collect()} == {(0, 1, 0), (None, 1, 0)}
    assert hash_tree.differing_ranges(pair[1], pair[1], 4, 2).isEmpty()


def test_rows_of_ranges(spark, tmp_path):
    rows, _ = make(3)
    spark.createDataFrame(rows, ROW).write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    few = spark.createDataFrame([(0,), (1,), (-3,), (None,)], "node long")
    many = spark.createDataFrame([(n,) for n in range(-200, 200, 2)], "node long")
    for ranges in (few, many):
        nodes = {r.node for r in ranges.collect()}
        kept = hash_tree.in_ranges(stored, "id", 7, ranges)
        assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if node(r, 7) in nodes)
    one = hash_tree.in_ranges(stored, "id", 7, few.filter("node = 0"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,0), LessThanOrEqual(id,6)" in plan
    merged = hash_tree.stretches(few, 7).collect()
    assert {tuple(r) for r in merged} == {(0, 13), (-21, -15)}


def parts(tmp_path, version):
    return {p.name for p in (tmp_path / "copy" / "rows" / f"_version={version}").glob("_part=*")}


def copied(copy, spark):
    return Counter(map(tuple, copy.read(spark).collect()))


def test_only_changed_ranges_are_copied(spark, tmp_path):
    rows, _ = make(4)
    frame = spark.createDataFrame(rows, ROW)
    copy = hash_tree.RangedCopy(str(tmp_path / "copy"), frame.schema, "id", 50)
    assert copied(copy, spark) == Counter()
    copy.update(frame, hash_tree.leaf_hashes(frame, "id", 50))
    assert copied(copy, spark) == Counter(rows)
    later = [r for r in rows if r[0] is None or not 100 <= r[0] < 150] + [(7, "late")]
    changed = spark.createDataFrame(later, ROW)
    copy.update(changed, hash_tree.leaf_hashes(changed, "id", 50))
    assert copied(copy, spark) == Counter(later)
    assert parts(tmp_path, 2) == {"_part=0"}
    copy.update(changed, hash_tree.leaf_hashes(changed, "id", 50))
    assert parts(tmp_path, 3) == set()


def test_stopped_copy_goes_on(spark, tmp_path, monkeypatch):
    rows, _ = make(5)
    frame = spark.createDataFrame(rows, ROW)
    leaves = hash_tree.leaf_hashes(frame, "id", 50)
    copy = hash_tree.RangedCopy(str(tmp_path / "copy"), frame.schema, "id", 50)
    work = copy._copy
    calls = []

    def fails(*arguments):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        work(*arguments)

    monkeypatch.setattr(copy, "_copy", fails)
    with pytest.raises(RuntimeError):
        copy.update(frame, leaves, steps=3)
    kept = {r.node for r in copy.ranges(spark).collect()}
    monkeypatch.undo()
    copy.update(frame, leaves, steps=3)
    assert copied(copy, spark) == Counter(rows)
    first = {r.node for r in copy.ranges(spark).filter("version = 1").collect()}
    assert kept == first and len(kept) < copy.ranges(spark).count()


def test_wrong_leaves_are_refused(spark, tmp_path):
    a, b = frames(spark, [(1, "a")], [(1, "b")])
    copy = hash_tree.RangedCopy(str(tmp_path / "copy"), a.schema, "id", 10)
    with pytest.raises(ValueError):
        copy.update(a, hash_tree.leaf_hashes(b, "id", 10))
    assert copied(copy, spark) == Counter()
