import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import hard_negatives as hn


def naive(rows, anchors, low=80, high=100, k=5):
    """``rows``: {id: (label, vector)}."""
    out = []
    for a in anchors:
        label, vector = rows[a]
        score = {
            i: sum(x * y for x, y in zip(v, vector)) for i, (_, v) in rows.items() if i != a and len(v) == len(vector)
        }
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if rows[i][0] == label][:k]:
            inside = [
                i for i in best if rows[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]
            ]
            out += [(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(inside[:k])]
    return sorted(out)


def mined(spark, rows, **settings):
    frame = spark.createDataFrame(
        [(i, l, v) for i, (l, v) in rows.items()], "vec_id long, label int, vector array<long>"
    )
    return sorted(tuple(r) for r in hn.mine(frame, F.col("vec_id") % 10 == 0, **settings).collect())


def made(seed, n, dim, width, labels):
    rng = random.Random(seed)
    return {i: (rng.randrange(labels), [rng.randint(-width, width) for _ in range(dim)]) for i in range(n)}


@pytest.mark.parametrize("seed, n, dim, width, labels", [(1, 200, 4, 2, 3), (2, 300, 16, 200, 2), (3, 60, 1, 1, 2), (4, 40, 3, 0, 2)])
def test_all_negatives_are_those_of_brute_force(spark, monkeypatch, seed, n, dim, width, labels):
    # Small blocks and groups, so that the best of several cells are merged; narrow vectors tie often.
    monkeypatch.setattr(hn, "BLOCK_VALUES", 64 * dim)
    monkeypatch.setattr(hn, "ANCHOR_VALUES", 8 * dim)
    rows = made(seed, n, dim, width, labels)
    assert mined(spark, rows) == naive(rows, [i for i in rows if i % 10 == 0])


def test_other_windows_and_large_components(spark):
    rows = {i: (i % 2, [v * 10**7 for v in x]) for i, (_, x) in made(5, 80, 6, 9, 2).items()}
    got = mined(spark, rows, low=50, high=90, positives=2, negatives=3)
    anchors = [i for i in rows if i % 10 == 0]
    expected = [r for r in naive(rows, anchors, 50, 90, 80) if r[2] <= 3]
    best = {a: sorted({(-r[4], r[1]) for r in naive(rows, anchors, -(10**9), 10**9, 80) if r[0] == a}) for a in anchors}
    tops = {a: {p for _, p in sorted((-sum(x * y for x, y in zip(v, rows[a][1])), i) for i, (l, v) in rows.items() if i != a and l == rows[a][0])[:2]} for a in anchors}
    assert best and got == [r for r in expected if r[1] in tops[r[0]]]


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-3, 4, (4000, 2))
    vectors[7] = 500, 400
    block = hn.Block(np.arange(4000), np.zeros(4000, np.int64), vectors)
    read = 0
    for new, scores, threshold in block.read(np.array([5, 4])):
        read += len(new)
        if threshold is not None and threshold < 500 * 5 + 400 * 4 and 7 in new:
            break
    assert 7 in new and read < 200
    ids, scores = hn.best_of_label(block, -1, np.array([5, 4]), 0, 1)
    assert ids.tolist() == [7] and scores.tolist() == [4100]


def test_threshold_never_lies_below_what_is_unread():
    rng = np.random.default_rng(4)
    block = hn.Block(np.arange(500), np.zeros(500, np.int64), rng.integers(-9, 10, (500, 5)))
    for anchor in rng.integers(-9, 10, (20, 5)):
        left = set(range(500))
        exact = block.vectors @ anchor
        for new, scores, threshold in block.read(anchor):
            assert (scores == exact[new]).all()
            left -= set(new.tolist())
            if threshold is not None and left:
                assert max(exact[list(left)]) <= threshold
        assert not left and threshold is None


def test_edge_cases(spark):
    schema = "vec_id long, label int, vector array<long>, dim string, block string"
    rows = [
        (0, 1, [1, 1], "", ""),
        (0, 1, [1, 1], "", ""),  # repeated
        (0, 0, [9, 9], "", ""),  # the smaller label of a key takes no part
        (1, 1, [2, 2], "", ""),
        (2, 2, [2, 2], "", ""),
        (3, 2, [2, 2], "", ""),  # ties by the smaller key
        (4, 2, [2, 2, 2], "", ""),  # another number of components
        (5, 2, None, "", ""),
        (6, 2, [2, None], "", ""),
        (7, None, [2, 2], "", ""),
        (None, 2, [2, 2], "", ""),
        (10, 3, [], "", ""),
        (11, 3, [], "", ""),
        (12, 4, [], "", ""),
    ]
    frame = spark.createDataFrame(rows, schema)
    anchor = F.col("vec_id") % 10 == 0
    assert sorted(tuple(r) for r in hn.mine(frame, anchor).collect()) == [
        (0, 1, 1, 2, 4, 4),
        (0, 1, 2, 3, 4, 4),
        (10, 11, 1, 12, 0, 0),
    ]
    assert hn.mine(frame.limit(0), anchor).count() == 0
    assert hn.mine(frame.filter("vec_id > 10"), anchor).count() == 0


def test_quantized(spark):
    rows = spark.createDataFrame(
        [(1, [0.5, -0.001]), (2, [float("nan")]), (3, [float("inf")]), (4, None), (5, [None]), (6, [])],
        "k int, v array<float>",
    )
    got = {r.k: r.q for r in rows.select("k", hn.quantized(F.col("v")).alias("q")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
