"""Toxicity as ordered severity grades: cumulative-link (proportional odds) regression.

``P(grade > k) = sigmoid(w x - threshold_k)``: one weight vector for all grades and rising
thresholds, so a feature that makes a text worse does so at every step. Features are the words of
the whole text and their prefixes, hashed to ``2**bits`` buckets; their values grow with the logarithm
of the count and fall with the cube root of the text's words. The weights are
fitted by FTRL-proximal and are never negative: harmless words around an insult take nothing away
from it. The first-norm penalty sets those harmless words to zero, so long texts do not drift.
Prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.text_features import lists_of, word_prefixes

#: Examples that are fitted at most; more fail.
MOST_EXAMPLES = 20_000


@dataclass(frozen=True)
class OrdinalModel:
    #: Buckets with a weight, and their weights.
    buckets: np.ndarray
    weights: np.ndarray
    #: Rising, one fewer than grades.
    thresholds: np.ndarray
    bits: int


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text; without letters there are none."""
    at, n, words = word_prefixes(text, bits)
    return at, 4 * np.log1p(n) / np.cbrt(max(1, words))


def fit_ordinal(
    examples: list[tuple[int, np.ndarray, np.ndarray]],
    size: int,
    grades: int,
    epochs: int = 12,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 1.0,
    l2: float = 0.05,
    threshold_rate: float = 0.05,
) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model; an example is (grade, buckets, values)."""
    z, n = np.zeros(size), np.zeros(size)
    counts = np.bincount([g for g, _, _ in examples], minlength=grades) + 0.5
    above = 1 - np.cumsum(counts)[:-1] / counts.sum()
    thresholds = -np.log(above / (1 - above))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(z >= -l1, 0.0, -(z + l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for epoch in range(epochs):
        for grade, at, x in examples:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            over = _sigmoid(w @ x - thresholds)  # P(grade > k)
            # P(grade) is the step between two neighbouring values of ``over``.
            upper = 1.0 if grade == 0 else over[grade - 1]
            lower = 0.0 if grade == grades - 1 else over[grade]
            p = max(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            g = (dl - du) * x  # of the negative log likelihood
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
            step = threshold_rate / (1 + epoch)
            if grade > 0:
                thresholds[grade - 1] -= step * du
            if grade < grades - 1:
                thresholds[grade] += step * dl
            thresholds = np.maximum.accumulate(thresholds + 1e-6 * np.arange(grades - 1))
    return weights(z, n), thresholds


def fit(
    rows: DataFrame,
    text: str = "text",
    grade: str = "grade",
    key: str = "doc_id",
    grades: int = 3,
    bits: int = 18,
    **settings: float,
) -> OrdinalModel:
    """Learn grades 0 .. ``grades`` - 1 from all of ``rows``, a bounded sample made by ``draw``.

    ``key`` only settles the order of the examples. Rows with a null text or grade are no examples.
    Without examples the model finds every text to have grade 0.
    """
    examples = _examples(rows, text, grade, key, bits)
    if not examples:
        return OrdinalModel(
            np.empty(0, np.int64), np.empty(0), np.full(grades - 1, 40.0), bits
        )
    weights, thresholds = fit_ordinal(examples, 1 << bits, grades, **settings)
    at = np.flatnonzero(weights)
    return OrdinalModel(at, weights[at], thresholds, bits)


def fit_flags(
    rows: DataFrame,
    text: str = "text",
    flag: str = "toxic",
    key: str = "doc_id",
    bits: int = 18,
    **settings: float,
) -> OrdinalModel:
    """Learn three grades where the labels only say toxic (1) or not (0), from a bounded sample.

    A feature that at least five examples hold, 95 % of them toxic, is a marker. A toxic example with
    more markers than the median toxic one gets grade 2, the others grade 1.
    """
    examples = _examples(rows, text, flag, key, bits)
    if not examples:
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), np.full(2, 40.0), bits)
    held = np.zeros((2, 1 << bits))
    for toxic, at, _ in examples:
        held[toxic, at] += 1
    marker = (held.sum(axis=0) >= 5) & (held[1] >= 0.95 * held.sum(axis=0))
    strength = [int(marker[at].sum()) for _, at, _ in examples]
    middle = np.median([s for s, (toxic, _, _) in zip(strength, examples) if toxic] or [0])
    graded = [(t + int(t and s > middle), at, x) for s, (t, at, x) in zip(strength, examples)]
    weights, thresholds = fit_ordinal(graded, 1 << bits, 3, **settings)
    at = np.flatnonzero(weights)
    return OrdinalModel(at, weights[at], thresholds, bits)


def draw(
    rows: DataFrame, grade: str, key: str = "doc_id", grades: int = 3, most: int = 6000
) -> DataFrame:
    """At most ``most`` of ``rows``: of each grade the ones first by a hash of ``key``, up to its share.

    Rows with a null grade are never drawn, a grade outside 0 .. ``grades`` - 1 fails. The result
    is bounded, so it may be broadcast to fetch texts. A first cut by a fraction, four times what
    is wanted, keeps the sorts small.
    """
    each = max(1, most // grades)
    known = rows.filter(F.col(grade).isNotNull()).withColumns(
        {"_grade": F.col(grade).cast("int"), "_draw": F.xxhash64(F.col(key).cast("string"))}
    )
    counted = known.groupBy("_grade").agg(F.count(F.lit(1)).alias("n")).limit(grades + 1).collect()
    counts = {r["_grade"]: r["n"] for r in counted}
    if bad := [g for g in counts if not 0 <= g < grades]:
        raise ValueError(f"grades outside 0..{grades - 1}: {bad[:5]}")
    drawn = known.limit(0)
    for g, n in sorted(counts.items()):
        share = min(1.0, 4 * each / n + 1e-6)
        part = known.filter(
            (F.col("_grade") == g)
            & (F.pmod(F.col("_draw"), F.lit(1 << 30)) < F.lit(share * (1 << 30)))
        )
        drawn = drawn.unionByName(part.orderBy("_draw").limit(each))
    return drawn.drop("_grade", "_draw")


def one_text(rows: DataFrame, grade: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of rows with equal keys the one whose text has the smallest hash, combined before the shuffle.

    Texts fetched for a sample of keys stay as many as the keys, however often a key is repeated.
    """
    first = F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t"), F.col(grade).alias("g")))
    return rows.groupBy(key).agg(first.alias("_f")).select(
        key, F.col("_f.t").alias(text), F.col("_f.g").alias(grade)
    )


def _examples(
    rows: DataFrame, text: str, grade: str, key: str, bits: int
) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(grade, buckets, values) of all ``rows`` with a text and a grade; ``rows`` is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py(), bits) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([at.astype(np.int32) for at, _ in found], pa.list_(pa.int32())),
                    pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32())),
                ],
                names=["grade", "draw", "at", "x"],
            )

    known = rows.select(
        F.col(grade).cast("int").alias("grade"),
        F.xxhash64(F.col(key).cast("string")).alias("draw"),
        F.col(text).cast("string").alias("text"),
    ).filter("grade is not null and text is not null")
    found = known.mapInArrow(run, "grade int, draw long, at array<int>, x array<float>")
    found = found.limit(MOST_EXAMPLES + 1).toArrow()
    if found.num_rows > MOST_EXAMPLES:
        raise ValueError(f"more than {MOST_EXAMPLES} examples; draw a sample first")
    grades, draws = found["grade"].to_pylist(), found["draw"].to_pylist()
    places, values = lists_of(found["at"]), lists_of(found["x"])
    order = sorted(range(len(draws)), key=lambda i: (draws[i], grades[i], len(places[i])))
    return [(grades[i], places[i], values[i]) for i in order]


def predict(
    rows: DataFrame,
    model: OrdinalModel,
    text: str = "text",
    severity: str = "severity",
    grade: str = "grade",
) -> DataFrame:
    """``rows`` with the expected severity (0 .. grades - 1) and the grade.

    The grade is the number of thresholds passed with probability one half or more. A null or empty
    text, or one without letters, has no features and gets the severity of the thresholds alone;
    equal texts get equal results. Other columns stay, columns with the two output names are
    replaced, an empty table stays empty.
    """
    shared = rows.sparkSession.sparkContext.broadcast(
        (model.buckets, model.weights, model.thresholds, model.bits)
    )

    @F.arrow_udf("struct<severity double, grade int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets, weights, thresholds, bits = shared.value
        dense = np.zeros(1 << bits)
        dense[buckets] = weights
        for batch in batches:
            pairs = (features(t.as_py() or "", bits) for t in batch)
            over = np.array([_sigmoid(dense[at] @ x - thresholds) for at, x in pairs])
            over = over.reshape(-1, len(thresholds))
            yield pa.StructArray.from_arrays(
                [
                    pa.array(over.sum(axis=1), pa.float64()),
                    pa.array((over >= 0.5).sum(axis=1).astype(np.int32)),
                ],
                names=["severity", "grade"],
            )

    found = rows.withColumn("_toxicity", run(F.col(text).cast("string")))
    return found.withColumns(
        {severity: F.col("_toxicity.severity"), grade: F.col("_toxicity.grade")}
    ).drop("_toxicity")
