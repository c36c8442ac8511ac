"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all rows to learn from. The weights are fitted by
follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty, whose first-norm part
keeps them sparse, on a bounded sample; a part of the sample is set apart to calibrate one
temperature, so that the score is a probability. Prediction is one pass over whole texts without a
shuffle. N-grams are hashed, which bounds the model to ``2**bits`` rows whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.text_features import char_ngrams, lists_of

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    classes: list[str]
    #: (2**bits, classes): weights times inverse document frequency.
    weights: np.ndarray
    idf: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int


def _frequencies(rows: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """(documents that hold each bucket, documents). One count vector leaves each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                held[char_ngrams(text.as_py(), bits)[0]] += 1
                documents += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(held[at], documents))],
            names=["bucket", "n"],
        )

    found = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket")
    counts = found.agg(F.sum("n").alias("n")).toPandas()  # 2**bits + 1 rows at most
    counts = dict(zip(counts["bucket"], counts["n"]))
    documents = int(counts.pop(-1, 0))
    held = np.zeros(1 << bits)
    held[list(counts)] = list(counts.values())
    return held, documents


def _sample(rows: DataFrame, classes: dict[str, int], most: int, bits: int):
    """[(class, buckets, counts)] of at most ``most`` rows, as many of each class as there are.

    Rows are drawn by a hash. A first cut by a fraction of each class, four times what is wanted,
    keeps the ranking small.
    """
    each = max(1, most // max(1, len(classes)))
    share = F.lit(0.0)
    for name, n in classes.items():
        share = F.when(F.col("label") == name, F.lit(min(1.0, 4 * each / n + 1e-6))).otherwise(share)
    drawn = rows.withColumn("draw", F.xxhash64("key", "text")).filter(
        F.pmod(F.col("draw"), F.lit(1 << 30)) < share * (1 << 30)
    )
    ranked = drawn.withColumn(
        "rank", F.row_number().over(Window.partitionBy("label").orderBy("draw", "key"))
    ).filter(F.col("rank") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [char_ngrams(t.as_py(), bits) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([a.astype(np.int32) for a, _ in pairs], pa.list_(pa.int32())),
                    pa.array([c.astype(np.int32) for _, c in pairs], pa.list_(pa.int32())),
                ],
                names=["label", "draw", "at", "n"],
            )

    found = (
        ranked.select("label", "draw", "text")
        .mapInArrow(run, "label string, draw long, at array<int>, n array<int>")
        .toArrow()  # bounded by ``most`` rows
    )
    labels, draws = found["label"].to_pylist(), found["draw"].to_pylist()
    places, counts = lists_of(found["at"]), lists_of(found["n"])
    order = sorted(range(len(labels)), key=lambda i: (draws[i], labels[i], len(places[i])))
    return [(labels[i], places[i], counts[i]) for i in order]


def _scaled(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    return x / (np.linalg.norm(x) or 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    examples: list[tuple[int, np.ndarray, np.ndarray]],
    size: int,
    classes: int,
    epochs: int = 4,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
) -> np.ndarray:
    """(size, classes) weights after ``epochs`` passes of FTRL-proximal, one example at a time."""
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for label, at, x in examples:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            error = _softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
    return weights(z, n)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / t)[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, golden = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(
    rows: DataFrame,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    bits: int = 15,
    sample_rows: int = 3000,
    class_rows: int = 50,
    most_classes: int = 256,
    calibration_share: float = 0.2,
) -> LanguageModel:
    """Learn from all rows with a text and a label.

    Document frequencies come from all of these rows; the weights from a hashed sample of at most
    ``sample_rows`` of them, or ``class_rows`` for each label if that is more, spread evenly over all
    labels. Every label is learned; more than ``most_classes`` fail, as the model would not fit. ``key`` only
    takes part in the draw of the sample. Without rows to learn from the model has no class
    and predicts ``und`` for every text.
    """
    known = rows.select(
        F.col(text).cast("string").alias("text"),
        F.col(label).cast("string").alias("label"),
        F.col(key).cast("string").alias("key"),
    ).filter("text is not null and label is not null")
    counted = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    classes = {r["label"]: r["n"] for r in counted.limit(most_classes + 1).collect()}
    if len(classes) > most_classes:
        raise ValueError(f"more than {most_classes} labels to learn")
    sample_rows = max(sample_rows, class_rows * len(classes))
    names, size = sorted(classes), 1 << bits
    if not names:
        empty = np.zeros((size, 0), np.float32)
        return LanguageModel([], empty, np.ones(size), np.zeros(0), 1.0, bits)
    held, documents = _frequencies(known, bits)
    idf = np.log((1 + documents) / (1 + held)) + 1
    number = {name: i for i, name in enumerate(names)}
    # The last row of the weights is the bias.
    examples = [
        (number[name], np.append(at, size), np.append(_scaled(n, idf[at]), 1.0))
        for name, at, n in _sample(known, classes, sample_rows, bits)
    ]
    apart = round(len(examples) * calibration_share)
    weights = ftrl(examples[apart:] or examples, size + 1, len(names))
    logits = np.array([x @ weights[at] for _, at, x in examples[:apart]]).reshape(-1, len(names))
    labels = np.array([i for i, _, _ in examples[:apart]], np.int64)
    temperature = _temperature(logits, labels)
    return LanguageModel(
        names, weights[:size].astype(np.float32), idf, weights[size], temperature, bits
    )


def predict(
    rows: DataFrame,
    model: LanguageModel,
    text: str = "text",
    out: str = "lang_pred",
    score: str = "score",
) -> DataFrame:
    """``rows`` with the predicted label and its calibrated probability.

    A text that is null or has no letter is ``und`` with score 0. Only the text decides, so equal
    texts have equal predictions; other columns stay, columns with the two output names are replaced,
    repeated rows are predicted each, an empty table stays empty.
    """
    shared = rows.sparkSession.sparkContext.broadcast(
        (model.classes, model.weights, model.idf, model.bias, model.temperature, model.bits)
    )

    @F.arrow_udf("struct<label string, score double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classes, weights, idf, bias, temperature, bits = shared.value
        letter = regex.compile(r"\p{L}")
        for batch in batches:
            labels, scores = [], []
            for value in batch:
                body = value.as_py()
                if not classes or body is None or not letter.search(body):
                    labels.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                at, n = char_ngrams(body, bits)
                p = _softmax((_scaled(n, idf[at]) @ weights[at] + bias) / temperature)
                best = int(p.argmax())
                labels.append(classes[best])
                scores.append(float(p[best]))
            yield pa.StructArray.from_arrays(
                [pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                names=["label", "score"],
            )

    found = rows.withColumn("_language", run(F.col(text).cast("string")))
    return found.withColumns(
        {out: F.col("_language.label"), score: F.col("_language.score")}
    ).drop("_language")
