"""Hard negatives of anchors by Fagin's threshold algorithm on integer vectors.

A block holds a bounded number of rows and, for each dimension, their order by that component. An
anchor reads each list from the end that its own component's sign makes best. What comes up is scored
at once with all of its components (random access), and what is still unread cannot score above the
threshold, the sum of the anchor's products with the last components read. Reading ends as soon as
the threshold falls strictly below the k-th score of everything asked for, so that no tie is missed.

Two passes: the best rows of the anchor's own label give its positives, whose scores set a window for each
of them; then the best rows of other labels inside each window. Every anchor meets every block, in cells
of a block and a group of anchors; only the best few rows of each cell are shuffled on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import work_folder

#: Components in a block, and in a group of anchors.
BLOCK_VALUES = 1 << 19
ANCHOR_VALUES = 1 << 20
#: Rows read from each list before the threshold is looked at first; then twice as many, and so on.
FIRST_DEPTH = 16


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null if any component is null or not finite."""
    good = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return F.when(good, whole)


class Block:
    """Rows with their components and, for each dimension, their order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.peak = int(np.abs(vectors).max(initial=0))
        self.singles = vectors.astype(np.float32)
        self.orders: dict[object, tuple[np.ndarray, np.ndarray]] = {}

    def lists(self, label: object = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of one label, or all, and for each dimension those rows by rising component."""
        if label not in self.orders:
            own = np.arange(len(self.ids)) if label is None else np.flatnonzero(self.labels == label)
            order = np.argsort(self.vectors[own], axis=0, kind="stable").T
            self.orders[label] = own, np.ascontiguousarray(own[order])
        return self.orders[label]

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products, exact: in single precision where every sum fits into its 24 bits."""
        bound = self.peak * int(np.abs(anchor).sum())
        if bound < 1 << 24:
            return (self.singles[rows] @ anchor.astype(np.float32)).astype(np.int64)
        if bound < 1 << 62:
            return self.vectors[rows] @ anchor
        raise OverflowError("scores do not fit into 64 bits")

    def read(self, anchor: np.ndarray, label: object = None) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """(new rows, their scores, threshold), deeper each time; the last threshold is null, as all is read."""
        own, lists = self.lists(label)
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        size, depth, step = len(own), 0, FIRST_DEPTH
        seen, scored = np.zeros(len(self.ids), bool), np.zeros(len(self.ids), bool)
        while depth < size:
            deep = min(size, depth + step)
            if len(up) + len(down) == 0 or deep == size:
                seen[own] = True
                deep = size
            seen[lists[up, depth:deep]] = True
            seen[lists[down, size - deep : size - depth]] = True
            new = np.flatnonzero(seen & ~scored)
            scored |= seen
            last = np.append(
                self.vectors[lists[up, deep - 1], up] * anchor[up],
                self.vectors[lists[down, size - deep], down] * anchor[down],
            )
            yield new, self.scores(new, anchor), int(last.sum()) if deep < size else None
            depth, step = deep, step * 2


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, equal ones by the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def best_of_label(block: Block, anchor_id: int, anchor: np.ndarray, label: object, k: int):
    """(ids, scores) of the ``k`` best rows of the anchor's label, the anchor itself left out."""
    ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for new, found, threshold in block.read(anchor, label):
        other = block.ids[new] != anchor_id
        ids, scores = np.append(ids, block.ids[new][other]), np.append(scores, found[other])
        best = _best(ids, scores, k)
        ids, scores = ids[best], scores[best]
        if threshold is None or len(ids) == k and threshold < scores[-1]:
            break
    return ids, scores


def best_in_windows(
    block: Block, anchor: np.ndarray, label: object, lows: list[int], highs: list[int], k: int
):
    """For each window (low, high) the (ids, scores) of the ``k`` best rows of other labels in it."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in lows]
    open_ = [i for i, (low, high) in enumerate(zip(lows, highs)) if low <= high]
    for new, scores, threshold in block.read(anchor) if open_ else ():
        near = (scores >= min(lows[i] for i in open_)) & (scores <= max(highs[i] for i in open_))
        near &= block.labels[new] != label
        new, scores = block.ids[new[near]], scores[near]
        for i in list(open_):
            inside = (scores >= lows[i]) & (scores <= highs[i])
            ids, own = np.append(found[i][0], new[inside]), np.append(found[i][1], scores[inside])
            best = _best(ids, own, k)
            found[i] = ids[best], own[best]
            # The k-th score of the window; while it has fewer rows, its lower edge.
            kth = int(own[best][-1]) if len(best) == k else lows[i]
            if threshold is None or threshold < kth:
                open_.remove(i)
        if not open_:
            break
    return found


def _cells(rows: DataFrame, anchors: DataFrame, blocks: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Rows and anchors of each cell: a number of components, a block of rows and a part of the anchors."""

    def dealt(table: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        number = F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return table.withColumn(own, number).withColumn(other, every)

    return dealt(rows, "block", blocks, "part", parts), dealt(anchors, "part", parts, "block", blocks)


CELL = ("dim", "block", "part")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim).astype(np.int64)


def _block(rows: pa.Table, dim: int) -> Block:
    return Block(
        rows["vec_id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["vector"], dim)
    )


def _run(rows: DataFrame, anchors: DataFrame, search, schema: str) -> DataFrame:
    keys = list(CELL)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            dim = left["dim"][0].as_py()
            block, vectors = _block(left, dim), _matrix(right["vector"], dim)
            others = right.drop_columns(["vector"]).to_pylist()
            for anchor, vector in zip(others, vectors):
                out += search(block, anchor, vector)
        names = [field.split()[0] for field in schema.split(", ")]
        columns = list(zip(*out)) if out else [[] for _ in names]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return rows.groupBy(*keys).cogroup(anchors.groupBy(*keys)).applyInArrow(cell, schema)


def _first(rows: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "vector",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all anchors.

    ``vector`` holds integers (see ``quantized``), ``key`` and ``label`` are integers; a score is the inner
    product with the anchor. An anchor's positives are the ``positives`` best other rows of its label;
    for each of them the ``negatives`` best rows of other labels with ``low`` * positive score <= 100 *
    score <= ``high`` * positive score, equal scores by the smaller key. Where there are fewer,
    all are returned, and none if there is none.

    Rows with a null key, label, vector or component take no part. A key names one row: of rows with equal keys
    the one with the greatest label, then vector, takes part, so repeated rows count once. Rows meet rows
    with as many components only. Other columns are ignored; an empty table gives no rows.
    """
    known = (
        rows.select(
            F.col(key).cast("long").alias("vec_id"),
            F.col(label).cast("long").alias("label"),
            F.col(vector).cast("array<bigint>").alias("vector"),
            is_anchor.alias("_anchor"),
        )
        .filter(
            F.col("vec_id").isNotNull()
            & F.col("label").isNotNull()
            & F.col("vector").isNotNull()
            & ~F.exists("vector", lambda x: x.isNull())
        )
        .groupBy("vec_id")
        .agg(F.max(F.struct("label", "vector", "_anchor")).alias("_r"))
        .select("vec_id", "_r.*")
        .withColumn("dim", F.size("vector"))
    )
    folder = work_folder(rows.sparkSession, "hard-negatives")
    known.write.parquet(f"{folder}/rows")

    def stored() -> DataFrame:
        return rows.sparkSession.read.schema(known.schema).parquet(f"{folder}/rows")

    points, anchors = stored().drop("_anchor"), stored().filter("_anchor").drop("_anchor")
    held, asked = stored().agg(F.sum("dim"), F.sum(F.when(F.col("_anchor"), F.col("dim")))).first()
    cells = -(-(held or 1) // BLOCK_VALUES) or 1, -(-(asked or 1) // ANCHOR_VALUES) or 1

    def own_label(block: Block, anchor: dict, vector: np.ndarray) -> list[tuple]:
        ids, scores = best_of_label(block, anchor["vec_id"], vector, anchor["label"], positives)
        return [(anchor["vec_id"], int(i), int(s)) for i, s in zip(ids, scores)]

    met = _run(*_cells(points, anchors, *cells), own_label, "anchor_id long, positive_id long, positive_score long")
    chosen = _first(met, ["anchor_id"], "positive_score", "positive_id", positives)
    windows = chosen.groupBy("anchor_id").agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("windows")
    )
    asking = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")

    def other_labels(block: Block, anchor: dict, vector: np.ndarray) -> list[tuple]:
        scores = [w["positive_score"] for w in anchor["windows"]]
        # In whole numbers: the least score at or above low %, the greatest at or below high %.
        lows, highs = [-(-low * s // 100) for s in scores], [high * s // 100 for s in scores]
        found = best_in_windows(block, vector, anchor["label"], lows, highs, negatives)
        return [
            (anchor["vec_id"], w["positive_id"], w["positive_score"], int(i), int(s))
            for w, (ids, own) in zip(anchor["windows"], found)
            for i, s in zip(ids, own)
        ]

    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _run(*_cells(points, asking, *cells), other_labels, schema)
    ranked = _first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
