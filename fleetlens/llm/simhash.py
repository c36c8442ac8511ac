"""SimHash near-duplicate groups by multi-index hashing.

A 64-bit fingerprint per text; two fingerprints link when they differ in at most ``radius`` bits.
Fingerprints are cut into ``radius // 2 + 1`` segments, so that at least one segment of a linked pair
differs in one bit at most (pigeonhole). The index holds every fingerprint under its exact segment
values; a probe enumerates the Hamming ball of radius one around each of its own, fetches what the
index holds there and verifies the complete distance. Nothing is compared that does not share such
a segment.

A bucket with very many fingerprints (a large group of near copies whose fingerprints differ in the
other segments only) is indexed once more by pieces of the rest, again with balls of radius one
around the piece: the same pigeonhole one level down. This finds exactly the same links and keeps
the number of compared pairs close to the number of links.

Equal fingerprints are one node of the graph, so copies cost one row each and never pair up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import connected_components
from fleetlens.session import work_folder

BITS = 64
#: A bucket with more fingerprints than this is indexed by pieces of the other bits too.
DENSE_BUCKET = 32


def fingerprint_of(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of one text, as a signed 64-bit number.

    Words are runs without ASCII white space after lower-casing A-Z; a text with fewer than
    ``words`` words is one shingle, a text without words has fingerprint zero.
    """
    parts = (text or "").encode("utf-8").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    span = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (
            digest(joined[a:b], seed)
            for a, b in zip(starts[: len(parts) - span + 1].tolist(), ends[span - 1 :].tolist())
        ),
        "<u8",
        len(parts) - span + 1,
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(
    rows: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 3,
    seed: int = 42,
    out: str = "fp",
) -> DataFrame:
    """(``key``, ``out`` long): the SimHash of every whole text; a null text counts as empty."""
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            values = [fingerprint_of(t.as_py(), words, seed) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.int64())], names=[key, out]
            )

    return rows.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        run, f"`{key}` {kind.simpleString()}, `{out}` long"
    )


def _segments(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments of a fingerprint."""
    count = radius // 2 + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _cut(bits: Column, shift: int, width: int) -> Column:
    mask = (1 << width) - 1
    return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(mask if width < 64 else -1))


def _ball(value: Column, bits: Sequence[int]) -> Column:
    """``value`` and all values that differ from it in one of ``bits``."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in (0, *[1 << b for b in bits])])
    return F.transform(masks, lambda m: value.bitwiseXOR(m))


def _tagged(values: Column, number: int, tag: str, name: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(number).alias(tag), v.alias(name)))


def links(points: DataFrame, fp: str = "fp", radius: int = 3, dense: int = DENSE_BUCKET) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints in ``points`` that link."""
    segments = _segments(radius)
    points = points.select(F.col(fp).alias("fp"))
    entries = points.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("seg"), _cut(F.col("fp"), s, w).alias("part"))
                    for i, (s, w) in enumerate(segments)
                ]
            )
        ).alias("e"),
    ).select("fp", "e.seg", "e.part")
    probes = points.select(
        F.col("fp").alias("probe"),
        F.explode(
            F.flatten(
                F.array(
                    *[
                        _tagged(_ball(_cut(F.col("fp"), s, w), range(w)), i, "seg", "part")
                        for i, (s, w) in enumerate(segments)
                    ]
                )
            )
        ).alias("e"),
    ).select("probe", "e.seg", "e.part")
    buckets = entries.groupBy("seg", "part").agg(
        F.count(F.lit(1)).alias("held"), F.min("fp").alias("first"), F.max("fp").alias("last")
    )
    # A pair is met from its smaller side, so a bucket without a larger fingerprint is no hit.
    hits = probes.join(buckets, ["seg", "part"]).filter(F.col("probe") < F.col("last"))
    sparse = hits.filter(F.col("held") <= dense).join(entries, ["seg", "part"])
    crowded = entries.join(
        buckets.filter(F.col("held") > dense).select("seg", "part"), ["seg", "part"]
    )
    refined = (
        hits.filter(F.col("held") > dense)
        .select("probe", "seg", "part", _pieces("probe", segments, ball=True))
        .select("probe", "seg", "part", "piece.*")
        .join(
            crowded.select("fp", "seg", "part", _pieces("fp", segments, ball=False)).select(
                "fp", "seg", "part", "piece.*"
            ),
            ["seg", "part", "at", "rest"],
        )
    )
    pairs = sparse.select("probe", "fp").unionByName(refined.select("probe", "fp"))
    close = F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= radius
    return (
        pairs.filter((F.col("probe") < F.col("fp")) & close)
        .select(F.col("probe").alias("a"), F.col("fp").alias("b"))
        .distinct()
    )


def _pieces(fp: str, segments: list[tuple[int, int]], ball: bool) -> Column:
    """Pieces of the bits outside the segment: as many as segments in a whole fingerprint.

    The rest of a linked pair differs in ``radius`` bits at most, so one of ``radius // 2 + 1``
    pieces of it differs in one bit at most.
    """
    count = len(segments)
    options = []
    for i, (shift, width) in enumerate(segments):
        rest = F.col(fp).bitwiseAND(F.lit(_signed(~(((1 << width) - 1) << shift))))
        outside = [b for b in range(BITS) if not shift <= b < shift + width]
        cells = []
        for p in range(count):
            own = outside[len(outside) * p // count : len(outside) * (p + 1) // count]
            mask = _signed(sum(1 << b for b in own))
            value = rest.bitwiseAND(F.lit(mask))
            values = _ball(value, own) if ball else F.array(value)
            cells.append(_tagged(values, p, "at", "rest"))
        options.append((i, F.flatten(F.array(*cells))))
    chosen = F.when(F.col("seg") == options[0][0], options[0][1])
    for i, cells in options[1:]:
        chosen = chosen.when(F.col("seg") == i, cells)
    return F.explode(chosen).alias("piece")


def _signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def near_duplicates(
    rows: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 3,
    radius: int = 3,
    seed: int = 42,
) -> DataFrame:
    """(``key``, fp, component_id) for every row; the component is named by its smallest key.

    Rows with equal fingerprints are linked, rows without words (null, empty, white space) have
    fingerprint zero and are linked like any other. A null key takes part and gets the
    component of its text; the component is null only if all its keys are. Repeated rows are
    returned as often as they come. Other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    folder = work_folder(spark, "simhash")
    fingerprints(rows, key, text, words, seed).write.parquet(f"{folder}/points")
    stored = spark.read.parquet(f"{folder}/points")
    nodes = stored.groupBy("fp").agg(F.min(key).alias("_first"))
    links(nodes, "fp", radius).write.parquet(f"{folder}/links")
    groups = connected_components(spark.read.parquet(f"{folder}/links"), f"{folder}/groups")
    grouped = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    roots = grouped.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = grouped.select("fp", "root").join(roots, "root").select("fp", "component_id")
    return stored.join(named, "fp").select(key, "fp", "component_id")
