"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over consecutive words; its hash ignores the masked positions, so a
passage with some words substituted still shares seeds with its source. The seeds of the benchmark
are hashed; every document looks its own seeds up in a bitmap of fixed size (broadcast, whatever the
benchmark holds) and only passages around a hit leave the task. Those are joined by the whole
64-bit hash with the benchmark's seeds, and each pair of passage and item at one offset is verified
word by word. The bitmap only saves work: a false hit finds no partner in the join.

The masks leave no overlap unseen: ``masks_for`` uses given masks only where they meet every allowed
choice of substituted words, and else a run of words that the pigeonhole principle leaves whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import work_folder

#: Fixed masks; a word under 0 is ignored. Any 2 of 13 words in a row may differ: one mask still fits.
MASKS = ("111111", "11101011", "1101100011")
#: Choices of substituted words that are tried at most.
MOST_CHOICES = 100_000
FILTER_BITS = 26
#: Bits that the filter has for a hash: it passes a stranger only if all of them are set.
PROBES = 3
WORD = re.compile(r"\w+")
#: Odd multipliers, one for each place under a mask.
PLACES = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64)) for i in range(64)]


class WordHashes(dict):
    """A 64-bit hash per word, remembered within a task."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    """The hashes of the lower-cased words of a text."""
    words = WORD.findall((text or "").lower())
    if len(known) > 1_000_000:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def covers(masks: tuple[str, ...], words: int, changes: int) -> bool:
    """Whether a mask fits somewhere into ``words`` words, whichever ``changes`` of them differ."""
    seen = [
        {at + i for i, bit in enumerate(mask) if bit == "1"}
        for mask in masks
        for at in range(words - len(mask) + 1)
    ]
    return all(any(s.isdisjoint(c) for s in seen) for c in combinations(range(words), changes))


def masks_for(masks: tuple[str, ...], words: int, share: float) -> tuple[str, ...]:
    """Masks that meet every run of ``words`` words with a ``share`` of equal ones."""
    equal = int(np.ceil(share * words))
    changes = words - equal
    if comb(words, changes) <= MOST_CHOICES and covers(masks, words, changes):
        return masks
    # The changed words part the equal ones into changes + 1 runs; the longest has this many words.
    run = -(-equal // (changes + 1))
    return ("1" * max(1, min(run, len(PLACES))),)


def seeds_of(
    words: np.ndarray, masks: tuple[str, ...], numbers: list[int] | None = None
) -> list[np.ndarray]:
    """For each mask (of ``numbers``) the seed hash at every word where the mask fits."""
    found = []
    for number in range(len(masks)) if numbers is None else numbers:
        mask = masks[number]
        places = max(0, len(words) - len(mask) + 1)
        total = np.full(places, number, np.uint64)
        for offset in (i for i, bit in enumerate(mask) if bit == "1"):
            total += words[offset : offset + places] * PLACES[offset]
        total ^= total >> np.uint64(31)
        total *= PLACES[1]
        total ^= total >> np.uint64(29)
        found.append(total)
    return found


def _benchmark_seeds(
    items: DataFrame, masks: tuple[str, ...], used: list[list[int]]
) -> DataFrame:
    """(item, members, item_words binary, n, seeds array<struct<h, pos>>) per text of the benchmark.

    ``used`` has the numbers of the masks by n, the words of a text or as many as it is long.
    """
    most = len(used) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            words = [word_hashes(t.as_py(), known) for t in batch.column(2)]
            seeds = []
            for each in words:
                seeds.append(
                    [
                        {"h": h, "pos": pos}
                        for found in seeds_of(each, masks, used[min(len(each), most)])
                        for pos, h in enumerate(found.view(np.int64).tolist())
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([w.tobytes() for w in words], pa.binary()),
                    pa.array([min(len(w), most) for w in words], pa.int64()),
                    pa.array(
                        seeds, pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32())]))
                    ),
                ],
                names=["item", "members", "item_words", "n", "seeds"],
            )

    return items.mapInArrow(
        run,
        f"item {items.schema['item'].dataType.simpleString()}, members long, item_words binary,"
        " n long, seeds array<struct<h long, pos int>>",
    )


def _shift(probe: int, bits: int) -> int:
    """How far a hash is shifted for one of its bits; the last probe takes its highest bits."""
    return probe * (64 - bits) // (PROBES - 1)


def _bitmap(seeds: DataFrame, bits: int) -> np.ndarray:
    """The filter's ``2**bits`` bits; at most ``2**bits / 64`` rows reach the driver."""
    cuts = [
        F.shiftrightunsigned("h", _shift(p, bits)).bitwiseAND(F.lit((1 << bits) - 1))
        for p in range(PROBES)
    ]
    words = seeds.select(F.explode(F.array(*cuts)).alias("bit")).groupBy(
        F.shiftright("bit", 6).alias("at")
    ).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    found = words.toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64)
    return out


def _passages(
    rows: DataFrame,
    kind: str,
    bitmap,
    masks: tuple[str, ...],
    numbers: list[int],
    bits: int,
    margin: int,
) -> DataFrame:
    """One row per passage of a document around hits in the bitmap; ``numbers`` of masks count."""
    span = max(map(len, masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bitmap.value
        known = WordHashes()
        low, six, rest = np.uint64((1 << bits) - 1), np.uint64(6), np.uint64(63)

        def passing(hashes: np.ndarray) -> np.ndarray:
            at = np.arange(len(hashes))
            for p in range(PROBES):
                bit = (hashes[at] >> np.uint64(_shift(p, bits))) & low
                word = marks[(bit >> six).astype(np.int64)].view(np.uint64)
                at = at[((word >> (bit & rest)) & np.uint64(1)).astype(bool)]
            return at

        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("key", "row", "start", "words", "hits")}
            for key, row, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                words = word_hashes(text.as_py(), known)
                places, hashes = [], []
                for found in seeds_of(words, masks, numbers):
                    hit = passing(found)
                    places.append(hit)
                    hashes.append(found[hit])
                if not any(map(len, places)):
                    continue
                place, hashed = np.concatenate(places), np.concatenate(hashes)
                order = np.argsort(place, kind="stable")
                place, hashed = place[order], hashed[order].view(np.int64)
                # Hits further apart than a passage reaches start a new one.
                cuts = np.flatnonzero(np.diff(place) > span + 2 * margin) + 1
                for own, h in zip(np.split(place, cuts), np.split(hashed, cuts)):
                    start = max(0, int(own[0]) - margin)
                    end = int(own[-1]) + span + margin
                    out["key"].append(key.as_py())
                    out["row"].append(row.as_py())
                    out["start"].append(start)
                    out["words"].append(words[start:end].tobytes())
                    out["hits"].append(
                        [{"h": a, "pos": b} for a, b in zip(h.tolist(), (own - start).tolist())]
                    )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["key"], batch.column(0).type),
                    pa.array(out["row"], pa.int64()),
                    pa.array(out["start"], pa.int64()),
                    pa.array(out["words"], pa.binary()),
                    pa.array(
                        out["hits"], pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int32())]))
                    ),
                ],
                names=["key", "row", "start", "words", "hits"],
            )

    return rows.select("key", "row", "text").mapInArrow(
        run,
        f"key {kind}, row long, start long, words binary, hits array<struct<h long, pos int>>",
    )


def best_overlap(
    passage: np.ndarray, item: np.ndarray, offset: int, overlap: int, share: float
) -> tuple[int, int, int] | None:
    """(equal words, first word in the passage, words compared), or None if too little is equal.

    The item's word i lies on the passage's word i + ``offset``. Some ``overlap`` words in a row (all
    of a shorter item) must have a ``share`` of equal words; then all compared words count.
    """
    first, last = max(0, -offset), min(len(item), len(passage) - offset)
    need = min(overlap, len(item))
    if last - first < need:
        return None
    equal = passage[first + offset : last + offset] == item[first:last]
    sums = np.concatenate([[0], np.cumsum(equal)])
    if (sums[need:] - sums[:-need]).max() < np.ceil(share * need):
        return None
    return int(sums[-1]), first + offset, last - first


def contaminations(
    rows: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    masks: tuple[str, ...] = MASKS,
    overlap: int = 13,
    share: float = 0.8,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per (row of ``rows``, benchmark text) that overlap.

    Columns: ``key``, row (number of the input row), ``item`` (the smallest id of the benchmark rows
    with that text), members (how many there are), equal_words, first_word (in the document),
    compared_words. Two texts overlap when, at one offset, ``overlap`` words in a row (all words
    of a shorter item) are equal in a share of ``share``; the words compared reach ``overlap`` beyond
    the seeds found. Of several places the one with the most equal words counts, then the first.

    Every such overlap is found: ``masks`` are used where they meet every choice of words that may
    differ, and a shorter run of words elsewhere, as for short items.

    Words are runs of word characters, case does not matter. Texts and items without a word overlap
    with nothing; an item of one to four words must occur as it is. A null key is carried like any other;
    repeated rows give a row each; an empty table on either side gives no rows.
    """
    spark = rows.sparkSession
    folder = work_folder(spark, "decontaminate")
    items = (
        benchmark.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("t"))
        .filter("t is not null")
        .groupBy("t")
        .agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("members"))
        .select("item", "members", "t")
    )
    by_length = [(), *(masks_for(masks, n, share) for n in range(1, overlap + 1))]
    masks = tuple(dict.fromkeys(m for own in by_length for m in own))
    used = [[masks.index(m) for m in own] for own in by_length]
    _benchmark_seeds(items, masks, used).withColumn("at", F.monotonically_increasing_id()).write.parquet(
        f"{folder}/items"
    )
    stored = spark.read.parquet(f"{folder}/items")
    seeds = stored.select("at", F.explode("seeds").alias("s")).select("at", "s.h", "s.pos")
    # Documents are looked through with the masks of the item lengths that there are.
    numbers = sorted({i for r in stored.select("n").distinct().collect() for i in used[r["n"]]})
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds, filter_bits))
    numbered = rows.select(
        F.col(key).alias("key"),
        F.col(text).cast("string").alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    kind = rows.schema[key].dataType.simpleString()
    _passages(numbered, kind, bitmap, masks, numbers, filter_bits, overlap).write.parquet(
        f"{folder}/passages"
    )
    passages = spark.read.parquet(f"{folder}/passages")
    pairs = (
        passages.select("row", "start", F.explode("hits").alias("s"))
        .select("row", "start", "s.h", F.col("s.pos").alias("at_word"))
        .join(seeds, "h")
        .select("row", "start", "at", (F.col("at_word") - F.col("pos")).alias("offset"))
        .distinct()
    )
    ready = (
        pairs.join(passages.select("row", "start", "key", "words"), ["row", "start"])
        .join(stored.select("at", "item", "members", "item_words"), "at")
        .select("key", "row", "item", "members", "start", "offset", "words", "item_words")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, equal, first, compared = [], [], [], []
            for i in range(batch.num_rows):
                found = best_overlap(
                    np.frombuffer(batch.column(6)[i].as_py(), np.uint64),
                    np.frombuffer(batch.column(7)[i].as_py(), np.uint64),
                    batch.column(5)[i].as_py(),
                    overlap,
                    share,
                )
                if found:
                    keep.append(i)
                    equal.append(found[0])
                    first.append(batch.column(4)[i].as_py() + found[1])
                    compared.append(found[2])
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    *[kept.column(i) for i in range(4)],
                    pa.array(equal, pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(compared, pa.int64()),
                ],
                names=["key", "row", "item", "members", "equal", "first", "compared"],
            )

    item_kind = benchmark.schema[item].dataType.simpleString()
    verified = ready.mapInArrow(
        run,
        f"key {kind}, row long, item {item_kind}, members long, equal long, first long,"
        " compared long",
    )
    best = F.struct(
        F.col("equal"), (-F.col("first")).alias("place"), F.col("compared"), F.col("members")
    )
    return (
        verified.groupBy("key", "row", "item")
        .agg(F.max(best).alias("best"))
        .select(
            F.col("key").alias(key),
            "row",
            F.col("item").alias(item),
            F.col("best.members").alias("members"),
            F.col("best.equal").alias("equal_words"),
            (-F.col("best.place")).alias("first_word"),
            F.col("best.compared").alias("compared_words"),
        )
    )
