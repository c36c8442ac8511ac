"""Hashed sparse features of whole texts, computed with numpy inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULTIPLIER = 0x9E3779B97F4A7C15
BASE = 0x100000001B3
#: Letters below this code point are looked up; everything from it on counts as a letter.
LATIN = 0x300


def code_points(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(MULTIPLIER)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def char_ngrams(text: str, bits: int, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of all character n-grams, n = 1 .. ``most``."""
    points = code_points(text)
    counts = np.zeros(1 << bits, np.int64)
    hashes = np.zeros(len(points), np.uint64)
    for n in range(1, most + 1):
        if len(points) < n:
            break
        hashes = hashes[: len(points) - n + 1] * np.uint64(BASE) + points[n - 1 :] + np.uint64(n)
        counts += np.bincount(_bucket(hashes, bits), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


def word_prefixes(
    text: str, bits: int, lengths: tuple[int, ...] = (4, 5, 6, 7)
) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets, counts, words) of all words and of their prefixes of the given lengths.

    A word is a run of letters. A prefix feature comes from words longer than it only.
    """
    points = code_points(text)
    known = np.array([chr(i).isalpha() for i in range(LATIN)] + [True])
    letter = known[np.minimum(points, LATIN).astype(np.int64)]
    edges = np.diff(np.concatenate([[0], letter.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    sizes = ends - starts
    powers = np.full(int(sizes.max()), BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    terms = points[letter] * powers[inside]
    first = np.cumsum(sizes) - sizes
    found = [np.add.reduceat(terms, first)]
    for n in lengths:
        cut = np.add.reduceat(np.where(inside < n, terms, np.uint64(0)), first)
        found.append(cut[sizes > n] + np.uint64(n * 0xABCDEF12345))
    at, n = np.unique(_bucket(np.concatenate(found), bits), return_counts=True)
    return at, n, len(sizes)


def lists_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a list column as views of its numbers, without an object per number."""
    out = []
    for chunk in column.chunks:
        values, ends = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return out
