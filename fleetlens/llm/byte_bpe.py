"""Byte-level BPE with a rank file: encoding of whole texts and decoding to raw bytes.

The rank file is read once by the driver and broadcast; it has a fixed size. Encoding is done by the
tiktoken library. Its splitting pattern backtracks, which costs stack on very long matches, so a
long text is first cut at safe boundaries: places where a match of the pattern always ends,
whatever stands around them. What has no such place for very long (a run of one kind of
character) is split by the ``regex`` library and each match is encoded on its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points per piece given to the encoder.
BLOCK = 1 << 15
#: A letter or digit before a space or line feed: every match ends between the two.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")


def read_ranks(path: str) -> bytes:
    """Content of a rank file, ``token in base64, rank`` per line."""
    with open(path, "rb") as file:
        return file.read()


def encoder(ranks: bytes, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """An encoder without special tokens."""
    table = {
        base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())
    }
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_blocks(text: str, block: int = BLOCK) -> Iterator[str]:
    """``text`` in pieces of about ``block`` code points, cut at safe boundaries only.

    A piece is longer where no safe boundary comes.
    """
    at = 0
    while len(text) - at > block:
        cut = SAFE.search(text, at + block)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text) or not text:
        yield text[at:]


def encode_text(enc: tiktoken.Encoding, pattern, text: str, block: int = BLOCK) -> list[int]:
    """Ids of ``text``, the same as one call of the library gives."""
    if len(text) <= block:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_blocks(text, block):
        if len(piece) <= 2 * block:
            ids += enc.encode_ordinary(piece)
        else:
            for match in pattern.finditer(piece):
                part = match.group()
                ids += (
                    enc.encode_ordinary(part)
                    if len(part) <= block
                    else enc._encode_single_piece(part)
                )
    return ids


def _encoded(enc: tiktoken.Encoding, split: regex.Pattern, text: str | None, block: int) -> np.ndarray:
    return np.asarray(encode_text(enc, split, text or "", block), np.int32)


def _lists(arrays: Iterable[np.ndarray]) -> pa.ListArray:
    arrays = list(arrays)
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(
    rows: DataFrame,
    ranks: str,
    text: str = "text",
    ids: str = "ids",
    pattern: str = public_tokenizers.PATTERN,
    block: int = BLOCK,
) -> DataFrame:
    """``rows`` with the column ``ids`` array<int>: the token ids of the whole text.

    A null or empty text gives an empty array, never null. Other columns and their order stay,
    a column already named ``ids`` is replaced; repeated rows are encoded each, an empty
    table stays empty. Rows stay where they are: there is no shuffle.
    """
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc, split = encoder(shared.value, pattern), regex.compile(pattern)
        for batch in batches:
            yield _lists(_encoded(enc, split, t.as_py(), block) for t in batch)

    return rows.withColumn(ids, run(F.col(text).cast("string")))


def decode(
    rows: DataFrame,
    ranks: str,
    ids: str = "ids",
    out: str = "bytes",
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """``rows`` with the column ``out`` binary: the raw bytes of the ids, null for null ids.

    The bytes need not be valid UTF-8, as ids may be cut anywhere. An unknown id fails the job.
    """
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            yield pa.array(
                [None if x.as_py() is None else enc.decode_bytes(x.as_py()) for x in batch],
                pa.binary(),
            )

    return rows.withColumn(out, run(F.col(ids)))


def round_trip(
    rows: DataFrame,
    ranks: str,
    text: str = "text",
    ids: str = "ids",
    out: str = "bytes",
    pattern: str = public_tokenizers.PATTERN,
    block: int = BLOCK,
) -> DataFrame:
    """``rows`` with both columns of ``encode`` and ``decode``: the ids, and the bytes these ids decode to.

    Both are made in one pass, so the ids go through one Python worker, not two.
    """
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    @F.arrow_udf("struct<ids: array<int>, bytes: binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc, split = encoder(shared.value, pattern), regex.compile(pattern)
        for batch in batches:
            lists, decoded = [], []
            for t in batch:
                found = encode_text(enc, split, t.as_py() or "", block)
                lists.append(np.asarray(found, np.int32))
                decoded.append(enc.decode_bytes(found))
            yield pa.StructArray.from_arrays(
                [_lists(lists), pa.array(decoded, pa.binary())], names=["ids", "bytes"]
            )

    found = rows.withColumn("_bpe", run(F.col(text).cast("string")))
    return found.withColumns({ids: F.col("_bpe.ids"), out: F.col("_bpe.bytes")}).drop("_bpe")
