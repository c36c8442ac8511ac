"""Token-id shards with a minimal perfect hash index.

Folder layout, written and read by Spark's own file formats, so it works on any file system:

``shards/``   one raw file per shard, in ascending key order over all shards::

    MAGIC | ids (2 or 4 bytes each, little-endian) | keys | starts | displacements | slots | prints
          | footer: JSON with the sizes | its length, 4 bytes | line feed

``manifest/``  Parquet, a row per shard: part, piece, first token, tokens, documents, smallest and largest
key, file name. Shards do not overlap but in one key, so the keys tell which files to open.

Within a shard the index maps a key to its documents in constant time. A key's 64-bit hash picks a
group; the group's displacement moves its keys to slots of their own (hash and displace); a group of
one key names its slot outright. The slot holds the first document, how many there are
of that key, and a 16-bit fingerprint, which a key that is not there matches once in 65,536.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

MAGIC = b"FLIDX001"
END = 2
#: Ids of one shard: 8 MB at two bytes an id.
SHARD_TOKENS = 4 << 20
#: Words remembered within a task.
REMEMBERED = 400_000
#: Displacements worked out for all keys at once.
TRIES = 48
#: Marks that may end a word; no match of the splitting pattern takes a letter and one of them.
MARKS = ".,!?;:"
#: Units of a text with any white space. A match never crosses from a visible character to a space,
#: tab or line end either.
UNIT = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
#: White space outside that set could join a run of it, so such texts are encoded as a whole.
OTHER_SPACE = re.compile(r"[^\S \t\r\n]|[\x1c-\x1f\x85]")
#: All white space but the space and the line feed.
RARE_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Letters below this code point are letters to every version of Unicode.
LATIN = chr(0x250)


def load_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printed)]
    return {b: b for b in printed} | {b: 256 + i for i, b in enumerate(others)}


class UnitEncoder(dict):
    """Encodes texts with the tokenizers library, each distinct word of a task once.

    As a dictionary it maps a piece between single spaces to the ids of the piece with its space (a
    piece that begins with a line feed has none).
    """

    def __init__(self, spec: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = {2: "H", 4: "I"}[self.width]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.marks = {mark: self._library(mark) for mark in MARKS}
        self.line, self.space = self._library("\n"), chr(self.letters[ord(" ")])

    def _library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        # A line feed is a match of its own; a space belongs to the word behind it.
        first = piece[:1] == "\n"
        word = piece[1:] if first else piece
        if word.isascii() and word.isalpha():
            # Letters, with their space, are one match of the pattern, so the merges are all there is to do.
            ids = self._merged(word if first else self.space + word)
        elif word[-1:] in self.marks and word[:-1].isalpha():
            # A word met for the first time is remembered without its mark.
            known = piece[:-1] in self
            ids = self[piece[:-1]] + self.marks[word[-1]]
            if known:
                self[piece] = ids
            return ids
        elif word.isalpha() and max(word) < LATIN:
            coded = word if first else f" {word}"
            ids = self._merged(coded.encode().decode("latin-1").translate(self.letters))
        else:
            ids = self._library(word if first else f" {word}")
        if first:
            ids = self.line + ids
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def _merged(self, coded: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(coded)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, as the library gives them, ``width`` bytes each."""
        if len(self) > REMEMBERED:
            self.clear()
        pieces = text.replace("\n", " \n").split(" ")
        # White space is single spaces and single line feeds only, and there is none at either end of a
        # piece: so each piece ends where a match ends.
        if "" not in pieces and "\n" not in pieces and not any(map(text.__contains__, RARE_SPACE)):
            return self._library(pieces[0]) + b"".join(map(self.__getitem__, pieces[1:]))
        if OTHER_SPACE.search(text):
            return self._library(text)
        return b"".join(map(self._library, UNIT.findall(text)))


def key_bytes(key: str | None) -> bytes:
    return b"\0" if key is None else b"\1" + key.encode("utf-8", "surrogatepass")


def key_text(key: bytes) -> str | None:
    return None if key == b"\0" else key[1:].decode("utf-8", "surrogatepass")


def _mixed(hashes: np.ndarray, seed) -> np.ndarray:
    x = hashes + (np.atleast_1d(np.asarray(seed, np.uint64)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_hash(hashes: np.ndarray, load: int = 2) -> np.ndarray:
    """Displacements of a minimal perfect hash of distinct 64-bit ``hashes``."""
    n = len(hashes)
    groups = max(1, -(-n // load))
    moves = np.zeros(groups, "<i4")
    if not n:
        return moves
    home = (_mixed(hashes, 2**40) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    sizes = np.bincount(home, minlength=groups)
    begins = (np.cumsum(sizes) - sizes).tolist()
    taken = bytearray(n)
    by_size = np.argsort(-sizes, kind="stable").tolist()
    sizes, ordered = sizes.tolist(), hashes[order]

    # Slots of all keys for the first displacements, which are enough for most groups.
    first = [
        (_mixed(ordered, seed) % np.uint64(n)).astype(np.int64).tolist() for seed in range(TRIES)
    ]
    singles = []
    for group in by_size:
        size, begin = sizes[group], begins[group]
        if size == 0:
            break
        if size == 1:
            singles.append(group)
            continue
        for seed in range(1 << 30):
            if seed < TRIES:
                slots = first[seed][begin : begin + size]
            else:
                if (seed - TRIES) % 256 == 0:  # the next 256, for this group only
                    own, seeds = ordered[begin : begin + size], np.arange(seed, seed + 256)
                    more = (_mixed(own, seeds[:, None]) % np.uint64(n)).astype(np.int64).tolist()
                slots = more[(seed - TRIES) % 256]
            if len(set(slots)) == size and not any([taken[s] for s in slots]):
                moves[group] = seed
                for s in slots:
                    taken[s] = 1
                break
        else:
            raise ValueError("two keys have the same 64-bit hash")
    free = np.flatnonzero(np.frombuffer(taken, np.uint8) == 0)
    moves[singles] = -1 - free[: len(singles)]
    return moves


def slot_of(moves: np.ndarray, n: int, hashes: np.ndarray) -> np.ndarray:
    """The slot of each hash; a hash that is not in the set gets some slot too."""
    move = moves[(_mixed(hashes, 2**40) % np.uint64(len(moves))).astype(np.int64)].astype(np.int64)
    moved = (_mixed(hashes, np.maximum(move, 0)) % np.uint64(max(1, n))).astype(np.int64)
    return np.where(move < 0, -1 - move, moved)


def pack_shard(
    keys: Sequence[str | None], ids: Sequence[bytes], width: int, part: int, piece: int
) -> bytes:
    """The file of one shard: documents in the given order, equal keys side by side."""
    coded = [key_bytes(k) for k in keys]
    firsts = [i for i, k in enumerate(coded) if i == 0 or coded[i - 1] != k]
    hashes = np.array([xxhash.xxh64_intdigest(coded[i]) for i in firsts], np.uint64)
    repeats = np.diff([*firsts, len(coded)])
    moves = build_hash(hashes)
    slots = np.zeros((len(firsts), 2), "<u4")
    prints = np.zeros(len(firsts), "<u2")
    at = slot_of(moves, len(firsts), hashes)
    slots[at, 0], slots[at, 1] = firsts, repeats
    prints[at] = (_mixed(hashes, 2**41) >> np.uint64(48)).astype(np.uint16)
    starts = np.cumsum([0, *[len(x) // width for x in ids]]).astype("<u8")
    sizes = np.array([len(k) for k in coded], "<u4").tobytes()
    sections = {
        "ids": b"".join(ids),
        "keys": sizes + b"".join(coded),
        "starts": starts.tobytes(),
        "moves": moves.tobytes(),
        "slots": slots.tobytes(),
        "prints": prints.tobytes(),
    }
    footer = json.dumps(
        {
            "width": width,
            "part": part,
            "piece": piece,
            "documents": len(coded),
            "keys": len(firsts),
            "sections": {name: len(data) for name, data in sections.items()},
        }
    ).encode()
    return MAGIC + b"".join(sections.values()) + footer + len(footer).to_bytes(4, "little")


class Shard:
    """Reads the file of one shard."""

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("no shard file")
        end = len(content) - (4 if content[-5:-4] == b"}" else 5)
        size = int.from_bytes(content[end : end + 4], "little")
        self.head = json.loads(content[end - size : end])
        view, at, self.section = memoryview(content), len(MAGIC), {}
        for name, length in self.head["sections"].items():
            self.section[name] = view[at : at + length]
            at += length
        self.key_ends: np.ndarray | None = None
        self.ids = np.frombuffer(self.section["ids"], f"<u{self.head['width']}")
        self.starts = np.frombuffer(self.section["starts"], "<u8").astype(np.int64)
        self.moves = np.frombuffer(self.section["moves"], "<i4")
        self.slots = np.frombuffer(self.section["slots"], "<u4").reshape(-1, 2).astype(np.int64)
        self.prints = np.frombuffer(self.section["prints"], "<u2")

    def key(self, number: int) -> bytes:
        """The stored key of a document."""
        if self.key_ends is None:
            count = self.head["documents"]
            sizes = np.frombuffer(self.section["keys"][: 4 * count], "<u4")
            self.key_ends = np.cumsum(np.append(4 * count, sizes), dtype=np.int64)
        return bytes(self.section["keys"][self.key_ends[number] : self.key_ends[number + 1]])

    def keys(self) -> list[bytes]:
        return [self.key(i) for i in range(self.head["documents"])]

    def find(self, keys: Sequence[bytes]) -> list[tuple[int, int]]:
        """(first document, documents) of each key; (0, 0) where the fingerprint says no."""
        if not len(self.prints) or not keys:
            return [(0, 0)] * len(keys)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at = slot_of(self.moves, len(self.prints), hashes)
        same = self.prints[at] == (_mixed(hashes, 2**41) >> np.uint64(48)).astype(np.uint16)
        return [tuple(x) for x in np.where(same[:, None], self.slots[at], 0).tolist()]

    def document(self, number: int) -> np.ndarray:
        return self.ids[self.starts[number] : self.starts[number + 1]]


def write_ids(
    rows: DataFrame,
    folder: str,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    end: int = END,
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode whole texts, append ``end`` to each and write the shards and their manifest.

    Documents lie in ascending key order, null keys first, equal keys by a hash of their text. A
    null text is empty, so it is the end id only. Repeated rows are stored each. A shard closes at the
    document with which it reaches ``shard_tokens``, so only one very long document makes a larger one.
    Other columns are ignored; an empty table writes no shard. The texts are shuffled once, by
    ranges of the key and the hash, which also splits a key that very many rows share.
    """
    spark = rows.sparkSession
    spec = spark.sparkContext.broadcast(load_tokenizer(tokenizer))
    ordered = (
        rows.select(
            F.col(key).alias("key"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        )
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange("key", "h")
        .sortWithinPartitions("key", "h")
        .select(F.col("key").cast("string").alias("key"), "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(spec.value)
        last = np.asarray([end], f"<u{encoder.width}").tobytes()
        part, piece, held = TaskContext.get().partitionId(), 0, 0
        keys: list[str | None] = []
        ids: list[bytes] = []

        def shard() -> pa.RecordBatch:
            content = pack_shard(keys, ids, encoder.width, part, piece)
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in batches:
            for k, body in zip(batch.column(0), batch.column(1)):
                keys.append(k.as_py())
                ids.append(encoder.encode(body.as_py()) + last)
                held += len(ids[-1]) // encoder.width
                if held >= shard_tokens:
                    yield shard()
                    piece, held, keys, ids = piece + 1, 0, [], []
        if keys:
            yield shard()

    content = ordered.mapInArrow(run, "content binary").select(F.col("content").cast("string"))
    # A record is the raw content of one file.
    content.write.option("maxRecordsPerFile", 1).text(f"{folder}/shards")
    _manifest(spark, folder).write.parquet(f"{folder}/manifest")


def _shards(spark: SparkSession, folder: str, *files: str) -> DataFrame:
    # An empty task still writes an empty file.
    paths = [f"{folder}/shards/{file}" for file in files] or f"{folder}/shards"
    return (
        spark.read.format("binaryFile")
        .load(paths)
        .filter("length > 0")
        .select("content", F.element_at(F.split("path", "/"), -1).alias("file"))
    )


HEADS = "part long, piece long, documents long, tokens long, first_key string, last_key string, file string"


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for content, file in zip(batch.column(0), batch.column(1)):
                shard = Shard(content.as_py())
                count = shard.head["documents"]
                heads.append(
                    {
                        "part": shard.head["part"],
                        "piece": shard.head["piece"],
                        "documents": count,
                        "tokens": len(shard.ids),
                        "first_key": key_text(shard.key(0)),
                        "last_key": key_text(shard.key(count - 1)),
                        "file": file.as_py(),
                    }
                )
            kinds = [field.split() for field in HEADS.split(", ")]
            schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in kinds])
            yield pa.RecordBatch.from_pylist(heads, schema=schema)

    # The files are read once for their heads; the rest works on the small table.
    _shards(spark, folder).mapInArrow(run, HEADS).write.parquet(f"{folder}/heads")
    heads = spark.read.schema(HEADS).parquet(f"{folder}/heads")
    # Tokens before a shard: pieces before it in its part, parts before it in its block of 1,024
    # parts, and whole blocks, of which there are few.
    heads = heads.withColumn("block", F.floor(F.col("part") / 1024))

    def before(keys: list[str], order: str) -> Window:
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    parts = heads.groupBy("block", "part").agg(F.sum("tokens").alias("t"))
    blocks = parts.groupBy("block").agg(F.sum("t").alias("t"))
    blocks = blocks.select(
        "block", F.coalesce(F.sum("t").over(before([], "block")), F.lit(0)).alias("b0")
    )
    parts = parts.select(
        "block",
        "part",
        F.coalesce(F.sum("t").over(before(["block"], "part")), F.lit(0)).alias("p0"),
    )
    inner = F.coalesce(F.sum("tokens").over(before(["part"], "piece")), F.lit(0))
    return (
        heads.withColumn("s0", inner)
        .join(parts, ["block", "part"])
        .join(blocks, "block")
        .select(
            "part",
            "piece",
            (F.col("b0") + F.col("p0") + F.col("s0")).alias("first_token"),
            "tokens",
            "documents",
            "first_key",
            "last_key",
            "file",
        )
    )


def read_documents(spark: SparkSession, folder: str, kind: str = "bigint") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) per stored document, each fetched by its key.

    ``start`` counts the ids of all documents before it; the checksum is over the ids as little-endian
    unsigned 32-bit numbers. ``kind`` is the type of the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "part", "piece", "inner", "n_tokens", "ids_crc32")
        schema = pa.schema([("key", pa.string()), *[(n, pa.int64()) for n in names[1:]]])
        for batch in batches:
            for content in batch.column(0):
                shard = Shard(content.as_py())
                part, piece, rows = shard.head["part"], shard.head["piece"], []
                stored = list(dict.fromkeys(shard.keys()))
                for key, (first, count) in zip(stored, shard.find(stored)):
                    name = key_text(key)
                    for number in range(first, first + count):
                        ids = shard.document(number)
                        rows.append(
                            (
                                name,
                                part,
                                piece,
                                int(shard.starts[number]),
                                len(ids),
                                zlib.crc32(ids.astype("<u4").tobytes()),
                            )
                        )
                columns = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
                )

    found = _shards(spark, folder).select("content").mapInArrow(
        run,
        "key string, part long, piece long, inner long, n_tokens long, ids_crc32 long",
    )
    manifest = spark.read.parquet(f"{folder}/manifest").select("part", "piece", "first_token")
    return found.join(manifest, ["part", "piece"]).select(
        F.col("key").cast(kind).alias("key"),
        (F.col("first_token") + F.col("inner")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def files_of(
    spark: SparkSession, folder: str, keys: Sequence[object], most_files: int = 100_000
) -> list[str]:
    """Names of the shard files whose range of keys holds one of ``keys``: one a key, but for a key whose
    documents fill several shards. More than ``most_files`` fail."""
    asked = spark.sparkContext.broadcast(_sorted_keys(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_key = _comparable(asked.value)
        for batch in batches:
            low, high = (
                [as_key(k) for k in batch.column(i).to_pylist()] for i in (0, 1)
            )
            wanted = [as_key(k) for k in asked.value]
            held = [bisect_left(wanted, a) < bisect_right(wanted, b) for a, b in zip(low, high)]
            yield batch.select(["file"]).filter(pa.array(held, pa.bool_()))

    manifest = spark.read.parquet(f"{folder}/manifest").select("first_key", "last_key", "file")
    found = manifest.mapInArrow(run, "file string").limit(most_files + 1).collect()
    if len(found) > most_files:
        raise ValueError(f"the keys lie in more than {most_files} shards; read all of them instead")
    return [r["file"] for r in found]


def _comparable(keys: Sequence[object]):
    """The order of keys in the shards, null first: that of numbers if all keys are, else of UTF-8."""
    if all(isinstance(k, int) for k in keys if k is not None):
        return lambda k: (k is not None, int(k or 0))
    return lambda k: (k is not None, str(k or "").encode("utf-8", "surrogatepass"))


def _sorted_keys(keys: Sequence[object]) -> list[object]:
    return sorted(dict.fromkeys(keys), key=_comparable(keys))


def lookup(
    spark: SparkSession, folder: str, keys: Sequence[object], most_keys: int = 1_000_000
) -> DataFrame:
    """(key string, ids array<int>) of the documents with one of ``keys``; absent keys have no row.

    The keys are a bounded list (more than ``most_keys`` fail) of whole numbers or of texts, as the column
    was. The manifest names the files to open, at most one a key unless a key fills several. There each
    key goes through the index to its slot, and only the stored key of that slot is compared.
    """
    if len(keys) > most_keys:
        raise ValueError(f"more than {most_keys} keys; ask in several calls")
    files = files_of(spark, folder, keys)
    if not files:
        return spark.createDataFrame([], "key string, ids array<int>")
    wanted = [key_bytes(None if k is None else str(k)) for k in _sorted_keys(keys)]
    asked = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                shard, names, ids = Shard(content.as_py()), [], []
                for key, (first, count) in zip(asked.value, shard.find(asked.value)):
                    if count and shard.key(first) == key:
                        for number in range(first, first + count):
                            names.append(key_text(key))
                            ids.append(shard.document(number).tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(ids, pa.list_(pa.int32()))],
                    names=["key", "ids"],
                )

    return _shards(spark, folder, *files).select("content").mapInArrow(run, "key string, ids array<int>")
