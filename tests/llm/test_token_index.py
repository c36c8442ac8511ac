import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import queries, token_index

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_units_give_the_ids_of_the_whole(library):
    rng = random.Random(4)
    pool = [*"ab'sT1٣½ \n\t\r.,é漢\u00a0\u0085\x1cñ_-²", "<|endoftext|>", "  ", "'ll", "\n\n", " \n", "...", "Ünder"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += ["", "a" * 50_000, "word " * 20_000, " " * 3000 + "x"]
    encoder = token_index.UnitEncoder(token_index.load_tokenizer(PATH))
    words = ["it's", "Ünder", "x,", "a.b", "漢字", "don't!", "\nNew", "½", "٣", "-", "I'll;", "ñandú?", "<|endoftext|>"]
    texts += [" ".join(rng.choices(words, k=12)).replace(" \n", "\n") for _ in range(1500)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == library(text)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 20_000])
def test_hash_is_minimal_and_perfect(n):
    hashes = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    moves = token_index.build_hash(hashes)
    slots = token_index.slot_of(moves, len(hashes), hashes)
    assert sorted(slots.tolist()) == list(range(len(hashes)))


def test_shard_file():
    keys = [None, "1", "1", "", "é"] + [f"k{i}" for i in range(500)]
    ids = [np.arange(i % 7, dtype="<u2").tobytes() for i in range(len(keys))]
    for tail in (b"", b"\n"):
        shard = token_index.Shard(token_index.pack_shard(keys, ids, 2, 3, 4) + tail)
        wanted = [token_index.key_bytes(k) for k in keys]
        assert shard.keys() == wanted
        for i, (first, count) in enumerate(shard.find(wanted)):
            assert keys[first] == keys[i] and count == (2 if keys[i] == "1" else 1)
            assert shard.document(first).tobytes() == ids[first]
        absent = shard.find([token_index.key_bytes(f"absent{i}") for i in range(5000)])
        assert sum(count > 0 for _, count in absent) < 10  # one in 65,536 passes
    empty = token_index.Shard(token_index.pack_shard([], [], 2, 0, 0))
    assert empty.find([b"\1x"]) == [(0, 0)]


def stored(spark, tmp_path, rows, name, **settings):
    table = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, key string")
    folder = f"file://{tmp_path}/{name}"
    token_index.write_ids(table.repartition(4), folder, PATH, **settings)
    return folder


def test_files_with_nulls_and_repeated_keys(spark, tmp_path, library):
    rows = [(i, f"text number {i} " * (i % 9)) for i in range(200)]
    rows += [(None, "no key"), (None, None), (7, "again"), (7, "again"), (500, None)]
    folder = stored(spark, tmp_path, rows, "a", shard_tokens=300)
    found = token_index.read_documents(spark, folder).collect()
    assert len(found) == len(rows)
    order = sorted(found, key=lambda r: r["start"])
    assert [r["key"] for r in order] == [None, None, *sorted(d for d, _ in rows if d is not None)]
    at = 0
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
    sums = sorted(zlib.crc32(np.array([*library(t or ""), 2], "<u4").tobytes()) for _, t in rows)
    assert sorted(r["ids_crc32"] for r in found) == sums
    shards = spark.read.parquet(f"{folder}/manifest")
    assert shards.count() > 4 and shards.agg({"documents": "sum"}).first()[0] == len(rows)
    got = token_index.lookup(spark, folder, [7, 500, 12345, None]).collect()
    ids = {}
    for r in got:
        ids.setdefault(r["key"], []).append(r["ids"])
    assert set(ids) == {"7", "500", None} and ids["500"] == [[2]]
    assert sorted(ids["7"]) == sorted([*[[*library("again"), 2]] * 2, [*library(dict(rows[:200])[7]), 2]])
    with pytest.raises(ValueError):
        token_index.lookup(spark, folder, [1, 2], most_keys=1)


def test_lookup_opens_the_files_of_its_keys_only(spark, tmp_path, library):
    rows = [(i * 3, f"text {i} of many") for i in range(3000)] + [(-5, "below"), (9 * 10**18, "far above")]
    folder = stored(spark, tmp_path, rows, "c", shard_tokens=200)
    files = spark.read.parquet(f"{folder}/manifest").count()
    keys = [0, 3, 900, 1500, 3003, 4500, 6000, 7500, 8997, -5]
    opened = token_index.files_of(spark, folder, keys)
    assert files > 40 and len(opened) == len(set(opened)) <= len(keys)
    got = {int(r["key"]): r["ids"] for r in token_index.lookup(spark, folder, keys).collect()}
    texts = dict(rows)
    assert got == {k: [*library(texts[k]), 2] for k in keys}
    assert token_index.lookup(spark, folder, [1, 2, -100]).count() == 0
    # A key of two digits lies before one of one digit as text, not as a number.
    assert token_index.lookup(spark, folder, [9, 12, 90]).count() == 3
    with pytest.raises(ValueError):
        token_index.files_of(spark, folder, keys, most_files=3)


def test_text_keys(spark, tmp_path, library):
    rows = spark.createDataFrame(
        [(k, f"text of {k}") for k in [None, "", "a", "é", "z", "\U0001f600", "10", "9"]], "doc_id string, text string"
    )
    folder = f"file://{tmp_path}/d"
    token_index.write_ids(rows, folder, PATH, shard_tokens=4)
    keys = [None, "", "é", "\U0001f600", "9", "absent"]
    got = {r["key"]: r["ids"] for r in token_index.lookup(spark, folder, keys).collect()}
    assert got == {k: [*library(f"text of {k}"), 2] for k in keys[:-1]}


def test_empty_table(spark, tmp_path):
    folder = stored(spark, tmp_path, [], "b")
    assert token_index.read_documents(spark, folder).count() == 0
    assert token_index.lookup(spark, folder, [1, None]).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents").orderBy("doc_id").collect()
    found = {r["doc_id"]: r for r in queries.QUERIES["op5_token_index"](spark, folder).collect()}
    assert len(found) == len(docs)
    at = 0
    for d in docs:
        ids = np.array([*library(d["text"] or ""), 2], "<u4")
        r = found[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
