import hashlib

import public_tokenizers
import pytest
import regex

from fleetlens.llm import byte_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return byte_bpe.encoder(byte_bpe.read_ranks(RANKS))


def pieces(enc, text):
    """Each match of the pattern on its own."""
    return [
        i
        for m in regex.finditer(public_tokenizers.PATTERN, text)
        for i in enc._encode_single_piece(m.group())
    ]


TEXTS = [
    "",
    "it's   a test\n\n  of 'll words\t\tand   spaces ",
    "漢字 and ñandú, ١٢٣ 5½ <|endoftext|> x  y",
    "é 🙂🙂 \x1c\x1d \x00 end",
]


def test_blocks_give_the_ids_of_the_whole(enc):
    split = regex.compile(public_tokenizers.PATTERN)
    for text in [*TEXTS, "  ".join(TEXTS) * 20]:
        assert enc.encode_ordinary(text) == pieces(enc, text)
        for block in (1, 2, 3, 7, 50):
            assert byte_bpe.encode_text(enc, split, text, block) == enc.encode_ordinary(text)
            assert "".join(byte_bpe.safe_blocks(text, block)) == text


def test_long_runs_of_one_kind(enc):
    split = regex.compile(public_tokenizers.PATTERN)
    for text in (" " * 300_000 + "x", "." * 200_000, "a" * 200_000, "\n" * 150_000, "ab1" * 60_000):
        ids = byte_bpe.encode_text(enc, split, text)
        assert enc.decode_bytes(ids) == text.encode()
        assert ids == pieces(enc, text)


def test_tables(spark, enc):
    rows = [(i, t, "kept") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (1, TEXTS[1], "kept")]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.decode(byte_bpe.encode(table, RANKS), RANKS, out="raw")
    assert out.columns == ["doc_id", "text", "ids", "raw"]
    found = out.collect()
    assert len(found) == len(rows)
    for row in found:
        text = row["text"] or ""
        assert row["ids"] == enc.encode_ordinary(text)
        assert bytes(row["raw"]) == text.encode()
    assert byte_bpe.encode(table.limit(0), RANKS).count() == 0


def test_one_pass_gives_what_two_give(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, None])]
    table = spark.createDataFrame(rows, "doc_id long, text string, bytes string")
    once = byte_bpe.round_trip(table, RANKS)
    twice = byte_bpe.decode(byte_bpe.encode(table, RANKS), RANKS)
    assert sorted(once.columns) == sorted(twice.columns)
    names = once.columns
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.select(*names).collect()))
    assert byte_bpe.round_trip(table.limit(0), RANKS).count() == 0


def test_raw_bytes_need_not_be_text(spark, enc):
    ids = enc.encode_ordinary("🙂漢")
    table = spark.createDataFrame([(ids[:1],), (None,), ([],)], "ids array<int>")
    found = [r["bytes"] for r in byte_bpe.decode(table, RANKS).collect()]
    assert bytes(found[0]) == enc.decode_bytes(ids[:1]) and found[1] is None and found[2] == b""


def test_query(spark, enc):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, folder, "documents").collect()}
    for row in queries.QUERIES["op1_byte_bpe"](spark, folder).collect():
        ids = enc.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
