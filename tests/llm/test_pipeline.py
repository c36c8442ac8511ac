import public_tokenizers
import pytest

import corpus_pipeline
from fleetlens.llm import byte_bpe, queries
from tests.llm.test_decontaminate import overlaps, words
from tests.llm.test_near_copies import grams, jaccard
from tests.llm.test_simhash import roots

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage returns."""
    base = tmp_path_factory.mktemp("stages")
    docs = queries.table(spark, FOLDER, "documents")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"file://{base}/{name}")
        docs = out[name] = spark.read.parquet(f"file://{base}/{name}")
    return out


def texts(table):
    return {r["doc_id"]: r["text"] for r in table.collect()}


def test_names_and_columns(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_language_keeps_what_has_letters(stages):
    before, after = texts(stages["documents"]), texts(stages["language_id"])
    assert after == {d: t for d, t in before.items() if t and any(c.isalpha() for c in t)}


def test_exact_copies(stages):
    before, after = texts(stages["language_id"]), texts(stages["exact_dedup"])
    last = {}
    for d, t in before.items():
        last[t] = max(d, last.get(t, d))
    assert after == {d: before[d] for d in last.values()} and len(after) < len(before)


def test_near_copies(stages):
    """The kept documents are those of brute force with the exact five-word similarity."""
    before, after = texts(stages["exact_dedup"]), texts(stages["simhash_near_dedup"])
    ids, sets = sorted(before), {d: grams(t) for d, t in before.items()}
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if jaccard(sets[a], sets[b]) >= 0.8]
    assert pairs and set(after) == set(roots(ids, pairs).values())


def test_leaks(spark, stages):
    before, after = texts(stages["simhash_near_dedup"]), texts(stages["decontamination"])
    items = [words(r["text"]) for r in queries.table(spark, FOLDER, "benchmark").collect()]
    for d, t in before.items():
        own = words(t)
        grams = set(zip(own, own[1:], own[2:]))
        bad = any(not grams.isdisjoint(zip(w, w[1:], w[2:])) and overlaps(own, w) for w in items)
        assert (d not in after) == bad


def test_ids(stages):
    enc = byte_bpe.encoder(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    before = texts(stages["decontamination"])
    found = {r["doc_id"]: r["n_tokens"] for r in stages["byte_bpe"].collect()}
    assert found == {d: len(enc.encode_ordinary(t)) for d, t in before.items()}


CASES = [
    (1, None, "en", None, 0), (2, "", None, "s", 0), (3, "12 34", "en", "s", 5), (None, "the one and the other", "en", "s", 1),
    (4, "the same words here", "en", "s", 1), (5, "the same words here", "fr", None, 1), (5, "the same words here", "fr", None, 1),
    (6, "la casa de la noche", "es", "s", 1), (6, "une autre chose encore", "fr", "s", 1), (7, "word " * 60_000, "en", "s", 1),
]


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(CASES, "doc_id long, text string, lang string, source string, n_chars long")
    names = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"file://{tmp_path}/{number}")
        docs = spark.read.parquet(f"file://{tmp_path}/{number}")
        names.append(sorted(repr(r["doc_id"]) for r in docs.collect()))
    assert names[0] == sorted(map(repr, [None, 4, 5, 5, 6, 6, 7]))
    assert names[1] == names[-1] == sorted(map(repr, [None, 5, 6, 6, 7]))


def test_empty_table(spark, tmp_path):
    docs = queries.table(spark, FOLDER, "documents").limit(0)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"file://{tmp_path}/{number}")
        docs = spark.read.parquet(f"file://{tmp_path}/{number}")
        assert docs.count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(names) and corpus_pipeline.ORACLE_SQL is None
    # Reading them back, the folder for intermediate tables is the session's.
    assert corpus_pipeline.run(spark, FOLDER).count() > 100
