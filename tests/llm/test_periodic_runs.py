import hashlib
import random
import zlib

import numpy as np
import pytest

from fleetlens.llm import queries
from fleetlens.llm.periodic_runs import Grammar, collapse_runs, runs_of, word_ids, words_of


def naive(words, least=12):
    """(start, length, period) of all runs, by comparing the words at every distance."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        begin = None
        for i in range(len(words) - p + 1):
            same = i + p < len(words) and words[i] == words[i + p]
            if same and begin is None:
                begin = i
            if not same and begin is not None:
                if i - begin + p >= max(least, 2 * p):
                    found.setdefault((begin, i - begin + p), p)
                begin = None
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(words, runs):
    goes = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in goes]


def found_in(texts, least=12):
    ids, ends = word_ids(texts)
    text, start, stop, period = runs_of(ids, ends, least)
    begin = np.append(0, ends)
    return [
        [(s - begin[i], e - s, p) for s, e, p in zip(start[text == i], stop[text == i], period[text == i])]
        for i in range(len(texts))
    ]


def random_texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        n, letters = rng.randrange(90), rng.choice([1, 2, 2, 3, 5, 40])
        words = [str(rng.randrange(letters)).encode() for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randrange(1, 12)
            words = [words[min(n - 1, a + (i - a) % p)] if i >= a else words[i] for i in range(n)]
        yield words


def fibonacci(n):
    a, b = b"b", b"a"
    while len(b) < n:
        a, b = b, b + a
    return [b[i : i + 1] for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least", [9, 12])
def test_runs_are_those_of_brute_force(seed, least):
    texts = list(random_texts(seed, 250))
    assert found_in(texts, least) == [naive(words, least) for words in texts]


def test_highly_repetitive_words():
    texts = [fibonacci(n) for n in (11, 12, 13, 144, 300)]
    texts.append([b"01"[i.bit_count() % 2 : i.bit_count() % 2 + 1] for i in range(256)])
    texts += [[b"a"] * n for n in (0, 1, 11, 12, 500)]
    assert found_in(texts) == [naive(words) for words in texts]


def test_grammar_derives_the_words_and_replaces_frequent_pairs():
    words = list(random_texts(9, 1))[0] or fibonacci(60)
    words = words + fibonacci(100) + words
    ids, ends = word_ids([words])
    g = Grammar(ids, ends)
    for rule in np.unique(g.rule):
        at = np.flatnonzero(g.rule == rule)
        spelled = {tuple(ids[g.first[i] : g.end[i]].tolist()) for i in at}
        assert len(spelled) == 1, "all places of a rule spell the same words"
    whole = g.end - g.first == len(words)
    assert whole.sum() == 1
    # The first rule stands for a pair that no other pair outnumbers.
    pairs = list(zip(words, words[1:]))
    counts = {}
    for pair in set(pairs):
        i = n = 0
        while i < len(pairs):
            n, i = (n + 1, i + 2) if pairs[i] == pair else (n, i + 1)
        counts[pair] = n
    first = g.first[0]
    assert counts[words[first], words[first + 1]] == max(counts.values())


def test_a_long_text_is_one_slice(monkeypatch, spark):
    monkeypatch.setattr("fleetlens.llm.periodic_runs.SLICE_WORDS", 100)
    words = [str(i % 7) for i in range(5000)] + [str(i) for i in range(50)]
    rows = spark.createDataFrame([(1, "a b"), (2, " ".join(words)), (3, "c " * 30)], "k int, text string")
    got = {r.k: r for r in collapse_runs(rows).collect()}
    assert [tuple(r) for r in got[2].runs] == [(0, 5000, 7)]
    assert bytes(got[2].collapsed).decode().split() == words[:7] + words[5000:]
    assert got[1].runs == [] and [tuple(r) for r in got[3].runs] == [(0, 30, 1)]
    assert [got[k].n_words for k in (1, 2, 3)] == [2, 5050, 30]


def test_edge_cases(spark):
    rows = spark.createDataFrame(
        [(1, None, "x"), (1, "", "x"), (None, "a \t" * 12, "x"), (None, "a \t" * 12, "x"), (4, "ä\x0bä\x1c b", "x")],
        "doc_id int, text string, runs string",
    )
    got = collapse_runs(rows).collect()
    assert set(collapse_runs(rows).columns) == {"doc_id", "text", "runs", "collapsed", "n_words"}
    by = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in got)
    assert by == [
        (0, 12, [(0, 12, 1)], b"a"),
        (0, 12, [(0, 12, 1)], b"a"),
        (1, 0, [], b""),
        (1, 0, [], b""),
        (4, 3, [], "ä ä\x1c b".encode()),
    ]
    assert collapse_runs(rows.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in queries.table(spark, folder, "documents").collect()}
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, folder).collect()}
    assert got.keys() == docs.keys()
    made = 0
    for doc, text in docs.items():
        words = words_of(text)
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = naive(words)
        made += bool(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        row = got[doc]
        assert row.n_runs == len(runs)
        expected = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (row.start, row.length, row.period, row.exponent_milli) == expected
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()
    assert made > 10
