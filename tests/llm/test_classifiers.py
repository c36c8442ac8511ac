import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import language_id, queries, text_features, toxicity

SMALL, FOLDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_char_ngrams_count_every_ngram():
    at, n = text_features.char_ngrams("abab É", 15)
    assert n.sum() == 6 + 5 + 4
    assert dict(zip(*text_features.char_ngrams("", 15))) == {}
    again = text_features.char_ngrams("ABAB é", 15)
    assert (again[0] == at).all() and (again[1] == n).all()


def test_word_prefixes():
    at, n, words = text_features.word_prefixes("Abcdefgh abcdxyz, ab 12 abcdefgh", 18)
    # words: 3 distinct; prefixes of 4 (shared by all long words), 5 and 6 (two kinds), 7 (one)
    assert words == 4 and len(at) == 3 + 1 + 2 + 2 + 1
    assert sorted(n.tolist()) == sorted([2, 1, 1, 3, 2, 1, 2, 1, 2])
    assert text_features.word_prefixes("12 .", 18)[2] == 0
    long = text_features.word_prefixes("x" * 100_000 + " y", 18)
    assert long[2] == 2


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    examples = []
    for _ in range(400):
        label = int(rng.integers(0, 3))
        at = np.array([label, 3 + int(rng.integers(0, 500)), 600])
        examples.append((label, at, np.array([1.0, 0.3, 1.0])))
    w = language_id.ftrl(examples, 601, 3)
    assert all((x @ w[at]).argmax() == y for y, at, x in examples)
    harder = language_id.ftrl(examples, 601, 3, l1=1.0)
    assert (harder != 0).sum() < (w != 0).sum()


def test_temperature_minimises_loss():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 2000)
    logits = rng.normal(size=(2000, 3))
    logits[np.arange(2000), labels] += 1.0
    t = language_id._temperature(logits * 5, labels)
    p = lambda x: -np.log(language_id._softmax(logits * 5 / x)[np.arange(2000), labels]).mean()
    assert p(t) <= min(p(t * 1.05), p(t / 1.05), p(1.0))


def test_language_query_on_held_out(spark):
    found = queries.QUERIES["op7_language_id"](spark, FOLDER).toPandas()
    docs = queries.table(spark, FOLDER, "documents").select("doc_id", "lang").toPandas()
    both = found.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert len(both) == 1000 and 100 < len(held) < 300
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_language_cases(spark):
    docs = queries.table(spark, SMALL, "documents")
    model = language_id.fit(docs.filter(~queries.held_out("doc_id")), sample_rows=120)
    assert model.classes == sorted(model.classes) and len(model.classes) >= 3
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 !?", "a"), (4, "the of and " * 30_000, "a")]
    rows += [(5, "the of and that", "b"), (5, "the of and that", "b"), (None, "the of and that", "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = language_id.predict(table, model)
    assert out.columns == ["doc_id", "text", "score", "lang_pred"]
    got = out.collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and [r["score"] for r in got[:3]] == [0.0] * 3
    assert got[3]["lang_pred"] == "en"
    assert len({(r["lang_pred"], r["score"]) for r in got[4:]}) == 1
    assert language_id.predict(table.limit(0), model).count() == 0
    nothing = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(table, nothing).collect()} == {"und"}


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(0)
    examples = []
    for _ in range(900):
        grade = int(rng.integers(0, 3))
        # More of the bad features, the worse; noise features are many.
        at = np.concatenate([rng.permutation(20)[: 4 * grade], 20 + rng.permutation(400)[:10]])
        examples.append((grade, at, np.ones(len(at))))
    w, t = toxicity.fit_ordinal(examples[:600], 420, 3)
    assert (w >= 0).all() and (np.diff(t) > 0).all()
    guess = [int((w[at] @ x > t).sum()) for _, at, x in examples[600:]]
    truth = [g for g, _, _ in examples[600:]]
    assert np.mean(np.array(guess) == truth) > 0.9
    assert w[:20].mean() > 10 * w[20:].mean()


def test_toxicity_query(spark):
    found = queries.QUERIES["op10_toxicity"](spark, FOLDER).toPandas()
    labels = queries.table(spark, FOLDER, "labels").toPandas()
    both = found.merge(labels, on="doc_id", suffixes=("", "_label"))
    assert len(found) == 1000 and found.severity.between(0, 2).all()
    bad = both[both.toxic_label == 1]
    assert bad.toxic.mean() > 0.9
    assert both[both.toxic_label == 0].toxic.mean() < 0.01
    assert bad.severity.mean() > 1 > both[both.toxic_label == 0].severity.max() * 0.9


def test_toxicity_held_out(spark):
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    labels = queries.table(spark, "/root/testdata/sf0.1", "labels").select("doc_id", "toxic")
    rows = docs.join(labels, "doc_id")
    model = toxicity.fit_flags(rows.filter("doc_id % 2 = 0"))
    out = toxicity.predict(rows.filter("doc_id % 2 = 1"), model).toPandas()
    assert (out[out.toxic == 1].grade > 0).mean() > 0.85
    assert (out[out.toxic == 0].grade > 0).mean() < 0.005


def test_toxicity_cases(spark):
    rows = [(1, "bad bad words here", 2), (2, "good words here", 0), (3, None, 1), (4, "", 0), (5, "bad", None)]
    table = spark.createDataFrame(rows * 4, "doc_id long, text string, grade int")
    model = toxicity.fit(table)
    out = toxicity.predict(table, model)
    assert out.columns == ["doc_id", "text", "grade", "severity"] and out.count() == 20
    by_text = {(r["text"] or ""): r["severity"] for r in out.collect()}
    assert by_text["bad bad words here"] > by_text["good words here"] >= by_text[""]
    assert toxicity.predict(table.limit(0), model).count() == 0
    none = toxicity.fit(table.limit(0))
    assert {r["grade"] for r in toxicity.predict(table, none).collect()} == {0}
    with pytest.raises(ValueError):
        toxicity.draw(table.selectExpr("doc_id", "7 as grade"), "grade")


def test_draw_is_bounded_and_even(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "cast(case when id % 50 = 0 then 1 when id % 7 > 0 then 0 end as int) as g")
    got = toxicity.draw(rows, "g", grades=2, most=160).collect()
    assert len(got) == 160 and sum(r["g"] for r in got) == 80
    again = toxicity.draw(rows.repartition(7), "g", grades=2, most=160).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert toxicity.draw(rows.limit(0), "g").count() == 0


def test_every_label_is_learned(spark):
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(70)]
    rows = [(i * 40 + n, f"{w} {w}{w} " * 5, f"l{i:02}") for i, w in enumerate(words) for n in range(12 if i else 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(table)
    assert len(model.classes) == 70
    out = language_id.predict(table, model).select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95
    with pytest.raises(ValueError):
        language_id.fit(table, most_classes=69)


def test_a_repeated_id_is_one_example(spark):
    docs = spark.range(3000).selectExpr("1L as doc_id", "concat('text ', id) as text").unionByName(
        spark.createDataFrame([(2, "good"), (2, None), (3, None)], "doc_id long, text string")
    )
    flags = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = toxicity.one_text(docs.join(flags, "doc_id"), "toxic").collect()
    assert sorted((r["doc_id"], r["toxic"]) for r in got) == [(1, 1), (2, 0), (3, 0)]
    again = toxicity.one_text(docs.repartition(5).join(flags, "doc_id"), "toxic").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_too_many_examples_fail(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_EXAMPLES", 10)
    rows = spark.range(11).selectExpr("id as doc_id", "'a word' as text", "1 as toxic")
    with pytest.raises(ValueError):
        toxicity.fit_flags(rows)


def bucket(value, bits):
    value ^= value >> 29
    return (value * text_features.MULTIPLIER % (1 << 64)) >> (64 - bits)


def slow_ngrams(text, bits):
    """Counts of hashed character n-grams, one n-gram at a time in plain integers."""
    points, counts = [ord(c) for c in text.lower()], {}
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            h = 0
            for k in range(n):
                h = (h * text_features.BASE + points[i + k] + k + 1) % (1 << 64)
            counts[bucket(h, bits)] = counts.get(bucket(h, bits), 0) + 1
    return counts


def slow_language(text, model):
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    x = {b: (1 + math.log(n)) * model.idf[b] for b, n in slow_ngrams(text, model.bits).items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    z = [
        (model.bias[c] + sum(v / norm * float(model.weights[b, c]) for b, v in x.items())) / model.temperature
        for c in range(len(model.classes))
    ]
    top = max(z)
    p = [math.exp(v - top) for v in z]
    best = max(range(len(p)), key=p.__getitem__)
    return model.classes[best], p[best] / sum(p)


def test_language_scores_against_brute_force(spark):
    docs = queries.table(spark, SMALL, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~queries.held_out("doc_id")))
    rows = docs.filter(F.length("text") < 3000)
    out = language_id.predict(rows, model).collect()
    query = {r["doc_id"]: r for r in queries.QUERIES["op7_language_id"](spark, SMALL).collect()}
    assert len(out) > 100
    for r in out:
        label, score = slow_language(r["text"], model)
        assert (r["lang_pred"], r["score"]) == (label, pytest.approx(score, abs=1e-5))
        assert (query[r["doc_id"]]["lang_pred"], query[r["doc_id"]]["score"]) == (label, pytest.approx(score, abs=1e-5))


def slow_severity(text, model):
    """Expected severity from a dictionary of words and prefixes."""
    words, word = [], ""
    for c in [*(text or "").lower(), " "]:
        if c.isalpha() if ord(c) < text_features.LATIN else True:
            word += c
        elif word:
            words.append(word)
            word = ""
    counts = {}
    for w in words:
        # A whole word and a prefix of it are different features.
        for n in (n for n in (4, 5, 6, 7) if n < len(w)):
            h = sum(ord(c) * text_features.BASE**i for i, c in enumerate(w[:n]))
            b = bucket((h + n * 0xABCDEF12345) % (1 << 64), model.bits)
            counts[b] = counts.get(b, 0) + 1
        b = bucket(sum(ord(c) * text_features.BASE**i for i, c in enumerate(w)) % (1 << 64), model.bits)
        counts[b] = counts.get(b, 0) + 1
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    scale = 4 / max(1, len(words)) ** (1 / 3)
    z = sum(weights.get(b, 0.0) * math.log1p(n) * scale for b, n in counts.items())
    over = [1 / (1 + math.exp(-max(-40, min(40, z - t)))) for t in model.thresholds]
    return sum(over), sum(p >= 0.5 for p in over)


def test_severity_against_brute_force(spark):
    docs = queries.table(spark, FOLDER, "documents").select("doc_id", "text")
    flags = queries.table(spark, FOLDER, "labels").select("doc_id", "toxic")
    model = toxicity.fit_flags(toxicity.one_text(docs.join(flags, "doc_id"), "toxic"))
    out = toxicity.predict(docs.filter("doc_id < 400"), model).collect()
    assert sum(r["grade"] > 0 for r in out) > 0
    for r in out:
        severity, grade = slow_severity(r["text"], model)
        assert r["severity"] == pytest.approx(severity, abs=1e-6) and r["grade"] == grade
