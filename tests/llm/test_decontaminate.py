import random
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from fleetlens.llm import decontaminate, queries


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def overlaps(doc, item, overlap=13, share=0.8):
    """Brute force: every offset, every run."""
    need = min(overlap, len(item))
    for offset in range(-len(item) + 1, len(doc)):
        equal = [
            0 <= i + offset < len(doc) and doc[i + offset] == item[i] for i in range(len(item))
        ]
        inside = [0 <= i + offset < len(doc) for i in range(len(item))]
        for a in range(len(item) - need + 1):
            if all(inside[a : a + need]) and sum(equal[a : a + need]) >= np.ceil(share * need):
                return True
    return False


@given(st.lists(st.integers(0, 2**63), min_size=0, max_size=40))
def test_a_seed_ignores_its_masked_words(values):
    base = np.array(values, np.uint64)
    for number, mask in enumerate(decontaminate.MASKS):
        found = decontaminate.seeds_of(base, decontaminate.MASKS)[number]
        assert len(found) == max(0, len(base) - len(mask) + 1)
        for offset, bit in enumerate(mask):
            if len(found):
                changed = base.copy()
                changed[offset] ^= np.uint64(1)
                again = decontaminate.seeds_of(changed, decontaminate.MASKS)[number]
                assert (again[0] == found[0]) == (bit == "0")


def run(spark, docs, items, **settings):
    left = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    right = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    return decontaminate.contaminations(left.repartition(3), right, **settings).collect()


def test_substitutions_and_nulls(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 60)))) for i in range(40)]
    docs = []
    for number in range(160):
        text = rng.choices(vocabulary, k=rng.randint(0, 120))
        if number % 2:
            passage = words(rng.choice(items)[1])
            for _ in range(number % 5):  # some words substituted, far apart or not
                passage[rng.randrange(len(passage))] = "sub"
            if number % 3 == 0:  # only a part of the passage
                passage = passage[3:]
            text[10:10] = passage
        docs.append((number, " ".join(text).upper() if number % 7 == 0 else " ".join(text)))
    docs += [(900, None), (901, ""), (None, items[0][1]), (902, items[1][1]), (902, items[1][1])]
    items += [(50, items[2][1]), (60, None), (61, ""), (62, "too short")]
    found = run(spark, docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in found}
    first = {}
    for i, t in items:
        if t is not None:
            first.setdefault(t, i)
    want = {
        (d, i)
        for d, text in docs
        for t, i in first.items()
        if len(words(t)) >= 8 and overlaps(words(text), words(t))
    }
    assert got <= want
    # Masks of weight eight find nearly all passages with a fifth of their words substituted.
    assert len(got) >= 0.95 * len(want)
    exact = {(d, i) for d, text in docs for t, i in first.items() if len(words(t)) >= 8
             and f" {' '.join(words(t))} " in f" {' '.join(words(text))} "}
    assert exact <= got
    assert (None, 0) in got and sum(r["doc_id"] == 902 for r in found) == 2
    assert {r["members"] for r in found if r["item_id"] == 2} <= {2}


def test_many_documents_share_a_passage(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(i, f"a{i} {passage} b{i}") for i in range(400)]
    found = run(spark, docs, [(1, passage), (2, passage + " and more")])
    assert len(found) == 800 and {r["equal_words"] for r in found} == {20}


def test_empty_sides_and_small_filter(spark):
    docs, items = [(1, " ".join(map(str, range(30))))], [(1, " ".join(map(str, range(5, 25))))]
    assert len(run(spark, docs, items, filter_bits=6)) == 1
    assert len(run(spark, docs, items)) == 1
    left = spark.createDataFrame([], "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contaminations(left, right).count() == 0
    assert decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), right.limit(0)).count() == 0


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(d["doc_id"], words(d["text"])) for d in queries.table(spark, folder, "documents").collect()]
    items = [(b["item_id"], words(b["text"])) for b in queries.table(spark, folder, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op9_decontamination"](spark, folder).collect()}
    # An overlap of 11 of 13 words shares at least one word triple.
    grams = [(i, w, {tuple(w[a : a + 3]) for a in range(len(w) - 2)}) for i, w in items]
    want = {
        (d, i)
        for d, text in docs
        for i, w, g in grams
        if not g.isdisjoint(zip(text, text[1:], text[2:])) and overlaps(text, w)
    }
    assert got == want and got
