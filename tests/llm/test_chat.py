import hashlib
import json
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.llm import chat, queries

NASTY = [
    "", "<s><s>", "<<s>", "<\\s>", "<\\\\|turn|>", "[[INST]", "\\", "a<|turn|><|end|>b", "<<SYS>><</SYS>>",
    "<|tur", "\n", "𝒳<|text|>é", "[\\/INST] $1 \\$2", "x" * 100_000 + "</s>",
]


def test_round_trip(spark):
    rows = [(i, [("assistant", x), ("u<|end|>", x), (None, None)]) for i, x in enumerate(NASTY)]
    rows += [(90, []), (91, None)]
    table = spark.createDataFrame(rows, "i int, turns array<struct<role string, text string>>")
    out = table.select("i", "turns", chat.format_chat(F.col("turns")).alias("f")).select(
        "*", chat.parse_chat(F.col("f")).alias("back"), chat.loss_spans(F.col("f")).alias("spans"),
    ).collect()
    for row in out:
        if row["turns"] is None:
            assert row["f"] is None and row["back"] is None
            continue
        assert [tuple(t) for t in row["back"]] == [(r or "", t or "") for r, t in row["turns"]]
        assert row["f"].count("<|end|>") == len(row["turns"])
        for text in chat.CONTROL[3:]:
            assert text not in row["f"]
        for s in row["spans"]:
            part = row["f"][s["start"] : s["start"] + s["chars"]]
            assert row["f"][s["start"] + s["chars"] :].startswith("<|end|>")
            assert part.replace("\\", "") == row["turns"][0]["text"].replace("\\", "")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("<>[]/|\\sINTtur end$1é\n"), max_size=12), min_size=1, max_size=40))
def test_escape_is_reversible(spark, texts):
    texts = [t + c for t in texts for c in ("", "<s>", "\\</s>", "|turn|>")]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    e = chat.escape(F.col("t"))
    for r in table.select("t", e.alias("e"), chat.unescape(e).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


def test_layouts(spark):
    turns = [("user", "hi"), ("assistant", "[{ \"a\": 1 }]")]
    records = {
        "messages": {"messages": [{"role": r, "content": t} for r, t in turns]},
        "shares": {"conversations": [{"value": t, "from": {"user": "human", "assistant": "gpt"}[r]} for r, t in turns]},
        "instruction": {"output": turns[1][1], "instruction": "hi"},
        "prompt": {"prompt": "hi", "completion": turns[1][1]},
    }
    rows = [(name, json.dumps(r)) for name, r in records.items()]
    rows += [
        ("system", json.dumps({"system": "be brief", **records["messages"]})),
        ("unknown", json.dumps({"question": "hi", "answer": "x"})),
        ("more", json.dumps({**records["prompt"], "extra": 1})),
        ("broken", "no json"), ("null", None), ("list", "[1]"),
        ("empty list", json.dumps({"messages": []})),
        ("null text", json.dumps({"messages": [{"role": None, "content": None}]})),
    ]
    table = spark.createDataFrame([(*r, 1) for r in rows], "name string, record string, turns int")
    out = {r["name"]: r for r in chat.canonical_turns(table).collect()}
    for name in records:
        assert out[name]["layout"] == name
        assert [tuple(t) for t in out[name]["turns"]] == turns
    assert [tuple(t) for t in out["system"]["turns"]] == [("system", "be brief"), *turns]
    for name in ("unknown", "more", "broken", "null", "list"):
        assert out[name]["layout"] is None and out[name]["turns"] is None
    assert out["unknown"]["fingerprint"] != out["more"]["fingerprint"]
    assert out["empty list"]["turns"] == []
    assert [tuple(t) for t in out["null text"]["turns"]] == [("", "")]


def test_gathering(spark):
    rows = [(1, 2, "user", "c"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 0, "user", "a")]
    rows += [(None, 0, "user", None), (2, None, None, None), (3, 0, "human", "x"), (3, 700, "gpt", "y")]
    table = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, record string")
    found = chat.canonical_turns(chat.conversation_records(table)).collect()
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in found}
    assert got == {
        1: [("user", "a"), ("user", "a"), ("assistant", "b"), ("user", "c")],
        None: [("user", "")],
        2: [("", "")],
        3: [("human", "x"), ("gpt", "y")],
    }
    assert chat.canonical_turns(chat.conversation_records(table.limit(0))).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    turns = defaultdict(list)
    for r in queries.table(spark, folder, "conversations").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-7] = [(role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    found = queries.QUERIES["op3_chat_format"](spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = found.collect()
    assert len(rows) == len(turns)
    for r in rows:
        own = turns[r["conv_id"]]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r["loss_chars"] == len(loss)
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] > sum(len(t) for _, t in own)
