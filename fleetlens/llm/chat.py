"""Chat formatting with native expressions only.

1. A record is JSON text in one of many layouts (prompt and completion, instruction and output, lists
   of messages). Its nested field paths are hashed to a fingerprint; a declarative ``Layout`` that
   has the same paths says where the turns are. Records whose fingerprint no layout has are
   returned with a null ``turns`` and their fingerprint, never dropped.
2. Canonical turns are written with a template that marks turns by control strings. Control strings
   inside texts are broken up by a backslash after their first character, which is reversible.
3. The formatted text is parsed back, and the spans under the loss mask are the assistant's texts.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common templates, protected inside texts besides our own.
CONTROL = (
    OPEN, ROLE_END, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>",
)
TURNS = "array<struct<role:string,text:string>>"
JSON = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class Layout:
    """Where the turns of one layout are.

    Either ``turns``: (role, field) pairs in order, or ``messages``: a list field with its ``role`` and
    ``text`` fields; ``roles`` renames role values. ``optional`` fields may be absent; ``ignored``
    ones are known and carry no turn.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()

    def path_sets(self) -> list[tuple[str, ...]]:
        """Every set of nested field paths that a record of this layout may have."""
        if self.messages:
            must = {f"{self.messages}[].{self.role}", f"{self.messages}[].{self.text}"}
        else:
            must = {field for _, field in self.turns if field not in self.optional}
        free = [*self.optional, *self.ignored]
        return [
            tuple(sorted(must.union(some)))
            for n in range(len(free) + 1)
            for some in itertools.combinations(free, n)
        ] + ([(self.messages,)] if self.messages else [])  # an empty list has no inner paths


LAYOUTS = (
    Layout("messages", messages="messages", optional=("system",)),
    Layout(
        "shares",
        messages="conversations",
        role="from",
        text="value",
        roles=(("human", "user"), ("gpt", "assistant")),
    ),
    Layout(
        "instruction",
        turns=(("system", "system"), ("user", "instruction"), ("assistant", "output")),
        optional=("system",),
    ),
    Layout(
        "prompt",
        turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")),
        optional=("system",),
    ),
)


def _paths(record: Column, lists: list[str]) -> Column:
    """Sorted nested field paths of a JSON object; only fields named in ``lists`` are entered."""
    fields = F.map_entries(F.from_json(record, "map<string,string>", JSON))

    def inner(field: Column) -> Column:
        parts = F.from_json(field["value"], "array<map<string,string>>", JSON)
        names = F.array_distinct(F.flatten(F.transform(parts, lambda m: F.map_keys(m))))
        below = F.transform(names, lambda n: F.concat(field["key"], F.lit("[]."), n))
        return F.when(
            field["key"].isin(lists) & (F.size(F.coalesce(names, F.array())) > 0), below
        ).otherwise(F.array(field["key"]))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(fields, inner))))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def canonical_turns(
    records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """``records`` with fingerprint, layout and ``turns`` array<struct<role, text>>.

    A turn field that is null or absent makes no turn, a null text inside a list is empty, a null
    role is the empty role. Text that is no JSON object, or has other paths than every layout, has a
    null layout and null turns. Other columns stay; columns with the three output names are
    replaced. Layouts must not share a path set; the first one named would win.
    """
    lists = [x.messages for x in layouts if x.messages]
    marked = records.withColumn("_record", F.col(record)).withColumn(
        "fingerprint", fingerprint(_paths(F.col("_record"), lists))
    )
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in reversed(layouts):
        own = F.col("fingerprint").isin(
            [
                row[0]
                for row in _constants(records, [fingerprint(F.array(*map(F.lit, p))) for p in x.path_sets()])
            ]
        )
        layout = F.when(own, F.lit(x.name)).otherwise(layout)
        turns = F.when(own, _turns(F.col("_record"), x)).otherwise(turns)
    return marked.withColumns({"layout": layout, "turns": turns}).drop("_record")


def _constants(records: DataFrame, values: list[Column]) -> list[tuple[int]]:
    """Values of constant expressions, worked out by the session without reading a table."""
    row = records.sparkSession.range(1).select(*[v.alias(f"c{i}") for i, v in enumerate(values)])
    return [(v,) for v in row.first()]


def _turns(record: Column, layout: Layout) -> Column:
    fields = F.from_json(record, "map<string,string>", JSON)
    if layout.messages:
        parts = F.from_json(fields[layout.messages], "array<map<string,string>>", JSON)
        roles = F.create_map(*[F.lit(x) for pair in layout.roles for x in pair]) if layout.roles else None

        def turn(part: Column) -> Column:
            role = F.coalesce(part[layout.role], F.lit(""))
            if roles is not None:
                role = F.coalesce(roles[role], role)
            return F.struct(
                role.alias("role"), F.coalesce(part[layout.text], F.lit("")).alias("text")
            )

        listed = F.transform(parts, turn)
        if "system" in layout.optional:
            first = F.struct(F.lit("system").alias("role"), fields["system"].alias("text"))
            listed = F.when(
                fields["system"].isNotNull(), F.concat(F.array(first), listed)
            ).otherwise(listed)
        return listed.cast(TURNS)
    given = F.array(
        *[
            F.struct(F.lit(role).alias("role"), fields[field].alias("text"))
            for role, field in layout.turns
        ]
    )
    return F.filter(given, lambda t: t["text"].isNotNull()).cast(TURNS)


def _broken(control: tuple[str, ...], escaped: bool) -> str:
    """Pattern of a control string with any number of backslashes after its first character."""
    kinds: dict[str, list[str]] = {}
    for text in sorted(set(control), key=lambda t: (-len(t), t)):
        kinds.setdefault(text[0], []).append(re.escape(text[1:]))
    slash = r"\\(\\*)" if escaped else r"(\\*)"
    rests = sorted({r for found in kinds.values() for r in found}, key=lambda r: (-len(r), r))
    firsts = "".join(re.escape(c) for c in sorted(kinds))
    # The rest is looked at, not taken, as it may begin the next control string.
    return f"([{firsts}]){slash}(?=(?:{'|'.join(rests)}))"


def escape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    return F.regexp_replace(text, _broken(control, False), r"$1\\$2")


def unescape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    return F.regexp_replace(text, _broken(control, True), "$1$2")


def format_chat(turns: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """One text per conversation; null turns give null, no turns the empty text."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.concat(
                F.lit(OPEN),
                escape(F.coalesce(t["role"], F.lit("")), control),
                F.lit(ROLE_END),
                escape(F.coalesce(t["text"], F.lit("")), control),
                F.lit(CLOSE),
            ),
        ),
        "",
    )


def parse_chat(formatted: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """The turns of a formatted text: the inverse of ``format_chat``."""
    cut = F.split(formatted, re.escape(OPEN))
    parts = F.slice(cut, 2, F.size(cut))

    def turn(part: Column) -> Column:
        sides = F.split(part, re.escape(ROLE_END))
        body = sides[1]
        return F.struct(
            unescape(sides[0], control).alias("role"),
            unescape(body.substr(F.lit(1), F.length(body) - len(CLOSE)), control).alias("text"),
        )

    return F.transform(parts, turn)


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """array<struct<start, chars>>: places (0-based code points) that the loss counts.

    These are the texts of ``role``, without its marks.
    """
    cut = F.split(formatted, re.escape(OPEN))
    parts = F.slice(cut, 2, F.size(cut))
    begun = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans")
    )

    def step(seen: Column, part: Column) -> Column:
        head = F.instr(part, ROLE_END) - 1
        text = F.length(part) - head - len(ROLE_END) - len(CLOSE)
        span = F.struct(
            (seen["at"] + len(OPEN) + head + len(ROLE_END)).cast("int").alias("start"),
            text.cast("int").alias("chars"),
        )
        own = part.substr(F.lit(1), head) == role
        return F.struct(
            (seen["at"] + len(OPEN) + F.length(part)).cast("int").alias("at"),
            F.when(own, F.concat(seen["spans"], F.array(span)))
            .otherwise(seen["spans"])
            .alias("spans"),
        )

    return F.aggregate(parts, begun, step, lambda seen: seen["spans"])


def conversation_records(
    rows: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    piece: int = 256,
) -> DataFrame:
    """(``conversation``, record): rows by turn gathered into records of the layouts that fit them.

    A user turn followed by an assistant turn only becomes an instruction or a prompt record, any
    other conversation a list of messages; which of two layouts depends on the id. Turns are ordered
    by ``turn`` (null first), then role and text; repeated rows are repeated turns. A null id is a
    conversation of its own. Turns are gathered in pieces of ``piece`` turn numbers first, so that only
    finished pieces meet; a conversation must fit into one row, as its output is one text.
    """
    sides = F.struct(
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    pieces = rows.groupBy(
        F.col(conversation).alias("conv"), F.floor(F.col(turn) / piece).alias("piece")
    ).agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), sides.alias("t")))).alias("part"))
    whole = pieces.groupBy("conv").agg(
        F.flatten(
            F.transform(
                F.sort_array(F.collect_list(F.struct("piece", "part"))), lambda p: p["part"]
            )
        ).alias("all")
    )
    turns = whole.select("conv", F.transform("all", lambda x: x["t"]).alias("turns"))
    pair = (F.size("turns") == 2) & (
        F.transform("turns", lambda t: t["role"]) == F.array(F.lit("user"), F.lit("assistant"))
    )
    even = F.coalesce(F.col("conv") % 2 == 0, F.lit(True))
    question, answer = F.col("turns")[0]["text"], F.col("turns")[1]["text"]

    def messages(role_name: str, text_name: str, renamed: dict[str, str]) -> Column:
        def one(t: Column) -> Column:
            named = t["role"]
            for old, new in renamed.items():
                named = F.when(t["role"] == old, F.lit(new)).otherwise(named)
            return F.struct(named.alias(role_name), t["text"].alias(text_name))

        return F.transform("turns", one)

    plain = F.exists("turns", lambda t: t["role"].isin("human", "gpt"))
    record = (
        F.when(
            pair & even,
            F.to_json(F.struct(question.alias("instruction"), answer.alias("output"))),
        )
        .when(pair, F.to_json(F.struct(question.alias("prompt"), answer.alias("completion"))))
        .when(
            even | plain,
            F.to_json(F.struct(messages("role", "content", {}).alias("messages"))),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    messages("from", "value", {"user": "human", "assistant": "gpt"}).alias(
                        "conversations"
                    )
                )
            )
        )
    )
    return turns.select(F.col("conv").alias(conversation), record.alias("record"))
