import random

import pytest
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.functions import scalars as sc


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    ("rules", "text", "ok", "expected"),
    [
        (fv.CONFIGURE_RULES, "it was already configured", False, "already_done"),
        (fv.CONFIGURE_RULES, "has already been configured", True, "already_done"),
        (fv.CONFIGURE_RULES, "Already Configured", False, "failed"),
        (fv.ADD_RULES, "is already a member", False, "already_done"),
        (fv.ADD_RULES, "node is already part of it", False, "already_done"),
        (fv.ADD_RULES, "ALREADY A MEMBER", False, "failed"),
        (fv.CREATE_RULES, "metadata not found", False, "not_found"),
        (fv.CREATE_RULES, "does not exist", False, "not_found"),
        (fv.CREATE_RULES, "a standalone instance", False, "not_found"),
        (fv.CREATE_RULES, "Not Found", False, "failed"),
        (fv.INSTALL_RULES, "Plugin ALREADY EXISTS", False, "already_done"),
        (fv.INSTALL_RULES, "Duplicate entry", False, "already_done"),
        (fv.INSTALL_RULES, "already exists", True, "ok"),
        (fv.INSTALL_RULES, None, None, "failed"),
        (fv.INSTALL_RULES, None, True, "ok"),
    ],
)
def test_classify_output(spark, rules, text, ok, expected):
    column = sc.classify_output(F.col("text"), F.col("ok"), rules)
    assert values(spark, [(text, ok)], "text string, ok boolean", column) == [expected]


def test_strip_and_tokens_follow_python(spark):
    seeded = random.Random(7)
    alphabet = "ab\x85\xa0 　 \t\r\x0b\x1cKEYkey=\n"
    texts = ["".join(seeded.choices(alphabet, k=seeded.randrange(0, 40))) for _ in range(300)]

    def last_token(text):
        for line in text.split("\n"):
            if "key" in line.lower() and len(line.split()) >= 2:
                return line.split()[-1]
        return "none"

    rows = [(t,) for t in texts]
    assert values(spark, rows, "t string", sc.strip(F.col("t"))) == [t.strip() for t in texts]
    got = values(spark, rows, "t string", sc.kv_last_token(F.col("t"), "Key", "none"))
    assert got == [last_token(t) for t in texts]


def test_kv_last_token_default_on_failure(spark):
    column = sc.kv_last_token(F.col("t"), "plugin_dir", fv.DEFAULT_PLUGIN_DIR, F.col("ok"))
    rows = [("plugin_dir\t/opt/p/", True), ("plugin_dir /opt/p/", False), ("plugin_dir", True), (None, True)]
    default = fv.DEFAULT_PLUGIN_DIR
    assert values(spark, rows, "t string, ok boolean", column) == ["/opt/p/", default, default, default]


def test_has_plugin_with_and_without_exit_code(spark):
    rows = [("ENGINE disabled", False), ("none", True), (None, True)]
    schema = "t string, ok boolean"
    assert values(spark, rows, schema, sc.has_plugin(F.col("t"), "engine")) == [True, False, False]
    with_ok = sc.has_plugin(F.col("t"), "engine", F.col("ok"))
    assert values(spark, rows, schema, with_ok) == [False, False, False]


def test_service_state(spark):
    rows = [(" active\n", True), ("inactive", True), ("active", False), (None, None)]
    schema = "t string, ok boolean"
    assert values(spark, rows, schema, sc.service_active(F.col("t"))) == [True, False, True, False]
    loose = sc.service_active_loose(F.col("t"), F.col("ok"))
    assert values(spark, rows, schema, loose) == [True, True, False, False]
    assert values(spark, [("true\n",), ("True",)], "t string", sc.container_running(F.col("t"))) == [
        True,
        False,
    ]


def test_size_mb_rounds_as_python_does(spark):
    sizes = [n * 131072 for n in range(2000)] + [1, 5242, 5243, 10**12 + 7]
    got = values(spark, [(n,) for n in sizes], "b long", sc.size_mb(F.col("b")))
    assert got == [round(n / (1024 * 1024), 2) for n in sizes]


def test_json_or_raw(spark):
    rows = [('{"a": 1}', True), ("{broken", True), ('{"a": 1}', False), (None, True)]
    column = sc.json_or_raw(F.col("t"), F.col("ok"))
    got = (
        spark.createDataFrame(rows, "t string, ok boolean")
        .select(column.alias("s"))
        .select(F.to_json("s.parsed"), "s.raw")
        .collect()
    )
    assert [tuple(r) for r in got] == [('{"a":1}', None), (None, "{broken"), (None, None), (None, None)]


def test_truthy_coalesce_returns_last_value_as_is(spark):
    rows = [("", "b", "c"), (None, "", ""), ("a", None, None), ("", None, None)]
    column = sc.truthy_coalesce(F.col("x"), F.col("y"), F.col("z"))
    python = [x or y or z for x, y, z in rows]
    assert values(spark, rows, "x string, y string, z string", column) == python


def test_glyph_and_version(spark):
    assert values(spark, [(True,), (False,), (None,)], "b boolean", sc.status_glyph(F.col("b"))) == [
        "✓",
        "✗",
        "✗",
    ]
    version = sc.clean_version(F.col("t"), F.col("ok"))
    rows = [("  v 1\n", True), ("v", False), (None, True)]
    assert values(spark, rows, "t string, ok boolean", version) == ["v 1", None, None]


def test_messages(spark):
    column = sc.result_message("installed", F.col("a"), F.col("b"))
    assert values(spark, [(2, 3)], "a int, b int", column) == ["Installed on 2/3 nodes"]
