"""Scalar functions: Column in, Column out, native expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv


def strip(text: Column) -> Column:
    """Text without white space at either end (all Unicode white space, not only blanks)."""
    return F.btrim(text, F.lit(fv.WHITESPACE))


def is_true(flag: Column) -> Column:
    """The flag with null read as false."""
    return F.coalesce(flag, F.lit(False))


def classify_output(text: Column, ok: Column, rules: Sequence[tuple]) -> Column:
    """Outcome of a command: the first rule whose words occur, else ``ok`` or ``failed``.

    A rule is (outcome, words, ignore_case, only_when_failed).
    """
    passed = is_true(ok)
    outcomes = []
    for outcome, words, ignore_case, only_when_failed in rules:
        found = [
            F.lower(text).contains(word.lower()) if ignore_case else text.contains(word)
            for word in words
        ]
        applies = is_true(reduce(or_, found))
        if only_when_failed:
            applies = applies & ~passed
        outcomes.append(F.when(applies, outcome))
    return F.coalesce(*outcomes, F.when(passed, "ok").otherwise("failed"))


def has_plugin(output: Column, plugin: str, ok: Column | None = None) -> Column:
    """Does the output mention the plugin, ignoring case; with ``ok`` the command must have passed."""
    seen = is_true(F.lower(output).contains(plugin.lower()))
    return seen if ok is None else seen & is_true(ok)


def kv_last_token(output: Column, key: str, default: str, ok: Column | None = None) -> Column:
    """Last token of the first line that holds ``key`` and at least two tokens."""

    def tokens(line: Column) -> Column:
        return F.split(strip(line), f"{fv.WHITESPACE_CLASS}+")

    lines = F.filter(
        F.split(output, "\n"),
        lambda line: F.lower(line).contains(key.lower()) & (F.size(tokens(line)) >= 2),
    )
    found = F.try_element_at(tokens(F.try_element_at(lines, F.lit(1))), F.lit(-1))
    if ok is not None:
        found = F.when(is_true(ok), found)
    return F.coalesce(found, F.lit(default))


def service_active(output: Column) -> Column:
    """Strict test: the output is exactly ``active``."""
    return is_true(strip(output) == "active")


def service_active_loose(output: Column, ok: Column) -> Column:
    """Loose test: the command passed and the output holds ``active`` (``inactive`` does too)."""
    return is_true(ok) & is_true(output.contains("active"))


def container_running(output: Column) -> Column:
    return is_true(strip(output) == "true")


def service_name(unit_listing: Column) -> Column:
    return F.when(is_true(unit_listing.contains("mysql.service")), "mysql").otherwise("mysqld")


def size_mb(size_bytes: Column) -> Column:
    """Mebibytes to two decimals; ties go to the even digit."""
    return F.bround(size_bytes / F.lit(1048576), 2)


def json_or_raw(text: Column, available: Column) -> Column:
    """Struct of ``parsed`` (VARIANT, null unless valid JSON) and ``raw`` (text that did not parse).

    Text with ``NaN`` or with a key given twice does not count as valid.
    """
    usable = F.when(is_true(available), text)
    parsed = F.try_parse_json(usable)
    return F.struct(parsed.alias("parsed"), F.when(parsed.isNull(), usable).alias("raw"))


def truthy_coalesce(*values: Column, empty: object = "") -> Column:
    """First value that is neither null nor ``empty``; the last value is the fallback as it is."""
    *tried, last = values
    return F.coalesce(*[F.nullif(v, F.lit(empty)) for v in tried], last)


def result_message(kind: str, *values: Column) -> Column:
    return F.format_string(fv.MESSAGES[kind], *values)


def status_glyph(flag: Column) -> Column:
    return F.when(is_true(flag), fv.GLYPH_YES).otherwise(fv.GLYPH_NO)


def clean_version(output: Column, ok: Column) -> Column:
    return F.when(is_true(ok), strip(output))
