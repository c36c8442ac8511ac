"""Settings files: ``[section]`` heads, ``key = value`` lines, ``#`` comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.functions.scalars import strip


def _entries(text: Column) -> Column:
    """Array of (section, key, no, value), sorted; ``no`` is the order in the file.

    The text is cut before each section head, so every piece knows its section by itself.
    """

    blanks = F.lit(fv.WHITESPACE)

    def piece(text: Column) -> Column:
        lines = F.filter(
            F.transform(F.split(text, "\n"), strip),
            lambda line: (line != "") & ~line.startswith("#") & ~line.startswith("["),
        )
        section = F.regexp_extract(text, r"^\s*\[([^\]\n]*)\]", 1)
        return F.struct(section.alias("section"), lines.alias("lines"))

    def entry(section: Column, line: Column) -> Column:
        return F.struct(
            section.alias("section"),
            F.rtrim(F.substring_index(line, "=", 1), blanks).alias("key"),
            F.when(line.contains("="), F.ltrim(F.regexp_replace(line, "^[^=]*=", ""), blanks)).alias(
                "value"
            ),
        )

    pieces = F.transform(F.split(text, r"\n(?=[ \t]*\[)"), piece)
    entries = F.flatten(
        F.transform(
            pieces, lambda p: F.transform(p["lines"], lambda line: entry(p["section"], line))
        )
    )
    return F.sort_array(
        F.transform(
            entries,
            lambda e, i: F.struct(
                e["section"].alias("section"), e["key"].alias("key"), i.alias("no"), e["value"].alias("value")
            ),
        )
    )


def parse_settings(files: DataFrame, *keys: str, column: str = "text") -> DataFrame:
    """One row per (file, section, key); the last line of a key wins. ``keys`` identify a file.

    All lines of a key come from one row, so the last one is found in that row and nothing is
    shuffled.
    """
    listed = files.select(
        *keys, F.inline(F.array(F.struct(_entries(F.col(column)).alias("_entries"))))
    )
    with_next = F.zip_with(
        "_entries",
        F.slice("_entries", 2, F.size("_entries")),
        lambda e, after: F.struct(e.alias("entry"), after.alias("after")),
    )
    last = F.filter(
        with_next,
        lambda pair: ~(
            pair["entry"]["section"].eqNullSafe(pair["after"]["section"])
            & pair["entry"]["key"].eqNullSafe(pair["after"]["key"])
        ),
    )
    kept = F.transform(
        last,
        lambda pair: F.struct(*[pair["entry"][c].alias(c) for c in ("section", "key", "value")]),
    )
    return listed.filter(F.size("_entries") > 0).select(*keys, F.inline(kept))


def settings_of_files(files: DataFrame, *keys: str) -> DataFrame:
    """Settings of files given by ``file_name`` and ``text``, with the node the name stands for.

    ``node_id`` is 1 for ``primary.cnf`` and n + 1 for ``secondary{n}.cnf``.
    """
    number = F.regexp_extract("file_name", r"^secondary(\d+)\.cnf$", 1).try_cast("int")
    return parse_settings(files, *keys, "file_name").withColumn(
        "node_id", F.when(F.col("file_name") == "primary.cnf", 1).otherwise(number + 1)
    )


def settings_source(spark: SparkSession, path: str) -> DataFrame:
    """Settings of all files below ``path``, keyed by file name and node."""
    return settings_of_files(
        spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")
        )
    )
