"""Tool logs in two line formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: ``asctime - logger - level - message`` and ``[YYYY-MM-DD HH:MM:SS] [ERROR:] message``.
TOOL_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - (.*?) - ([A-Z]+) - (.*)$"
SHELL_LINE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] (ERROR: )?(.*)$"


def parse_tool_logs(lines: DataFrame, column: str = "line") -> DataFrame:
    """Timestamp, logger, level and message of each line; other lines stay, with ``parsed`` false.

    Works on batch and streaming input.
    """
    line = F.col(column)
    stamp = F.when(
        line.rlike(TOOL_LINE),
        F.concat_ws(".", F.regexp_extract(line, TOOL_LINE, 1), F.regexp_extract(line, TOOL_LINE, 2)),
    ).when(line.rlike(SHELL_LINE), F.regexp_extract(line, SHELL_LINE, 1))
    ts = F.try_to_timestamp(stamp)
    tool = ts.isNotNull() & line.rlike(TOOL_LINE)
    shell = ts.isNotNull() & ~line.rlike(TOOL_LINE) & line.rlike(SHELL_LINE)
    return lines.withColumns(
        {
            "ts": ts,
            "logger": F.when(tool, F.regexp_extract(line, TOOL_LINE, 3)),
            "level": F.when(tool, F.regexp_extract(line, TOOL_LINE, 4)).when(
                shell,
                F.when(F.regexp_extract(line, SHELL_LINE, 2) != "", "ERROR").otherwise("INFO"),
            ),
            "message": F.when(tool, F.regexp_extract(line, TOOL_LINE, 5))
            .when(shell, F.regexp_extract(line, SHELL_LINE, 3))
            .otherwise(line),
            "parsed": ts.isNotNull(),
        }
    )


def read_tool_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_tool_logs(spark.read.text(path).withColumnRenamed("value", "line"))
