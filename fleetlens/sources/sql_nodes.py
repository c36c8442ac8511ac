"""Run one SQL text on many nodes and union the answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def node_sql_source(
    nodes: DataFrame,
    sql: str,
    connect: Callable[[str, int], Any],
    fetch_rows: int = 1000,
    concurrency: int | None = None,
) -> DataFrame:
    """Answers as ``cluster_id, node_id, last, ok, row_no, answer, message``; ``answer`` is tab separated.

    Every node ends with one row with ``last`` set: whether its answer is complete (``ok``), how many
    rows it gave (``row_no``) and the message of a failure. Only that row tells, as a connection can be
    lost in the middle; ``complete_answers`` keeps the rows of nodes that came to their end.

    ``nodes`` holds ``cluster_id, node_id, host, port``. ``connect(host, port)`` runs in the tasks
    and returns a DB-API connection; it sets credentials and the statement timeout. A node that
    fails leaves the job running. Answers are fetched in
    pieces, so a task never holds a whole answer. ``concurrency`` is the number of nodes asked
    at a time.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node in batch.itertuples(index=False):
                yield from _answers(node, sql, connect, fetch_rows)

    wanted = nodes.select("cluster_id", "node_id", "host", "port")
    if concurrency:
        wanted = wanted.repartition(concurrency, "cluster_id", "node_id")
    return wanted.mapInPandas(
        ask,
        "cluster_id long, node_id int, last boolean, ok boolean, row_no long, answer string,"
        " message string",
    )


def complete_answers(answers: DataFrame) -> DataFrame:
    """The answer rows of all nodes whose answer is complete."""
    done = answers.filter("last AND ok").select("cluster_id", "node_id").distinct()
    return answers.filter("NOT last").join(done, ["cluster_id", "node_id"], "left_semi")


def _answers(node, sql, connect, fetch_rows) -> Iterator[pd.DataFrame]:
    row_no = 0
    try:
        connection = connect(node.host, int(node.port))
        try:
            cursor = connection.cursor()
            cursor.execute(sql)
            while rows := cursor.fetchmany(fetch_rows):
                numbers = range(row_no, row_no + len(rows))
                row_no += len(rows)
                texts = ["\t".join("NULL" if v is None else str(v) for v in row) for row in rows]
                yield _rows(node, False, True, numbers, texts, None)
        finally:
            connection.close()
        yield _rows(node, True, True, [row_no], [None], None)
    except Exception as problem:
        yield _rows(node, True, False, [row_no], [None], str(problem))


def _rows(node, last, ok, numbers, answers, message) -> pd.DataFrame:
    numbers = pd.array(list(numbers), dtype="Int64")
    return pd.DataFrame(
        {
            "cluster_id": node.cluster_id,
            "node_id": node.node_id,
            "last": last,
            "ok": ok,
            "row_no": numbers,
            "answer": pd.Series(answers, dtype="object"),
            "message": message,
        }
    )
