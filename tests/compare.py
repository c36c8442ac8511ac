"""Compare registered queries with DuckDB on the given tables."""

from __future__ import annotations

import sys
import tempfile
import time
from collections import Counter

import duckdb

from fleetlens.plans.views import TABLES
from fleetlens.session import build_session


def duckdb_on(folder: str):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def difference(frame, connection, sql: str) -> str | None:
    """None if both give the same columns, types and rows, else what differs."""
    ours = frame.toArrow()
    theirs = connection.sql(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} != {sorted(theirs.column_names)}"
    names = sorted(ours.column_names)
    kinds = [
        f"{n}: {ours.schema.field(n).type} != {theirs.schema.field(n).type}"
        for n in names
        if str(ours.schema.field(n).type).replace("large_", "")
        != str(theirs.schema.field(n).type).replace("large_", "")
    ]
    left, right = (
        Counter(zip(*[t.column(n).to_pylist() for n in names], strict=True)) for t in (ours, theirs)
    )
    if left != right:
        return (
            f"{ours.num_rows} rows against {theirs.num_rows}; only ours "
            f"{list((left - right).items())[:3]}; only theirs {list((right - left).items())[:3]}"
        )
    return f"types {kinds}" if kinds else None


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="fleetlens-compare-"), "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    connection = duckdb_on(folder)
    sqls = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            if name not in sqls:
                result = None if run(spark, folder).count() else "no rows"
            else:
                result = difference(run(spark, folder), connection, sqls[name])
        except Exception as problem:
            result = f"{type(problem).__name__}: {str(problem)[:1500]}"
        bad += result is not None
        print(f"{'ok ' if result is None else 'BAD'} {name} {time.time() - began:.1f}s {result or ''}", flush=True)
    print("bad:", bad)
