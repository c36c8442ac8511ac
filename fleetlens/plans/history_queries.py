"""Queries on transaction sets, hash trees and histories of status and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import hash_tree, history, transactions
from fleetlens.plans.registry import query
from fleetlens.plans.views import Fleet
from fleetlens.session import work_folder

# Islands of consecutive ids in plain SQL.
ISLANDS = """
    SELECT source, min(seq) AS low, max(seq) AS high
    FROM (SELECT source, seq, seq - row_number() OVER (PARTITION BY source ORDER BY seq) AS island
          FROM (SELECT DISTINCT source, seq FROM {name}) AS d) AS n
    GROUP BY source, island"""

# What a replica has applied: all lines but the returned ones.
APPLIED_IDS = "(SELECT l_linenumber AS source, l_orderkey AS seq FROM {lineitem} WHERE l_returnflag <> 'R')"


def _ids(f: Fleet, applied: bool = False) -> DataFrame:
    lines = f.lineitem.filter("l_returnflag <> 'R'") if applied else f.lineitem
    return lines.select(F.col("l_linenumber").alias("source"), F.col("l_orderkey").alias("seq"))


@query("rp2_transaction_set", ISLANDS.replace("{name}", "{v_replayed} AS r"))
def transaction_set(f: Fleet) -> DataFrame:
    return transactions.transaction_set(_ids(f))


@query(
    "rp2_transaction_gaps",
    f"""
    WITH i AS ({ISLANDS.replace("{name}", "{v_replayed} AS r")})
    SELECT source, high + 1 AS low, next_low - 1 AS high
    FROM (SELECT *, lead(low) OVER (PARTITION BY source ORDER BY low) AS next_low FROM i) AS n
    WHERE next_low IS NOT NULL""",
)
def gaps(f: Fleet) -> DataFrame:
    return transactions.gaps(transactions.transaction_set(_ids(f)))


@query(
    "rp2_missing_transactions",
    ISLANDS.replace(
        "{name}",
        f"""(SELECT l_linenumber AS source, l_orderkey AS seq FROM {{lineitem}} AS l
             EXCEPT SELECT source, seq FROM {APPLIED_IDS} AS a) AS r""",
    ),
)
def missing(f: Fleet) -> DataFrame:
    """Ids of the primary that a replica lacks."""
    every = transactions.transaction_set(_ids(f))
    return transactions.difference(every, transactions.transaction_set(_ids(f, applied=True)))


@query(
    "rp2_applied_transactions",
    f"""
    SELECT l_orderkey AS seq, l_linenumber AS source, l_quantity,
           (l_linenumber, l_orderkey) IN (SELECT (source, seq) FROM {APPLIED_IDS} AS a) AS applied
    FROM {{lineitem}} AS l""",
)
def applied(f: Fleet) -> DataFrame:
    """Each change with the answer whether the replica has it."""
    rows = f.lineitem.select(
        F.col("l_linenumber").alias("source"), F.col("l_orderkey").alias("seq"), "l_quantity"
    )
    return transactions.contains(rows, transactions.transaction_set(_ids(f, applied=True)))


STRETCHES = """
    SELECT node_id, event_type, ts AS valid_from,
           lead(ts) OVER (PARTITION BY node_id ORDER BY ts) AS valid_to
    FROM (SELECT node_id, ts, event_type,
                 lag(event_type) OVER (PARTITION BY node_id ORDER BY ts) AS before,
                 row_number() OVER (PARTITION BY node_id ORDER BY ts) AS n
          FROM (SELECT node_id, ts, event_type,
                       row_number() OVER (PARTITION BY node_id, ts ORDER BY seq DESC) AS newest
                FROM {v_probe} AS p) AS r WHERE newest = 1) AS c
    WHERE n = 1 OR before <> event_type"""


@query("wn4_status_history", STRETCHES)
def status_history(f: Fleet) -> DataFrame:
    return history.validity(f.v_probe, ["event_type"])


@query(
    "wn4_status_history_extended",
    STRETCHES,
)
def status_history_extended(f: Fleet) -> DataFrame:
    """The same history, built from the earlier two thirds of the time and extended by the rest."""
    first, last = f.events.agg(F.min("ts"), F.max("ts")).first()
    cut = first + (last - first) * 2 / 3
    old = history.validity(f.v_probe.filter(F.col("ts") < F.lit(cut)), ["event_type"])
    kept, new = history.extend_validity(old, f.v_probe.filter(F.col("ts") >= F.lit(cut)), ["event_type"])
    return kept.unionByName(new)


@query(
    "wn4_status_as_of",
    f"""
    WITH h AS ({STRETCHES})
    SELECT q.start_id, q.node_id, q.ts, h.event_type, h.valid_from
    FROM (SELECT start_id, node_id, ts - INTERVAL 1 HOUR AS ts FROM {{v_start}} AS s) AS q
    LEFT JOIN h ON h.node_id = q.node_id AND h.valid_from <= q.ts
                AND (h.valid_to IS NULL OR q.ts < h.valid_to)""",
)
def status_as_of(f: Fleet) -> DataFrame:
    """What each node was reported to be an hour before each of its starts."""
    asked = f.v_start.select("start_id", "node_id", (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("ts"))
    return history.as_of(asked, history.validity(f.v_probe, ["event_type"]), ["event_type"])


WINDOW_DAY = 86_400


@query(
    "ag7_availability_per_day",
    f"""
    WITH h AS ({STRETCHES}), ended AS (
        SELECT node_id, event_type IN ('signup', 'view') AS up, valid_from AS a,
               coalesce(valid_to, (SELECT max(ts) FROM {{v_probe}} AS p)) AS b FROM h
    ), days AS (
        SELECT *, unnest(range(CAST(date_trunc('day', a) AS TIMESTAMP), b, INTERVAL 1 DAY)) AS d
        FROM ended WHERE a < b
    )
    SELECT node_id, d AS window_start,
           CAST(sum(CASE WHEN up THEN epoch_us(least(b, d + INTERVAL 1 DAY)) - epoch_us(greatest(a, d))
                         ELSE 0 END) AS BIGINT) AS up_micros,
           CAST(sum(epoch_us(least(b, d + INTERVAL 1 DAY)) - epoch_us(greatest(a, d))) AS BIGINT)
             AS known_micros
    FROM days GROUP BY node_id, d""",
)
def availability_per_day(f: Fleet) -> DataFrame:
    spans = history.validity(f.v_probe, ["event_type"])
    # One value: the end of what was observed.
    end = F.lit(f.events.agg(F.max("ts")).first()[0])
    up = F.col("event_type").isin("signup", "view")
    found = history.availability_per_window(spans, up, WINDOW_DAY, end)
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# Expected values are set by sign-ups and purchases, observed ones by views and clicks; errors remove them.
DRIFT_SIDES = {
    "wanted": """SELECT user_id AS node, 'log_bin' AS key, ts, event_id AS seq,
                        CASE WHEN event_type = 'signup' THEN 'on'
                             WHEN value > 15 THEN NULL ELSE 'off' END AS value
                 FROM {events} AS e WHERE event_type IN ('signup', 'purchase')""",
    "found": """SELECT user_id AS node, 'log_bin' AS key, ts, event_id AS seq,
                       CASE WHEN event_type = 'error' THEN NULL
                            WHEN value < 8 THEN 'on' ELSE 'off' END AS value
                FROM {events} AS e WHERE event_type IN ('view', 'click', 'error')""",
}


@query(
    "jn4_drift_periods",
    f"""
    WITH wanted AS ({DRIFT_SIDES["wanted"]}), found AS ({DRIFT_SIDES["found"]}),
    newest AS (
        SELECT node, key, ts, side, value FROM (
            SELECT *, row_number() OVER (PARTITION BY node, key, ts, side ORDER BY seq DESC) AS n
            FROM (SELECT *, 'e' AS side FROM wanted UNION ALL SELECT *, 'o' AS side FROM found) AS u
        ) AS r WHERE n = 1
    ), times AS (SELECT DISTINCT node, key, ts FROM newest),
    told AS (
        SELECT t.node, t.key, t.ts, e.value AS expected, o.value AS observed
        FROM times AS t
        ASOF LEFT JOIN (SELECT * FROM newest WHERE side = 'e') AS e
            ON e.node = t.node AND e.key = t.key AND t.ts >= e.ts
        ASOF LEFT JOIN (SELECT * FROM newest WHERE side = 'o') AS o
            ON o.node = t.node AND o.key = t.key AND t.ts >= o.ts
    ), state AS (
        SELECT *, CASE WHEN expected IS NULL AND observed IS NULL THEN 'none'
                       WHEN observed IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra'
                       WHEN expected = observed THEN 'ok' ELSE 'changed' END AS state
        FROM told
    ), turns AS (
        SELECT *, lag(row(state, expected, observed)) OVER w AS before, row_number() OVER w AS n
        FROM state WINDOW w AS (PARTITION BY node, key ORDER BY ts)
    ), spans AS (
        SELECT *, lead(ts) OVER (PARTITION BY node, key ORDER BY ts) AS valid_to FROM turns
        WHERE n = 1 OR before IS DISTINCT FROM row(state, expected, observed)
    )
    SELECT node, key, state, expected, observed, ts AS valid_from, valid_to
    FROM spans WHERE state <> 'none'""",
)
def drift_periods(f: Fleet) -> DataFrame:
    sides = [f.spark.sql(DRIFT_SIDES[name], events=f.events) for name in ("wanted", "found")]
    return history.drift_periods(*sides)


# A copy of orders with lost and altered rows; the remainders only vary the content.
REPLICA = """
    SELECT o_orderkey, o_custkey,
           CASE WHEN o_custkey % 499 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
           o_totalprice, o_orderdate, o_orderpriority
    FROM {orders} AS o WHERE o_orderkey % 997 <> 5"""
ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} AS o"
# Each level costs a pass, so the tree is low and wide; its top may have several nodes.
RANGE, FANOUT, HEIGHT = 64, 256, 2


def _both_sides(f: Fleet) -> tuple[DataFrame, DataFrame]:
    return f.spark.sql(ORDERS, orders=f.orders), f.spark.sql(REPLICA, orders=f.orders)


@query(
    "rp1_differing_ranges",
    f"""
    WITH a AS ({ORDERS}), b AS ({REPLICA}),
    d AS ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)),
    n AS (SELECT DISTINCT CAST(floor(o_orderkey / {RANGE}) AS BIGINT) AS node FROM d)
    SELECT node * {RANGE} AS low, node * {RANGE} + {RANGE - 1} AS high,
           (SELECT count(*) FROM a WHERE o_orderkey BETWEEN node * {RANGE} AND node * {RANGE} + {RANGE - 1})
             AS source_rows,
           (SELECT count(*) FROM b WHERE o_orderkey BETWEEN node * {RANGE} AND node * {RANGE} + {RANGE - 1})
             AS copy_rows
    FROM n""",
)
def differing_ranges(f: Fleet) -> DataFrame:
    """Key ranges in which a copy differs from its source, found from the roots of two stored trees."""
    trees = [
        hash_tree.store_tree(
            hash_tree.grow(hash_tree.leaf_hashes(rows, "o_orderkey", RANGE), FANOUT, HEIGHT),
            work_folder(f.spark, "tree"),
        )
        for rows in _both_sides(f)
    ]
    return hash_tree.differing_ranges(*trees, FANOUT, HEIGHT).select(
        (F.col("node") * RANGE).alias("low"),
        (F.col("node") * RANGE + (RANGE - 1)).alias("high"),
        F.col("left_rows").alias("source_rows"),
        F.col("right_rows").alias("copy_rows"),
    )


# A folder per range, so the ranges of a copy are larger than the leaves that are only compared.
COPY_RANGES = 32


@query("rp1_repaired_copy", ORDERS)
def repaired_copy(f: Fleet) -> DataFrame:
    """A copy with lost and altered rows, after its differing ranges were copied anew."""
    source, replica = _both_sides(f)
    width = (f.orders.agg(F.max("o_orderkey")).first()[0] or 0) // COPY_RANGES + 1
    copy = hash_tree.RangedCopy(work_folder(f.spark, "ranged"), replica.schema, "o_orderkey", width)
    for rows in (replica, source):
        copy.update(rows, hash_tree.leaf_hashes(rows, "o_orderkey", width))
    return copy.read(f.spark)
