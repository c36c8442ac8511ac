"""Every registered query against its SQL on the given tables."""

import re

import pytest

import __spark_entry__ as entry
from fleetlens.plans.registry import QUERIES
from tests.compare import difference, duckdb_on

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return duckdb_on(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert difference(entry.queries()[name](spark, FOLDER), duck, entry.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


BATCH = sorted(n for n in QUERIES if not n.startswith("ss"))


@pytest.mark.parametrize("name", BATCH)
def test_plan_has_no_pairing_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    for bad in ("CartesianProduct", "NestedLoopJoin", "InPandas", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in plan


@pytest.mark.parametrize("name", BATCH)
def test_plan_never_gathers_all_rows_in_one_partition(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert "SinglePartition" not in plan and "TakeOrderedAndProject" not in plan


@pytest.mark.parametrize("name", ["wn4_latest_status", "rp2_dedup_changes", "rp3_apply_changes"])
def test_rank_filter_runs_before_the_shuffle(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert re.search(r"Exchange.*\n.*WindowGroupLimit.*Partial", plan)


@pytest.mark.parametrize("name", ["wn3_unhealthy_streaks", "jn3_readiness"])
def test_rows_of_a_node_are_spread_over_chunks(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    assert re.search(r"Exchange hashpartitioning\(node_id#\d+L, _chunk#\d+L", plan)


@pytest.mark.parametrize("name", ["wn3_unhealthy_streaks", "jn3_readiness"])
def test_rows_of_a_node_are_never_paired(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    joins = re.findall(r"Join \[.*?\], \[.*?\], (\w+)", plan)
    assert joins and set(joins) <= {"LeftAnti", "LeftSemi", "LeftOuter"}
    assert all("_chunk" in line for line in plan.split("\n") if "Join" in line and "LeftOuter" in line)


def test_scan_reads_only_needed_columns_and_pushes_filters(spark):
    plan = plan_of(entry.queries()["ag1_node_counts"](spark, FOLDER))
    assert "o_totalprice" not in plan and "o_orderdate" not in plan
    assert "PushedFilters: [IsNotNull(s_acctbal), GreaterThanOrEqual(s_acctbal,500.0)]" in plan
