"""Runs and their steps: success rollups, failed steps, time budgets, path candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens import fixed_values as fv
from fleetlens.functions.scalars import is_true
from fleetlens.functions.skew import join_per_group


def all_passed(counted: Column, success: Column, when_none: bool) -> Column:
    """Aggregate: every counted row passed; ``when_none`` answers for no counted row."""
    return F.coalesce(F.bool_and(F.when(counted, is_true(success))), F.lit(when_none))


def setup_rollup(
    steps: DataFrame,
    strict: bool = False,
    uncounted: Sequence[str] = tuple(fv.SETUP_UNCOUNTED_STEPS),
) -> DataFrame:
    """Success of each setup run; saving the document does not count unless ``strict``."""
    counted = F.lit(True) if strict else ~F.col("name").isin(*uncounted)
    return steps.groupBy("run_id").agg(
        all_passed(counted, F.col("success"), True).alias("success"),
        F.count(F.lit(1)).alias("step_count"),
        F.count_if(~is_true(F.col("success"))).alias("failed_steps"),
    )


def replication_rollup(
    steps: DataFrame,
    strict: bool = False,
    counted: Sequence[str] = tuple(fv.REPLICATION_COUNTED_STEPS),
) -> DataFrame:
    """Success of each replication run; steps of single secondaries count only if ``strict``."""
    decides = F.lit(True) if strict else F.col("name").isin(*counted)
    failed = ~is_true(F.col("success"))
    return steps.groupBy("run_id").agg(
        all_passed(decides, F.col("success"), True).alias("success"),
        F.count_if(failed).alias("failed_steps"),
        F.count_if(failed & ~F.col("name").isin(*counted)).alias("failed_secondary_steps"),
    )


def start_rollup(parts: DataFrame) -> DataFrame:
    """Success of each start run.

    ``parts`` holds ``run_id, part, success`` with part in primary, docker, remote (one row per
    machine), replication. A failed primary ends the run, so other parts are not reported.
    """
    success = F.col("success")
    totals = parts.groupBy("run_id").agg(
        all_passed(F.col("part") == "primary", success, False).alias("_primary"),
        all_passed(F.col("part") == "docker", success, True).alias("_docker"),
        all_passed(F.col("part") == "remote", success, True).alias("_remote"),
        F.count_if((F.col("part") == "remote") & ~is_true(success)).alias("_failed_remote"),
        F.bool_and(F.when(F.col("part") == "replication", is_true(success))).alias("_replication"),
    )
    primary = F.col("_primary")
    return totals.select(
        "run_id",
        (
            primary
            & F.col("_docker")
            & F.col("_remote")
            & F.coalesce("_replication", F.lit(True))
        ).alias("success"),
        primary.alias("primary_success"),
        F.when(primary, F.col("_docker")).alias("docker_success"),
        F.when(primary, F.col("_remote")).alias("remote_success"),
        F.when(primary, F.col("_failed_remote")).alias("failed_remote"),
        F.when(primary, F.col("_replication")).alias("replication_success"),
    )


def stop_rollup(parts: DataFrame, strict: bool = False) -> DataFrame:
    """Success of each stop run: the primary alone decides unless ``strict``."""
    counted = F.lit(True) if strict else F.col("part") == "primary"
    return parts.groupBy("run_id").agg(
        all_passed(counted, F.col("success"), True).alias("success"),
        F.count_if(~is_true(F.col("success"))).alias("failed_parts"),
    )


def install_summary(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Per cluster: did all installs pass, and on how many of all nodes.

    The node total is the primary plus all secondaries, counted even without a report. A node
    that reported nothing does not turn the flag false.
    """
    reported = results.select("cluster_id", "pos", F.col("success").alias("_ok")).withColumn(
        "_seen", F.lit(True)
    )
    totals = (
        nodes.select("cluster_id", "pos", "role")
        .join(reported, ["cluster_id", "pos"], "left")
        .groupBy("cluster_id")
        .agg(
            all_passed(is_true(F.col("_seen")), F.col("_ok"), True).alias("success"),
            F.count_if(is_true(F.col("_ok"))).alias("installed"),
            (F.count_if(F.col("role") == fv.ROLE_SECONDARY) + 1).alias("total"),
        )
    )
    return totals.withColumn(
        "summary", F.format_string(fv.MESSAGES["installed"], "installed", "total")
    )


def failed_steps(steps: DataFrame) -> DataFrame:
    """Failed steps with their report line; no flag counts as failed, no error text as unknown."""
    return steps.filter(~is_true(F.col("success"))).withColumn(
        "line",
        F.concat(F.col("name"), F.lit(": "), F.coalesce("error", F.lit(fv.MSG_UNKNOWN_ERROR))),
    )


def failed_parts(parts: DataFrame) -> DataFrame:
    """Failed parts of start runs as ``Primary: …``, ``Docker: …`` or ``Remote host: …``."""
    who = (
        F.when(F.col("part") == "primary", "Primary")
        .when(F.col("part") == "docker", "Docker")
        .when(F.col("part") == "remote", F.concat(F.lit("Remote "), F.col("host")))
    )
    failed = parts.filter(~is_true(F.col("success")) & who.isNotNull())
    return failed.withColumn("line", F.concat(who, F.lit(": "), F.col("message")))


def timeout_budget(
    steps: DataFrame, budgets: Mapping[str, int] | DataFrame = fv.COMMAND_BUDGETS
) -> DataFrame:
    """Step durations against the budget of their kind: within, timed_out, or no_budget.

    A mapping is looked up in each row. A table (``kind, budget_seconds``) is joined; no broadcast
    is forced, and the join is salted since a few kinds make up most steps.
    """
    if isinstance(budgets, DataFrame):
        known = join_per_group(steps, budgets, ["kind"], steps.columns, "left")
    else:
        table = F.create_map(*[F.lit(part) for item in budgets.items() for part in item])
        known = steps.withColumn("budget_seconds", F.try_element_at(table, F.col("kind")))
    spent = F.col("duration_seconds") > F.col("budget_seconds")
    return known.withColumn(
        "verdict",
        F.when(F.col("budget_seconds").isNull(), "no_budget")
        .when(spent, "timed_out")
        .otherwise("within"),
    )


def plugin_candidates(engine: str) -> list[tuple[str, str]]:
    """(directory, file name) pairs in search order, directories first."""
    return [
        (directory, template % engine)
        for directory in fv.PLUGIN_DIRECTORIES
        for template in fv.PLUGIN_FILE_TEMPLATES
    ]


def parent_prefix(path: Column) -> Column:
    """What stands before a name in the parent directory of ``path``: empty for a bare name."""
    bare = F.regexp_replace(path, "(?<=.)/+$", "")
    return F.when(bare == "/", "/").otherwise(F.regexp_extract(bare, "^(.*/)[^/]*$", 1))


def resolve_candidate(
    groups: DataFrame, existing: DataFrame, candidates: Sequence[tuple[str, str]]
) -> DataFrame:
    """First existing candidate of each group, in candidate order, as a full path.

    ``groups`` holds ``group_id, base_dir``; candidate directories that do not begin with a slash lie in
    the parent directory of ``base_dir``. ``existing`` holds ``group_id, path`` of a file listing. Its
    rows get the rank of their candidate, so the candidates are never multiplied with the groups.
    """
    ranks = F.create_map(
        *[
            F.lit(part)
            for rank, (directory, name) in enumerate(candidates)
            for part in (f"{directory}/{name}", rank)
        ]
    )
    inside = F.when(
        F.col("path").startswith(F.col("_prefix")),
        F.col("path").substr(F.length("_prefix") + 1, F.length("path")),
    )
    # A path below the prefix is a relative candidate, any other an absolute one.
    below = F.when(~inside.startswith("/"), F.try_element_at(ranks, inside))
    whole = F.when(F.col("path").startswith("/"), F.try_element_at(ranks, F.col("path")))
    prefixes = groups.select("group_id", parent_prefix(F.col("base_dir")).alias("_prefix"))
    found = (
        existing.join(prefixes, "group_id")
        .select("group_id", F.col("path").alias("_path"), F.least(below, whole).alias("_rank"))
        .filter(F.col("_rank").isNotNull())
        .groupBy("group_id")
        .agg(F.min_by("_path", "_rank").alias("path"), F.min("_rank").alias("candidate_rank"))
    )
    return (
        groups.select("group_id")
        .join(found, "group_id", "left")
        .withColumn("reason", F.when(F.col("path").isNull(), "no candidate exists"))
    )


def remote_host_outcome(attempts: DataFrame) -> DataFrame:
    """``attempts`` with the outcome of adding each remote host: ``success`` and ``message``.

    Columns used: host, reachable, running, and ``{step}_ok``, ``{step}_message`` for the steps start,
    configure and join. The first step that fails gives the message; a host that runs already needs
    no start. An unknown (null) state is a failure.
    """

    def failed(step: str) -> Column:
        return ~is_true(F.col(f"{step}_ok"))

    def told(kind: str, *columns: str) -> Column:
        values = [F.coalesce(F.col(c), F.lit("")) for c in columns]
        return F.format_string(fv.MESSAGES[kind], *values)

    stopped = (
        F.when(~is_true(F.col("reachable")), told("host_unreachable", "host"))
        .when(
            ~is_true(F.col("running")) & failed("start"),
            told("host_not_started", "host", "start_message"),
        )
        .when(failed("configure"), told("host_not_configured", "host", "configure_message"))
        .when(failed("join"), told("host_not_joined", "host", "join_message"))
    )
    return attempts.withColumn("message", stopped).withColumns(
        {
            "success": F.col("message").isNull(),
            "message": F.coalesce("message", told("host_added", "host")),
        }
    )
