"""State of the fleet: who reports, who is silent, who is degraded.

``as_of`` stands for "now": any timestamp column, ``current_timestamp()`` when left out.
All thresholds are in seconds and strict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetskein.functions import times
from fleetskein.operators.filters import is_blocking, is_degraded
from fleetskein.operators.latest import last_seen, latest_row

REPORT_HEADER = "The following nodes are currently degraded or unreachable:"


def _now(as_of: Column | None) -> Column:
    return F.current_timestamp() if as_of is None else as_of


def newest_time(ledger: DataFrame) -> Column:
    """The ledger's last event time as a scalar subquery, to use as ``as_of``."""
    return ledger.agg(F.max("event_timestamp")).scalar()


def cluster_status(ledger: DataFrame, stale_seconds: float, as_of: Column | None = None) -> DataFrame:
    """Latest state per node and whether it is healthy."""
    rows = latest_row(ledger, "status", "metrics")
    fresh = F.col("last_seen") > _now(as_of) - times.seconds(stale_seconds)
    return rows.withColumn("is_healthy", fresh & ~is_blocking(F.col("status")))


def node_list(ledger: DataFrame, offline_seconds: float = 300, as_of: Column | None = None) -> DataFrame:
    """Every node with its last activity as text, ``active`` or ``offline``."""
    seen = F.col("last_seen")
    late = seen < _now(as_of) - times.seconds(offline_seconds)
    return last_seen(ledger).select(
        "node_id",
        times.rfc3339(seen).alias("last_seen"),
        F.when(late, "offline").otherwise("active").alias("status"),
    )


def node_states(ledger: DataFrame, unreachable_seconds: float = 180, as_of: Column | None = None) -> DataFrame:
    """``running``, ``degraded`` or ``oof!!!`` per node; silence outranks a bad status."""
    now = _now(as_of)
    seen, status = F.col("last_seen"), F.col("status")
    silent = seen < now - times.seconds(unreachable_seconds)
    bad = is_degraded(status)
    silent_text = F.concat(F.lit("unreachable ("), times.minutes_ago(seen, now), F.lit("m ago)"))
    return latest_row(ledger, "component", "status").select(
        "node_id",
        "component",
        F.when(silent, "oof!!!").when(bad, "degraded").otherwise("running").alias("state"),
        F.when(silent, silent_text).when(bad, status).otherwise("clean").alias("detail"),
    )


def degraded_report(states: DataFrame) -> DataFrame:
    """One text over the result of :func:`node_states`; no row when every node runs.

    The input is one row per node, and only abnormal nodes take part.
    """
    line = F.concat(F.lit("- "), F.col("node_id"), F.lit(" ("), F.col("detail"), F.lit(")"))
    bad = states.filter(F.col("state") != "running").select("node_id", line.alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("node_id", "line")))
    return (
        bad.agg(lines.alias("lines"))
        .filter(F.size("lines") > 0)
        .select(
            F.concat(
                F.lit(REPORT_HEADER + "\n"),
                F.concat_ws("\n", F.transform("lines", lambda x: x["line"])),
                F.lit("\n"),
            ).alias("report")
        )
    )


def offline_nodes(ledger: DataFrame, silent_seconds: float = 60, as_of: Column | None = None) -> DataFrame:
    """Nodes silent for longer than the limit, with the elapsed time as text."""
    now = _now(as_of)
    silent = last_seen(ledger).filter(F.col("last_seen") < now - times.seconds(silent_seconds))
    return silent.withColumn("elapsed", times.elapsed(F.col("last_seen"), now))
