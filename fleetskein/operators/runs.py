"""Benchmark runs and the telemetry recorded inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetskein.functions import times
from fleetskein.functions.times import slot_of
from fleetskein.functions.values import json_bigint, json_text, number_or_null
from fleetskein.operators.filters import not_run_markers, with_status
from fleetskein.schemas import RUN_END, RUN_START
from fleetskein.session import written


def runs(ledger: DataFrame) -> DataFrame:
    """Every run start: ``node_id, run_id, start_time, end_time``.

    A start whose run id or duration is no number opens no interval (NULL end). Durations are held
    within ``times.LONGEST``.
    """
    metrics = F.col("metrics")
    duration = times.bounded_seconds(number_or_null(F.btrim(json_text(metrics, "duration_sec"))))
    return with_status(ledger, RUN_START).select(
        "node_id",
        "event_id",
        json_bigint(metrics, "run_id").alias("run_id"),
        F.col("event_timestamp").alias("start_time"),
        (F.col("event_timestamp") + times.seconds(duration)).alias("end_time"),
    )


def run_events(ledger: DataFrame) -> DataFrame:
    """Start and end events of runs as data."""
    marked = ledger.filter(F.col("status").isin(RUN_START, RUN_END))
    metrics = F.col("metrics")
    return marked.select(
        "node_id",
        "event_id",
        "status",
        json_bigint(metrics, "run_id").alias("run_id"),
        json_text(metrics, "duration_sec").try_cast("decimal(18,6)").alias("duration_sec"),
        *[
            (json_text(metrics, key) == "true").alias(key)
            for key in ("target_system", "target_npu", "target_gpu")
        ],
        "event_timestamp",
    )


def latest_runs(ledger: DataFrame) -> DataFrame:
    """The newest run start of every node."""
    newest = runs(ledger).groupBy("node_id").agg(
        F.max_by(F.struct("run_id", "start_time", "end_time"), F.struct("start_time", "event_id")).alias("run")
    )
    return newest.select("node_id", "run.*")


def telemetry_in_runs(ledger: DataFrame, run_rows: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """Ledger rows inside each run, both ends included; overlapping runs each get the row.

    Runs are laid out over time slots and joined on (node, slot), the exact
    interval being checked on the matches. A node with much of the ledger or with
    many runs is so spread over its slots. The runs are written first: their real
    size decides whether they are broadcast or the join is shuffled. No slot after
    the ledger's last row is laid out, however long a run claims to be.
    """
    newest = ledger.agg(F.max("event_timestamp")).scalar()
    spans = written(_slotted(run_rows, newest, slot_seconds), "run-slots")
    rows = not_run_markers(ledger).withColumn("slot", slot_of(F.col("event_timestamp"), slot_seconds))
    inside = F.col("event_timestamp").between(F.col("start_time"), F.col("end_time"))
    return rows.join(spans, ["node_id", "slot"]).filter(inside).drop("slot")


def _slotted(run_rows: DataFrame, newest: Column, slot_seconds: int) -> DataFrame:
    """Runs that the ledger can reach, a row for each of their slots up to ``newest``.

    The generator keeps Catalyst from copying the parser of the runs' metrics into all that is asked of the end time.
    """
    run = F.struct("node_id", "run_id", "start_time", "end_time")
    read = run_rows.select(F.explode(F.array(run)).alias("run")).select("run.*")
    start, end = F.col("start_time"), F.col("end_time")
    open_runs = read.filter((end >= start) & (start <= newest))
    slots = F.sequence(
        slot_of(start, slot_seconds), slot_of(F.least(end, newest), slot_seconds), F.lit(slot_seconds * 1_000_000)
    )
    return open_runs.select("node_id", "run_id", "start_time", "end_time", F.explode(slots).alias("slot"))


def run_spans(ledger: DataFrame) -> DataFrame:
    """Every run start with its end: ``node_id, event_id, run_id, start_time, planned_end, end_time, lasted_sec, state``.

    The end is the first ``runner-end`` of the same node and run id at or after the start. ``state`` is ``ended``, or
    ``open`` where there is none; ``lasted_sec`` is null then. Starts and ends without a run id stay apart.
    """
    starts = runs(ledger).withColumnRenamed("end_time", "planned_end")
    later = starts.join(run_ends(ledger), ["node_id", "run_id"]).filter(F.col("end_time") >= F.col("start_time"))
    first = later.groupBy("node_id", "event_id").agg(F.min("end_time").alias("end_time"))
    return with_state(starts.join(first, ["node_id", "event_id"], "left"))


def run_ends(ledger: DataFrame) -> DataFrame:
    return with_status(ledger, RUN_END).select(
        "node_id", json_bigint(F.col("metrics"), "run_id").alias("run_id"), F.col("event_timestamp").alias("end_time")
    )


def with_state(spans: DataFrame) -> DataFrame:
    lasted = times.micros_between(F.col("start_time"), F.col("end_time")) / F.lit(1_000_000.0)
    return spans.select(
        "node_id", "event_id", "run_id", "start_time", "planned_end", "end_time", lasted.alias("lasted_sec"),
        F.when(F.col("end_time").isNull(), "open").otherwise("ended").alias("state"),
    )


def telemetry_of_current_run(ledger: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """Ledger rows with the run they fall in, each at most once: the last start at or before the row, if it is still on.

    Unlike ``telemetry_in_runs``, where every overlapping run gets the row, a new run takes over from the one
    before. The last start is carried forward in two steps: within (node, slot), and from slot to slot, where a
    node has one row per slot; so a node with much of the ledger spreads over its slots, and a run that claims
    years costs no more than another. Starts at one time: the larger ``event_id``. Starts without an interval don't count.
    """
    rows = not_run_markers(ledger).select("node_id", "event_id", "component", "event_timestamp")
    starts = runs(ledger).filter(F.col("end_time").isNotNull())
    start = F.struct("start_time", F.col("event_id").alias("start_id"), "run_id", "end_time")
    at_start = starts.select("node_id", F.col("start_time").alias("event_timestamp"), F.col("event_id").alias("start_order"), start.alias("start"))
    both = rows.unionByName(at_start, allowMissingColumns=True).withColumn("slot", slot_of(F.col("event_timestamp"), slot_seconds))
    here = ["node_id", "slot"]
    # Starts come before rows of the same time, in the order of their ids.
    upto = Window.partitionBy(*here).orderBy("event_timestamp", F.col("start_order").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    in_slot = both.withColumn("inner", F.last("start", ignorenulls=True).over(upto)).filter(F.col("start").isNull())
    slots = both.groupBy(*here).agg(F.max("start").alias("newest"))
    earlier = Window.partitionBy("node_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("outer", F.last("newest", ignorenulls=True).over(earlier)).select(*here, "outer")
    run = F.coalesce(F.col("inner"), F.col("outer"))
    found = in_slot.join(carried, here).withColumn("run", run).filter(F.col("event_timestamp") <= F.col("run.end_time"))
    return found.select("node_id", "run.run_id", "event_id", "component", "event_timestamp")


def latest_run_telemetry(ledger: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """Telemetry of the newest run of every node, each row with its printed line."""
    rows = telemetry_in_runs(ledger, latest_runs(ledger), slot_seconds)
    line = times.reading_line(times.clock_millis(F.col("event_timestamp")), F.col("component"), F.col("metrics"))
    return rows.select("node_id", "run_id", "event_id", "component", "metrics", "event_timestamp", line.alias("line"))


def latest_run_counts(ledger: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """Number of telemetry rows per newest run; 0 for a run without any."""
    newest = written(latest_runs(ledger), "latest-runs")
    found = (
        telemetry_in_runs(ledger, newest, slot_seconds)
        .groupBy("node_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return newest.join(found, "node_id", "left").select("node_id", "run_id", F.coalesce("n", F.lit(0)).alias("n"))


def all_run_telemetry(ledger: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """Telemetry of every run."""
    rows = telemetry_in_runs(ledger, runs(ledger), slot_seconds)
    return rows.select("node_id", "run_id", "event_id", "component", "event_timestamp")
