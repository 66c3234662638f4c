"""Named views, raw queries and named questions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetskein.functions import times
from fleetskein.operators.filters import for_node, is_identifier
from fleetskein.operators.latest import latest_of_node
from fleetskein.operators.runs import latest_run_telemetry
from fleetskein.operators.status import offline_nodes
from fleetskein.session import written


def register_view(spark: SparkSession, name: str, select: str) -> DataFrame:
    """Create or replace a view over a query and return it."""
    if not is_identifier(name):
        raise ValueError(f"invalid SQL view identifier: {name}")
    spark.sql(select).createOrReplaceTempView(name)
    return spark.table(name)


def run_statement(spark: SparkSession, sql: str, args: dict[str, Any] | list[Any] | None = None) -> None:
    """Run a statement for its effect, such as view DDL."""
    spark.sql(sql, args=args)


def query_rows(spark: SparkSession, sql: str, args: dict[str, Any] | list[Any] | None = None) -> DataFrame:
    """Raw read query with named or positional parameters."""
    return spark.sql(sql, args=args)


def query_maps(spark: SparkSession, sql: str, args: dict[str, Any] | list[Any] | None = None) -> DataFrame:
    """The same rows as JSON objects, NULL members kept."""
    rows = query_rows(spark, sql, args)
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def _or_text(lines: DataFrame, fallback: str) -> DataFrame:
    """The lines, or the fallback text when there are none."""
    empty = lines.agg(F.count(F.lit(1))).scalar() == 0
    text = lines.sparkSession.range(1).filter(empty).select(F.lit(fallback).alias("line"))
    return lines.unionByName(text, allowMissingColumns=True)


def _required(args: dict[str, Any], name: str, error: str) -> str:
    value = args.get(name)
    if not isinstance(value, str):
        raise ValueError(error)
    return value


def node_telemetry(ledger: DataFrame, args: dict[str, Any], as_of: Column | None = None) -> DataFrame:
    """The five newest rows of a node; ``full_time`` prints date and time."""
    node = _required(args, "node_id", "Missing required argument 'node_id'")
    full = bool(args.get("full_time"))
    at = F.col("event_timestamp")
    line = times.reading_line(times.rfc3339(at) if full else times.clock(at), F.col("component"), F.col("metrics"))
    lines = latest_of_node(ledger, node).select("event_timestamp", "event_id", line.alias("line"))
    fallback = f"No {'' if full else 'recent '}telemetry found for {node}"
    return _or_text(lines, fallback).orderBy(F.desc("event_timestamp"), F.desc("event_id")).select("line")


def latest_benchmark(ledger: DataFrame, args: dict[str, Any], as_of: Column | None = None) -> DataFrame:
    """A header with the number of rows, then one line per row, ordered by time; never one text of unknown size."""
    node = _required(args, "node_id", "Missing node_id")
    # Written, so that the header does not join the runs a second time.
    rows = written(latest_run_telemetry(for_node(ledger, node)).select("event_timestamp", "event_id", "line"), "benchmark")
    found = rows.agg(F.count(F.lit(1)).alias("n"))
    header = found.select(
        F.lit(None).cast("timestamp_ntz").alias("at"),
        F.lit(None).cast("bigint").alias("event_id"),
        F.when(F.col("n") == 0, F.lit(f"No telemetry was recorded during the last benchmark run for {node}"))
        .otherwise(F.format_string("Found %d hardware telemetry events during the benchmark:", F.col("n")))
        .alias("line"),
    )
    lines = rows.select(F.col("event_timestamp").cast("timestamp_ntz").alias("at"), "event_id", "line")
    return header.unionByName(lines).orderBy(F.asc_nulls_first("at"), "event_id").select("line")


def silent_nodes(ledger: DataFrame, args: dict[str, Any], as_of: Column | None = None) -> DataFrame:
    rows = offline_nodes(ledger, float(args.get("seconds", 60)), as_of)
    line = F.concat(F.lit("⚠️ "), F.col("node_id"), F.lit(" (Last seen: "), F.col("elapsed"), F.lit(")"))
    return _or_text(rows.select(line.alias("line")), "All nodes are currently online and reporting.")


QUESTIONS: dict[str, Callable[..., DataFrame]] = {
    "get_node_telemetry": node_telemetry,
    "analyze_latest_benchmark": latest_benchmark,
    "check_offline_nodes": silent_nodes,
}


def ask(ledger: DataFrame, name: str, args: dict[str, Any] | None = None, as_of: Column | None = None) -> DataFrame:
    """Answer a named question with text lines."""
    if name not in QUESTIONS:
        raise ValueError(f"Unknown tool {name}")
    return QUESTIONS[name](ledger, args or {}, as_of)
