"""The public questions, each wired to the derived input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetskein.functions import topics, values
from fleetskein.operators import (
    alerts, artifacts, control, events, filters, latest, lineage, redelivery, runs, sensors, silence, status, unload, views,
)
from fleetskein.sources import decode, messages
from fleetskein.sources.fixtures import Fixtures

HOUR = 3600
ROOT = "order:5"
NODE = "node-7"
SINCE = "2024-01-10 00:00:00"
PREFIX = "fleet/ctd"


def _plain_times(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock times, the form the check reads."""
    zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


def _as_of(fx: Fixtures):
    return status.newest_time(fx.ledger())


# Status

def cluster_status(fx: Fixtures) -> DataFrame:
    return status.cluster_status(fx.ledger(), HOUR, _as_of(fx))


def node_list(fx: Fixtures) -> DataFrame:
    return status.node_list(fx.ledger(), HOUR, _as_of(fx))


def node_states(fx: Fixtures) -> DataFrame:
    return status.node_states(fx.ledger(), HOUR, _as_of(fx))


def degraded_report(fx: Fixtures) -> DataFrame:
    return status.degraded_report(node_states(fx))


def offline_nodes(fx: Fixtures) -> DataFrame:
    return status.offline_nodes(fx.ledger(), 60, _as_of(fx))


def last_seen(fx: Fixtures) -> DataFrame:
    return latest.last_seen(fx.ledger())


def silent_gaps(fx: Fixtures) -> DataFrame:
    return silence.silent_gaps(fx.ledger(), 3 * HOUR)


def activity_sessions(fx: Fixtures) -> DataFrame:
    return silence.activity_sessions(fx.ledger(), 3 * HOUR)


# Latest rows, filters, export

def latest_n(fx: Fixtures) -> DataFrame:
    return latest.latest_n(fx.ledger(), 5).withColumn("rank", F.col("rank").cast("bigint"))


def latest_of_node(fx: Fixtures) -> DataFrame:
    return latest.latest_of_node(fx.ledger(), NODE, 5)


def hot_metrics_text(fx: Fixtures) -> DataFrame:
    rows = filters.metric_above_text(fx.ledger(), "temperature_c", "45")
    return rows.select("event_id", "node_id", "component", "value")


def hot_metrics_number(fx: Fixtures) -> DataFrame:
    rows = filters.metric_above_number(fx.ledger(), "temperature_c", 45)
    return rows.select("event_id", "node_id", "component", "value")


def degraded_rows(fx: Fixtures) -> DataFrame:
    rows = filters.not_run_markers(fx.ledger()).filter(filters.is_degraded(F.col("status")))
    return rows.select("event_id", "node_id", "status", filters.is_blocking(F.col("status")).alias("blocking"))


def unload_filtered(fx: Fixtures) -> DataFrame:
    return unload.unload(fx.ledger(), "node-1%", "observer", SINCE, 1000)


def unload_default(fx: Fixtures) -> DataFrame:
    return unload.unload(fx.ledger(), limit=unload.USUAL_LIMIT)


def unload_matching(fx: Fixtures) -> DataFrame:
    rows = unload.matching(fx.ledger(), "node-_", "runner", SINCE)
    return rows.select("event_id", "node_id", "pillar", "event_timestamp")


# Runs and control

def run_starts(fx: Fixtures) -> DataFrame:
    return runs.runs(fx.ledger())


def run_events(fx: Fixtures) -> DataFrame:
    rows = runs.run_events(fx.ledger()).withColumn("duration_sec", F.col("duration_sec").cast("double"))
    return rows.select("node_id", "event_id", "status", "run_id", "duration_sec", "event_timestamp")


def latest_runs(fx: Fixtures) -> DataFrame:
    return runs.latest_runs(fx.ledger())


def latest_run_telemetry(fx: Fixtures) -> DataFrame:
    return runs.latest_run_telemetry(fx.ledger())


def latest_run_counts(fx: Fixtures) -> DataFrame:
    return runs.latest_run_counts(fx.ledger())


def all_run_telemetry(fx: Fixtures) -> DataFrame:
    return runs.all_run_telemetry(fx.ledger())


def current_run_telemetry(fx: Fixtures) -> DataFrame:
    return runs.telemetry_of_current_run(fx.ledger())


def run_spans(fx: Fixtures) -> DataFrame:
    return runs.run_spans(fx.run_marks())


def run_marks(fx: Fixtures) -> DataFrame:
    """Start and end events with their target flags."""
    return runs.run_events(fx.run_marks()).withColumn("duration_sec", F.col("duration_sec").cast("double"))


def control_log(fx: Fixtures) -> DataFrame:
    return control.replay(fx.control_messages(), ["benchmark"])


def control_validated(fx: Fixtures) -> DataFrame:
    return control.parse(fx.control_messages())


# Lineage and artifacts

def lineage_edges(fx: Fixtures) -> DataFrame:
    return lineage.lineage_edges(fx.traces(), ROOT, 3)


def lineage_default_depth(fx: Fixtures) -> DataFrame:
    return lineage.lineage_edges(fx.traces(), ROOT, lineage.USUAL_DEPTH)


def lineage_artifacts(fx: Fixtures) -> DataFrame:
    return lineage.lineage_artifacts(lineage_edges(fx), fx.order_artifacts(), ROOT)


def lineage_of_suppliers(fx: Fixtures) -> DataFrame:
    """What every supplier's parts went into: the edges of all roots, summed up per root and verb."""
    edges = lineage.lineage_edges_of_many(fx.traces(), fx.suppliers(), 2)
    return edges.groupBy("root_id", "verb").agg(
        F.count(F.lit(1)).alias("edges"),
        F.countDistinct("source_id").alias("sources"),
        F.max("event_timestamp").alias("newest"),
    )


def compacted_artifacts(fx: Fixtures) -> DataFrame:
    return artifacts.compact(fx.artifact_log())


def merged_artifacts(fx: Fixtures) -> DataFrame:
    """The log in three parts, folded apart and merged in another order than they were written in."""
    log = fx.artifact_log()
    parts = [artifacts.snapshot(log.filter(F.col("seq") % 3 == k)) for k in (2, 0, 1)]
    merged = artifacts.merge(artifacts.merge(*parts[:2]), parts[2])
    return _plain_times(artifacts.current(merged))


# Messages

def _decoded(fx: Fixtures) -> DataFrame:
    return decode.decode(messages.telemetry_route(fx.messages()))


def topic_routes(fx: Fixtures) -> DataFrame:
    topic = F.col("topic")
    return fx.messages().select(
        "msg_id",
        topics.matches(topic, messages.FIREHOSE_FILTER).alias("firehose"),
        topics.matches(topic, messages.REGISTRY_FILTER).alias("registry"),
        topics.level_count(topic).cast("bigint").alias("levels"),
        topics.level(topic, 4).alias("fifth"),
    )


def ingest_ledger(fx: Fixtures) -> DataFrame:
    rows = decode.ledger_rows(_decoded(fx))
    metric = lambda key: values.json_text(F.col("metrics"), key)
    return _plain_times(rows.select(
        "event_id", "node_id", "node_group", "session_id", "pillar", "component", "status", "event_timestamp", "params",
        "ingested_at", "event_date",
        metric("temperature_c").try_cast("double").alias("temperature_c"),
        values.json_bigint(F.col("metrics"), "run_id").alias("run_id"),
    ))


def first_deliveries(fx: Fixtures) -> DataFrame:
    return redelivery.first_deliveries(fx.redelivered())


def ingest_quarantine(fx: Fixtures) -> DataFrame:
    return _plain_times(decode.quarantine(_decoded(fx)))


def ingest_artifacts(fx: Fixtures) -> DataFrame:
    return _plain_times(artifacts.compact(decode.artifact_rows(_decoded(fx))))


def ingest_traces(fx: Fixtures) -> DataFrame:
    return _plain_times(decode.trace_rows(_decoded(fx)))


def registry_alerts(fx: Fixtures) -> DataFrame:
    return alerts.registry_alerts(fx.registry_messages())


def built_events(fx: Fixtures) -> DataFrame:
    """Plain events built from the ledger and encoded for the wire."""
    rows = fx.ledger()
    made = events.new_event(
        rows.select("event_id", "node_id", "component", "status", "event_timestamp"),
        F.col("node_id"), F.col("component"), F.col("status"), F.col("event_timestamp"),
    )
    made = events.add_metric(made, "seq", F.col("event_id"))
    return events.encode(made.drop("event_id"), PREFIX).select("topic", "payload")


def built_traces(fx: Fixtures) -> DataFrame:
    """Tracer events with an edge and an artifact, encoded for the wire."""
    rows = fx.ledger().select("node_id", "component", "status", "event_timestamp", "event_id")
    made = events.new_event(
        rows, F.col("node_id"), F.col("component"), F.col("status"), F.col("event_timestamp")
    )
    made = events.with_artifact(made, F.concat(F.lit("run:"), F.col("event_id").cast("string")), F.lit("process"))
    made = events.with_trace(
        made, F.concat(F.lit("node:"), "node_id"), F.lit("ran"), F.col("artifact.id"),
        F.create_map(F.lit("from"), F.col("component")),
    )
    return events.encode(made, PREFIX).select("event_id", "topic", "payload")


# Views

def view_query(fx: Fixtures) -> DataFrame:
    fx.ledger().createOrReplaceTempView("skein_ledger")
    views.register_view(fx.spark, "skein_errors", "SELECT * FROM skein_ledger WHERE status = 'error'")
    return views.query_rows(
        fx.spark,
        "SELECT node_id, component, count(*) AS n FROM skein_errors WHERE node_id LIKE :p GROUP BY node_id, component",
        {"p": "node-1%"},
    )


def view_maps(fx: Fixtures) -> DataFrame:
    fx.ledger().createOrReplaceTempView("skein_ledger")
    return views.query_maps(fx.spark, "SELECT node_id, pillar, count(*) AS n FROM skein_ledger GROUP BY node_id, pillar")


def ask_telemetry(fx: Fixtures) -> DataFrame:
    return views.ask(fx.ledger(), "get_node_telemetry", {"node_id": NODE})


def ask_benchmark(fx: Fixtures) -> DataFrame:
    return views.ask(fx.ledger(), "analyze_latest_benchmark", {"node_id": NODE})


def ask_offline(fx: Fixtures) -> DataFrame:
    return views.ask(fx.ledger(), "check_offline_nodes", {}, _as_of(fx))


# Sensors

_SENSOR_INPUTS = {"hailo": ("hailo_scan", "hailo_temp", "hailo_power"), "unix_host": ("loadavg", "meminfo")}


def _sensor(name: str) -> Callable[[Fixtures], DataFrame]:
    def question(fx: Fixtures) -> DataFrame:
        raw = fx.raw_sensor(*_SENSOR_INPUTS.get(name, (name,)))
        return sensors.as_metrics(sensors.PARSERS[name](raw))

    return question


def sensor_all(fx: Fixtures) -> DataFrame:
    return sensors.as_metrics(sensors.normalise(fx.raw_sensor()))


def sensor_ledger(fx: Fixtures) -> DataFrame:
    """Ledger form of all readings, reduced to what does not depend on number formatting."""
    rows = sensors.as_ledger(sensors.normalise(fx.raw_sensor()))
    return rows.select(
        "node_id", "component", "status", "session_id", "pillar", "event_timestamp",
        values.json_text(F.col("metrics"), "device_id").alias("device_id"),
        (F.col("metrics") == "{}").alias("no_metrics"),
    )


QUESTIONS: dict[str, Callable[[Fixtures], DataFrame]] = {
    f.__name__: f
    for f in (
        cluster_status, node_list, node_states, degraded_report, offline_nodes, last_seen, silent_gaps,
        activity_sessions, latest_n, latest_of_node, hot_metrics_text, hot_metrics_number, degraded_rows,
        unload_filtered, unload_default, unload_matching, run_starts, run_events, latest_runs,
        latest_run_telemetry, latest_run_counts, all_run_telemetry, current_run_telemetry, run_spans, run_marks, control_log, control_validated,
        lineage_edges, lineage_default_depth, lineage_artifacts, lineage_of_suppliers, compacted_artifacts, merged_artifacts, first_deliveries,
        topic_routes, ingest_ledger, ingest_quarantine, ingest_artifacts, ingest_traces, registry_alerts,
        built_events, built_traces, view_query, view_maps, ask_telemetry, ask_benchmark, ask_offline,
    )
}
QUESTIONS |= {f"sensor_{name}": _sensor(name) for name in sensors.PARSERS}
QUESTIONS |= {"sensor_all": sensor_all, "sensor_ledger": sensor_ledger}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUESTIONS[name](Fixtures(spark, folder))
