"""Table schemas and column lists."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw transport rows.
MESSAGES = T.StructType([
    T.StructField("msg_id", T.LongType()),
    T.StructField("topic", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
])

CONTROL_MESSAGES = T.StructType([
    T.StructField("msg_id", T.LongType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
])

RAW_SENSOR = T.StructType([
    T.StructField("raw_id", T.LongType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("device", T.StringType()),
    T.StructField("captured_at", T.TimestampType()),
    T.StructField("raw", T.StringType()),
])

# Append-only ledger, partitioned by event_date. metrics and params are JSON text.
LEDGER = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("node_group", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("pillar", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("event_timestamp", T.TimestampType()),
    T.StructField("metrics", T.StringType()),
    T.StructField("params", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("event_date", T.DateType()),
])

# Artifact upserts in arrival order; `from_event` tells the two upsert rules apart.
ARTIFACT_LOG = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("from_event", T.BooleanType()),
    T.StructField("id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("ingested_at", T.TimestampType()),
])

# Lineage edges; meta is canonical JSON text (sorted keys) so that rows compare by value.
TRACES = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("verb", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("meta", T.StringType()),
    T.StructField("event_timestamp", T.TimestampType()),
])

EDGE_COLUMNS = TRACES.fieldNames()

# Fixed values of the event model.
PILLARS = ("observer", "runner", "tracer")
RUN_START = "runner-start"
RUN_END = "runner-end"
RUN_COMPONENT = "runner:benchmark"
LIVE_SESSION = "session-live"
