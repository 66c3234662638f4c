"""Build events as columns and encode them for the wire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetskein.functions import times, topics
from fleetskein.functions.values import non_empty

DEFAULT_PREFIX = "fleet/ctd"

_TEXT_MAP = "map<string,string>"


def new_event(
    rows: DataFrame,
    node_id: Column,
    component: Column,
    status: Column,
    at: Column,
    pillar: Column | None = None,
) -> DataFrame:
    """Add the envelope columns of a plain event; metrics and params start empty."""
    return rows.withColumns({
        "node_id": node_id,
        "pillar": F.lit("observer") if pillar is None else pillar,
        "component": component,
        "status": status,
        "event_timestamp": at,
        "metrics": F.create_map().cast("map<string,variant>"),
        "params": F.create_map().cast(_TEXT_MAP),
    })


def with_pillar(events: DataFrame, pillar: str) -> DataFrame:
    return events.withColumn("pillar", F.lit(pillar))


def add_metric(events: DataFrame, name: str, value: Column) -> DataFrame:
    """Set one metric, replacing an older value of that name."""
    one = F.create_map(F.lit(name), value.cast("variant"))
    rest = F.map_filter(F.coalesce("metrics", F.create_map().cast("map<string,variant>")), lambda k, _v: k != name)
    return events.withColumn("metrics", F.map_concat(rest, one))


def with_artifact(
    events: DataFrame,
    artifact_id: Column,
    kind: Column,
    node_id: Column | None = None,
    meta: Column | None = None,
    created_at: Column | None = None,
) -> DataFrame:
    """Attach an artifact; without a creation time it takes the event's."""
    created = F.col("event_timestamp") if created_at is None else F.coalesce(created_at, F.col("event_timestamp"))
    return events.withColumn("artifact", F.struct(
        artifact_id.alias("id"),
        kind.alias("kind"),
        (F.lit(None).cast("string") if node_id is None else node_id).alias("node_id"),
        (F.create_map().cast(_TEXT_MAP) if meta is None else meta).alias("meta"),
        created.alias("created_at"),
    ))


def with_trace(
    events: DataFrame,
    source_id: Column,
    verb: Column,
    target_id: Column,
    meta: Column | None = None,
    run_id: Column | None = None,
) -> DataFrame:
    """Attach an edge; it takes the event's node and time, and the event becomes a tracer event."""
    return events.withColumn("pillar", F.lit("tracer")).withColumn("trace", F.struct(
        source_id.alias("source_id"),
        verb.alias("verb"),
        target_id.alias("target_id"),
        F.col("node_id").alias("node_id"),
        (F.lit(None).cast("string") if run_id is None else run_id).alias("run_id"),
        (F.create_map().cast(_TEXT_MAP) if meta is None else meta).alias("meta"),
        F.col("event_timestamp").alias("timestamp"),
    ))


def update_status(events: DataFrame, status: Column, at: Column) -> DataFrame:
    return events.withColumns({"status": status, "event_timestamp": at})


def encode(events: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Add ``topic`` and ``payload``. Optional members that are empty are left out of the JSON.

    The five plain members are always written, an absent text as ``""``.
    """
    def plain(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")).alias(name)

    def optional(column: Column, name: str) -> Column:
        return F.when(column != "", column).alias(name)

    members: list[Column] = []
    have = set(events.columns)
    if "event_id" in have:
        members.append(optional(F.col("event_id").cast("string"), "event_id"))
    members += [plain(x) for x in ("node_id", "pillar", "component", "status")]
    members.append(times.rfc3339_micros(F.col("event_timestamp")).alias("event_timestamp"))
    members += [non_empty(F.col(x)).alias(x) for x in ("metrics", "params") if x in have]
    if "artifact" in have:
        a = F.col("artifact")
        members.append(F.when(a.isNotNull(), F.struct(
            F.coalesce(a["id"], F.lit("")).alias("id"),
            F.coalesce(a["kind"], F.lit("")).alias("kind"),
            optional(a["node_id"], "node_id"),
            non_empty(a["meta"]).alias("meta"),
            times.rfc3339_micros(a["created_at"]).alias("created_at"),
        )).alias("artifact"))
    if "trace" in have:
        t = F.col("trace")
        members.append(F.when(t.isNotNull(), F.struct(
            *[F.coalesce(t[x], F.lit("")).alias(x) for x in ("source_id", "verb", "target_id")],
            *[optional(t[x], x) for x in ("node_id", "run_id")],
            non_empty(t["meta"]).alias("meta"),
            times.rfc3339_micros(t["timestamp"]).alias("timestamp"),
        )).alias("trace"))
    topic = topics.event_topic(prefix, F.col("pillar"), F.col("node_id"), F.col("component"))
    return events.withColumns({"topic": topic, "payload": F.to_json(F.struct(*members))})
