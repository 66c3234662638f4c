"""Artifacts: a log of upserts folded into one row per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetskein.functions.values import canonical_json


def direct_upserts(rows: DataFrame, received_at: Column | None = None) -> DataFrame:
    """Log rows for artifacts registered directly, not through an event.

    A missing creation time becomes the time of arrival.
    """
    now = F.col("ingested_at") if received_at is None else received_at
    return rows.withColumns({
        "from_event": F.lit(False),
        "node_id": F.nullif("node_id", F.lit("")),
        "created_at": F.coalesce("created_at", now),
        "ingested_at": now,
    })


def compact(log: DataFrame) -> DataFrame:
    """Current artifacts: ``id, kind, node_id, meta, created_at, updated_at``.

    In order of ``seq``: an event's upsert replaces ``kind`` and, if it names one,
    ``node_id``; a direct upsert leaves both. ``meta`` merges key by key, the later
    value winning. The creation time of the first row stays.

    The fold is written as aggregates, not as an ordered list per id, so a busy id
    is reduced in the map tasks. Metadata is reduced per (id, key) before the
    keys of an id come together.
    """
    from_event = F.col("from_event")
    seq = F.col("seq")
    event_seq = F.when(from_event, seq)
    event_node_seq = F.when(from_event & F.col("node_id").isNotNull(), seq)
    heads = log.groupBy("id").agg(
        F.coalesce(F.max_by("kind", event_seq), F.min_by("kind", seq)).alias("kind"),
        F.coalesce(F.max_by("node_id", event_node_seq), F.min_by("node_id", seq)).alias("node_id"),
        F.min_by("created_at", seq).alias("created_at"),
        F.max("ingested_at").alias("updated_at"),
    )
    meta = (
        log.select("id", "seq", F.explode("meta"))
        .groupBy("id", "key")
        .agg(F.max_by("value", "seq").alias("value"))
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta"))
    )
    return heads.join(meta, "id", "left").select(
        "id", "kind", "node_id", canonical_json(F.col("meta")).alias("meta"), "created_at", "updated_at"
    )


#: A mergeable row per artifact: what decides each field, with the place in the log that it comes from.
SNAPSHOT = (
    "id string, first_seq long, first_kind string, first_node string, created_at timestamp, event_seq long, event_kind string, "
    "node_seq long, event_node string, updated_at timestamp, meta map<string,struct<seq:long,value:string>>"
)


def snapshot(log: DataFrame) -> DataFrame:
    """A part of the log as mergeable rows, see ``merge`` and ``current``."""
    event = F.col("from_event")
    from_event = lambda value: F.when(event, value)
    node_seq = F.when(event & F.col("node_id").isNotNull(), F.col("seq"))
    at = log.select(
        "id", F.col("seq").alias("first_seq"), F.col("kind").alias("first_kind"), F.col("node_id").alias("first_node"),
        F.col("created_at").cast("timestamp").alias("created_at"), from_event(F.col("seq")).alias("event_seq"), from_event(F.col("kind")).alias("event_kind"),
        node_seq.alias("node_seq"), F.when(node_seq.isNotNull(), F.col("node_id")).alias("event_node"), F.col("ingested_at").cast("timestamp").alias("updated_at"),
        F.transform_values("meta", lambda k, v: F.struct(F.col("seq"), v.alias("value"))).alias("meta"),
    )
    return _folded(at)


def merge(*parts: DataFrame) -> DataFrame:
    """Snapshots of disjoint parts of a log, in any order, as the snapshot of all of them."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return _folded(every)


def _folded(rows: DataFrame) -> DataFrame:
    """One row per id: each field from where its ``seq`` decides. Rows of the log are snapshots of one entry."""
    heads = rows.groupBy("id").agg(
        F.min("first_seq").alias("first_seq"),
        *[F.min_by(c, "first_seq").alias(c) for c in ("first_kind", "first_node", "created_at")],
        F.max("event_seq").alias("event_seq"),
        F.max_by("event_kind", "event_seq").alias("event_kind"),
        F.max("node_seq").alias("node_seq"),
        F.max_by("event_node", "node_seq").alias("event_node"),
        F.max("updated_at").alias("updated_at"),
    )
    # Metadata is reduced per (id, key) before the keys of an id come together, so a busy id is reduced in the map tasks.
    entries = rows.select("id", F.explode("meta").alias("key", "entry")).select("id", "key", "entry.seq", "entry.value")
    newest = entries.groupBy("id", "key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))
    meta = newest.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("seq", "value").alias("entry")))).alias("meta"))
    return heads.join(meta, "id", "left")


def current(snapshots: DataFrame) -> DataFrame:
    """Current artifacts of a snapshot, as ``compact`` gives them for the whole log."""
    values = F.transform_values("meta", lambda k, e: e["value"])
    return snapshots.select(
        "id", F.coalesce(F.when(F.col("event_seq").isNotNull(), F.col("event_kind")), "first_kind").alias("kind"),
        F.coalesce("event_node", "first_node").alias("node_id"), canonical_json(values).alias("meta"), "created_at", "updated_at",
    )


def hydrate(artifacts: DataFrame, ids: DataFrame) -> DataFrame:
    """Artifacts of an id set; unknown ids are absent, a missing node is ``""``."""
    return artifacts.join(ids.select("id"), "id", "left_semi").select(
        "id", "kind", F.coalesce("node_id", F.lit("")).alias("node_id"), "meta", "created_at"
    )
