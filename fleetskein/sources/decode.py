"""Decode JSON payloads into events, strictly.

Spark's JSON reader is forgiving: it turns numbers into strings and takes dates
for timestamps. The scalar members are therefore read as variants and their JSON
type is looked at before they are taken. Keys match in any case, the last of
several counts. An object *inside* a metric value that repeats a key counts as
malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetskein.functions.values import canonical_json, exact_names, is_json_value, with_document

_ARTIFACT = "id variant, kind variant, node_id variant, meta map<string,variant>, created_at variant"
_TRACE = (
    "source_id variant, verb variant, target_id variant, node_id variant, run_id variant, "
    "meta map<string,variant>, timestamp variant"
)
_ENVELOPE = (
    "event_id variant, node_id variant, node_group variant, session_id variant, pillar variant, "
    "component variant, status variant, event_timestamp variant, "
    "metrics map<string,variant>, params map<string,variant>, "
    f"artifact struct<{_ARTIFACT}>, trace struct<{_TRACE}>"
)
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
# The time value that stands for "not set".
_ZERO_TIME = "0001-01-01T00:00:00Z"

_TEXTS = ["event_id", "node_id", "node_group", "session_id", "pillar", "component", "status"]
_ARTIFACT_TEXTS = ["id", "kind", "node_id"]
_TRACE_TEXTS = ["source_id", "verb", "target_id", "node_id", "run_id"]
_MEMBERS = [*_TEXTS, "event_timestamp", "metrics", "params", "artifact", "trace"]
_INNER = {
    "artifact": [*_ARTIFACT_TEXTS, "meta", "created_at"],
    "trace": [*_TRACE_TEXTS, "meta", "timestamp"],
}


def decode(messages: DataFrame) -> DataFrame:
    """Add ``event`` (typed struct) and ``reason`` (NULL when the payload is well formed)."""
    named = messages.withColumn("_text", exact_names(F.col("payload"), _MEMBERS, _INNER))
    read = with_document(named, "_text", "_json", f"struct<{_ENVELOPE}>").drop("_text")
    e = F.col("_json.value")
    payload = F.coalesce(F.btrim("payload", F.lit(" \t\r\n")), F.lit(""))
    shaped = payload.startswith("{") | (payload == "null")

    texts = [e[x] for x in _TEXTS]
    texts += [e["artifact"][x] for x in _ARTIFACT_TEXTS] + [e["trace"][x] for x in _TRACE_TEXTS]
    moments = [e["event_timestamp"], e["artifact"]["created_at"], e["trace"]["timestamp"]]
    text_maps = [e["params"], e["artifact"]["meta"], e["trace"]["meta"]]

    no_values = F.array().cast("array<variant>")
    in_maps = F.concat(*[F.coalesce(F.map_values(m), no_values) for m in text_maps])
    wrong_type = F.exists(in_maps, lambda v: ~_is_text(v))
    for member in texts + moments:
        wrong_type = wrong_type | ~_is_text(member)
    bad_time = F.exists(F.array(*moments), lambda v: _text(v).isNotNull() & _moment(v).isNull())
    reason = (
        F.when(~shaped & is_json_value(payload), "not_object")
        .when(~F.col("_json.ok"), "bad_json")
        .when(wrong_type, "wrong_type")
        .when(bad_time, "bad_timestamp")
    )
    event = F.struct(
        *[_text(e[x]).alias(x) for x in _TEXTS],
        _set_moment(e["event_timestamp"]).alias("event_timestamp"),
        _last_of_each_key(e["metrics"]).alias("metrics"),
        _text_map(e["params"]).alias("params"),
        F.when(e["artifact"].isNotNull(), F.struct(
            *[F.coalesce(_text(e["artifact"][x]), F.lit("")).alias(x) for x in _ARTIFACT_TEXTS],
            _text_map(e["artifact"]["meta"]).alias("meta"),
            _set_moment(e["artifact"]["created_at"]).alias("created_at"),
        )).alias("artifact"),
        F.when(e["trace"].isNotNull(), F.struct(
            *[F.coalesce(_text(e["trace"][x]), F.lit("")).alias(x) for x in _TRACE_TEXTS],
            _text_map(e["trace"]["meta"]).alias("meta"),
            _set_moment(e["trace"]["timestamp"]).alias("timestamp"),
        )).alias("trace"),
    )
    return read.withColumns({"event": event, "reason": reason}).drop("_json")


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reason").isNull())


def quarantine(decoded: DataFrame) -> DataFrame:
    """Payloads that were dropped, with the reason."""
    return decoded.filter(F.col("reason").isNotNull()).select("msg_id", "topic", "payload", "received_at", "reason")


def ledger_rows(decoded: DataFrame) -> DataFrame:
    """Ledger rows of well-formed payloads, defaults filled in; ``msg_id`` becomes the row id."""
    e = F.col("event")
    at = _event_time()
    empty_metrics = F.create_map().cast("map<string,variant>")
    return accepted(decoded).select(
        F.col("msg_id").alias("event_id"),
        F.coalesce(e["node_id"], F.lit("")).alias("node_id"),
        e["node_group"].alias("node_group"),
        e["session_id"].alias("session_id"),
        F.coalesce(F.nullif(e["pillar"], F.lit("")), F.lit("observer")).alias("pillar"),
        F.coalesce(e["component"], F.lit("")).alias("component"),
        F.coalesce(e["status"], F.lit("")).alias("status"),
        at.alias("event_timestamp"),
        F.to_json(F.coalesce(e["metrics"], empty_metrics)).alias("metrics"),
        canonical_json(e["params"]).alias("params"),
        F.col("received_at").alias("ingested_at"),
        F.to_date(at).alias("event_date"),
    )


def artifact_rows(decoded: DataFrame) -> DataFrame:
    """Artifact log rows embedded in events; an empty node counts as absent."""
    a = F.col("event.artifact")
    return accepted(decoded).filter(a.isNotNull()).select(
        F.col("msg_id").alias("seq"),
        F.lit(True).alias("from_event"),
        a["id"].alias("id"),
        a["kind"].alias("kind"),
        F.nullif(a["node_id"], F.lit("")).alias("node_id"),
        a["meta"].alias("meta"),
        F.coalesce(a["created_at"], _event_time()).alias("created_at"),
        F.col("received_at").alias("ingested_at"),
    )


def trace_rows(decoded: DataFrame) -> DataFrame:
    """Lineage edges embedded in events."""
    t = F.col("event.trace")
    return accepted(decoded).filter(t.isNotNull()).select(
        *[t[x].alias(x) for x in _TRACE_TEXTS],
        canonical_json(t["meta"]).alias("meta"),
        F.coalesce(t["timestamp"], _event_time()).alias("event_timestamp"),
    ).select("source_id", "verb", "target_id", "node_id", "run_id", "meta", "event_timestamp")


def _event_time() -> Column:
    return F.coalesce("event.event_timestamp", "received_at")


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).isin("STRING", "VOID"), F.lit(True))


def _text(v: Column) -> Column:
    """The text of a member; members of another type are told apart by ``reason``, not here."""
    return F.try_variant_get(v, "$", "string")


def _moment(v: Column) -> Column:
    raw = _text(v)
    return F.when(raw.rlike(_RFC3339), F.translate(raw, ",", ".").try_cast("timestamp"))


def _set_moment(v: Column) -> Column:
    return F.nullif(_moment(v), F.lit(_ZERO_TIME).cast("timestamp"))


def _text_map(m: Column) -> Column:
    """Text map with JSON null as ``""``; a missing map is empty."""
    texts = F.transform_values(_last_of_each_key(m), lambda _k, v: F.coalesce(_text(v), F.lit("")))
    return F.coalesce(texts, F.create_map().cast("map<string,string>"))


def _last_of_each_key(m: Column) -> Column:
    """Of repeated keys keep the last, as JSON objects are read elsewhere."""
    keys, entries = F.map_keys(m), F.map_entries(m)
    later = lambda i: F.slice(keys, i + 2, F.size(keys))
    last = F.filter(entries, lambda entry, i: ~F.array_contains(later(i), entry["key"]))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(last)).otherwise(m)
