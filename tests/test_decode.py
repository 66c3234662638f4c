"""Strict decoding, topics, and encoding."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetskein.functions import topics, values
from fleetskein.operators import events
from fleetskein.sources import decode, messages

AT = "2024-01-02T03:04:05Z"
ARRIVED = datetime(2024, 2, 1)


def decoded(spark, payloads):
    rows = [(i, "t", p, "2024-02-01 00:00:00") for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "msg_id long, topic string, payload string, at string")
    return decode.decode(df.withColumn("received_at", F.col("at").cast("timestamp")).drop("at"))


CASES = [
    ('{"node_id":"a","component":"c","event_timestamp":"%s"}' % AT, None),
    ("null", None),
    (" null ", None),
    ("{}", None),
    ('{"extra":{"deep":[1,2]},"node_id":null}', None),
    ('{"node_id":"a","node_id":"b"}', None),
    ('{"metrics":{"a":1,"a":2}}', None),
    ('{"metrics":{"a":{"b":[1]},"n":1764575280123456789}}', None),
    ('{"params":{"a":null}}', None),
    ('{"event_timestamp":"2024-01-02T03:04:05.123456789+02:00"}', None),
    ('{"artifact":null,"trace":null,"metrics":null}', None),
    ("", "bad_json"),
    ('{"node_id":"a"', "bad_json"),
    ('{"node_id":"a"} x', "bad_json"),
    ('{"node_id":"a"}{"b":1}', "bad_json"),
    ('{"node_id":"a"},"b":{"c":1}', "bad_json"),
    ('{"node_id":"a"},{"b":1}', "bad_json"),
    ('{"node_id":"a"}]', "bad_json"),
    ("{'node_id':'a'}", "bad_json"),
    ('{"metrics":{"a":NaN}}', "bad_json"),
    ('{"metrics":5}', "bad_json"),
    ('{"artifact":"x"}', "bad_json"),
    ("[]", "not_object"),
    ('"text"', "not_object"),
    ("5", "not_object"),
    ('{"node_id":5}', "wrong_type"),
    ('{"status":{}}', "wrong_type"),
    ('{"params":{"a":1}}', "wrong_type"),
    ('{"artifact":{"id":1}}', "wrong_type"),
    ('{"trace":{"meta":{"a":true}}}', "wrong_type"),
    ('{"event_timestamp":1700000000}', "wrong_type"),
    ('{"event_timestamp":"2024-01-02"}', "bad_timestamp"),
    ('{"event_timestamp":"2024-13-02T03:04:05Z"}', "bad_timestamp"),
    ('{"event_timestamp":""}', "bad_timestamp"),
    ('{"artifact":{"created_at":"yesterday"}}', "bad_timestamp"),
]


def test_reasons(spark):
    got = {r["msg_id"]: r["reason"] for r in decoded(spark, [p for p, _ in CASES]).select("msg_id", "reason").collect()}
    assert {CASES[i][0]: reason for i, reason in got.items()} == dict(CASES)


def test_values(spark):
    payloads = [
        '{"node_id":"a","node_id":"b","pillar":"","metrics":{"a":1,"a":2,"n":1764575280123456789,"x":10.50}}',
        "null",
        '{"event_timestamp":"2024-01-02T03:04:05.123456789+02:00","params":{"z":null,"a":"1"},"session_id":"s"}',
        '{"event_timestamp":"0001-01-01T00:00:00Z","artifact":{"id":"i","node_id":"","created_at":"0001-01-01T00:00:00Z"}}',
        '{"event_timestamp":"%s","trace":{"source_id":"s","meta":{"b":"1","a":"2"}}}' % AT,
    ]
    df = decoded(spark, payloads)
    rows = {r["event_id"]: r for r in decode.ledger_rows(df).collect()}
    assert rows[0]["node_id"] == "b" and rows[0]["pillar"] == "observer"
    assert rows[0]["metrics"] == '{"a":2,"n":1764575280123456789,"x":10.5}'
    assert rows[1]["node_id"] == "" and rows[1]["metrics"] == "{}" and rows[1]["params"] == "{}"
    assert rows[1]["event_timestamp"] == rows[1]["ingested_at"]
    assert rows[2]["params"] == '{"a":"1","z":""}' and rows[2]["session_id"] == "s"
    shown = decode.ledger_rows(df).select("event_id", F.col("event_timestamp").cast("string").alias("t")).collect()
    assert {r["event_id"]: r["t"] for r in shown}[2] == "2024-01-02 01:04:05.123456"
    artifact = decode.artifact_rows(df).first()
    assert artifact["seq"] == 3 and artifact["node_id"] is None and artifact["meta"] == {}
    assert artifact["created_at"] == artifact["ingested_at"]
    trace = decode.trace_rows(df).first()
    assert trace["meta"] == '{"a":"2","b":"1"}' and trace["target_id"] == ""
    assert trace["event_timestamp"] == rows[4]["event_timestamp"]


@pytest.mark.parametrize("pattern, topic, expected", [
    ("a/b/#", "a/b", True), ("a/b/#", "a/b/c/d", True), ("a/b/#", "a/bc", False), ("#", "x/y", True),
    ("a/+/c", "a/b/c", True), ("a/+/c", "a/b/b/c", False), ("a/+/c", "a//c", True), ("a/+", "a", False),
    ("a.b/c", "axb/c", False),
])
def test_topic_filters(spark, pattern, topic, expected):
    assert spark.range(1).select(topics.matches(F.lit(topic), pattern)).first()[0] is expected


@pytest.mark.parametrize("pattern", ["a/#/b", "a/b#", "a+/b"])
def test_bad_topic_filters(pattern):
    with pytest.raises(ValueError):
        topics.filter_regex(pattern)


def test_registry_rows_do_not_reach_the_decoder(spark):
    rows = [(1, "fleet/ctd/v1/registry/n/status"), (2, "fleet/ctd/v1/observer/n/c"), (3, "other")]
    df = spark.createDataFrame(rows, "msg_id long, topic string")
    assert [r[0] for r in messages.telemetry_route(df).collect()] == [2]
    assert [r[0] for r in messages.registry_route(df).collect()] == [1]


def test_encode_then_decode(spark):
    base = spark.createDataFrame([("n", "c", "s", "2024-01-02 03:04:05.5")], "n string, c string, s string, t string")
    made = events.new_event(base, F.col("n"), F.col("c"), F.col("s"), F.col("t").cast("timestamp"))
    made = events.add_metric(events.add_metric(made, "x", F.lit(1)), "x", F.lit(2.5))
    made = events.with_artifact(made, F.lit("art"), F.lit("data"), meta=F.create_map(F.lit("k"), F.lit("v")))
    made = events.with_trace(made, F.lit("a"), F.lit("verb"), F.lit("b"), run_id=F.lit("7"))
    out = events.encode(made, "p/q")
    row = out.first()
    assert row["topic"] == "p/q/tracer/n/c"
    assert row["payload"] == (
        '{"node_id":"n","pillar":"tracer","component":"c","status":"s","event_timestamp":"2024-01-02T03:04:05.5Z",'
        '"metrics":{"x":2.5},"artifact":{"id":"art","kind":"data","meta":{"k":"v"},'
        '"created_at":"2024-01-02T03:04:05.5Z"},"trace":{"source_id":"a","verb":"verb","target_id":"b","node_id":"n",'
        '"run_id":"7","timestamp":"2024-01-02T03:04:05.5Z"}}'
    )
    back = decode.decode(out.select(
        F.lit(1).cast("long").alias("msg_id"), "topic", "payload", F.current_timestamp().alias("received_at")
    ))
    assert decode.ledger_rows(back).first()["metrics"] == '{"x":2.5}'
    assert decode.trace_rows(back).first()["run_id"] == "7"
    again = events.update_status(events.with_pillar(made, "runner"), F.lit("done"), F.lit("2024-01-03").cast("timestamp"))
    assert again.select("pillar", "status").first() == ("runner", "done")


def test_map_merge(spark):
    df = spark.sql("SELECT map('a','1','b','2') AS old, map('b','3') AS new, cast(null AS map<string,string>) AS none")
    row = df.select(values.merge_maps(F.col("old"), F.col("new")), values.merge_maps(F.col("none"), F.col("new"))).first()
    assert row[0] == {"a": "1", "b": "3"} and row[1] == {"b": "3"}


def test_names_in_any_case(spark):
    """The last of several spellings counts, nested objects included; what stands in values and metrics stays."""
    payloads = [
        '{"Node_ID":"a","node_id":"b","Metrics":{"GPU":1,"gpu":2.50},"Artifact":{"ID":"x","Kind":"k","META":{"A":"1"}}}',
        '{"node_id":"a","NODE_ID":"Node_ID\\": 5"}',
        '{"Node_ID":"a"} x',
        '{"Node_ID":5}',
    ]
    rows = {r["msg_id"]: r for r in decoded(spark, payloads).collect()}
    first = rows[0]["event"]
    assert (first["node_id"], first["artifact"]["id"], first["artifact"]["kind"], first["artifact"]["meta"]) == ("b", "x", "k", {"A": "1"})
    assert {k: v.toPython() for k, v in first["metrics"].items()} == {"GPU": 1, "gpu": 2.5}
    assert rows[1]["event"]["node_id"] == 'Node_ID": 5'
    assert [rows[i]["reason"] for i in range(4)] == [None, None, "bad_json", "wrong_type"]
    assert rows[0]["payload"] == payloads[0]
