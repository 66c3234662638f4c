"""Boundaries of the status questions, on hand-made rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetskein.functions import times
from fleetskein.operators import latest, silence, status

NOW = datetime(2024, 5, 1, 12, 0, 0)
SCHEMA = "event_id long, node_id string, component string, status string, event_timestamp timestamp_ntz, metrics string"


def ledger(spark, rows):
    """Rows of (node, seconds before NOW, status)."""
    data = [
        (i, node, "host-os", state, NOW - timedelta(seconds=age), "{}") for i, (node, age, state) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def by_node(df, *columns):
    return {r["node_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}




def now_column():
    return F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz")


def test_offline_is_strict(spark):
    rows = ledger(spark, [("a", 60, "active"), ("b", 60.000001, "active"), ("c", 3605, "active")])
    assert by_node(status.offline_nodes(rows, 60, now_column()), "elapsed") == {"b": "1m0s", "c": "1h0m5s"}


def test_node_list_is_strict(spark):
    rows = ledger(spark, [("a", 300, "x"), ("b", 301, "x")])
    assert by_node(status.node_list(rows, as_of=now_column()), "status") == {"a": "active", "b": "offline"}
    assert by_node(status.node_list(rows, as_of=now_column()), "last_seen")["a"] == "2024-05-01T11:55:00Z"


def test_states(spark):
    rows = ledger(spark, [
        ("a", 180, "active"), ("b", 181, "error"), ("c", 0, "ERROR"), ("d", 0, "failover"), ("e", 0, "ok"),
        ("f", 210, "x"), ("g", 150, "x"),
    ])
    assert by_node(status.node_states(rows, as_of=now_column()), "state", "detail") == {
        "a": ("running", "clean"),
        "b": ("oof!!!", "unreachable (3m ago)"),
        "c": ("degraded", "ERROR"),
        "d": ("degraded", "failover"),
        "e": ("running", "clean"),
        "f": ("oof!!!", "unreachable (4m ago)"),
        "g": ("running", "clean"),
    }


def test_report(spark):
    rows = ledger(spark, [("b", 0, "error"), ("a", 600, "x"), ("c", 0, "ok")])
    report = status.degraded_report(status.node_states(rows, as_of=now_column())).first()["report"]
    assert report == (
        "The following nodes are currently degraded or unreachable:\n- a (unreachable (10m ago))\n- b (error)\n"
    )
    calm = status.node_states(ledger(spark, [("c", 0, "ok")]), as_of=now_column())
    assert status.degraded_report(calm).count() == 0


def test_health(spark):
    rows = ledger(spark, [("a", 60, "ok"), ("b", 59, "ok"), ("c", 0, "critical"), ("d", 0, "Critical"), ("e", 0, "error")])
    healthy = by_node(status.cluster_status(rows, 60, now_column()), "is_healthy")
    assert healthy == {"a": False, "b": True, "c": False, "d": True, "e": False}


def test_default_now_is_the_clock(spark):
    assert by_node(status.node_states(ledger(spark, [("a", 0, "ok")])), "state") == {"a": "oof!!!"}


def test_latest_row_breaks_ties_by_id(spark):
    rows = ledger(spark, [("a", 5, "first"), ("a", 5, "second"), ("a", 9, "old")])
    assert by_node(latest.latest_row(rows, "status"), "status") == {"a": "second"}
    ranked = latest.latest_n(rows, 2).orderBy("rank").collect()
    assert [(r["rank"], r["event_id"]) for r in ranked] == [(1, 1), (2, 0)]
    assert ranked[0]["line"] == "[11:59:55] host-os: {}"


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert latest.latest_row(empty, "status").count() == 0
    assert status.cluster_status(empty, 60, status.newest_time(empty)).count() == 0
    assert silence.silent_gaps(empty).count() == 0


@pytest.mark.parametrize("seconds, text", [
    (0, "0s"), (0.4, "0s"), (0.5, "1s"), (45, "45s"), (59.5, "1m0s"), (60, "1m0s"), (3599.4, "59m59s"),
    (3605, "1h0m5s"), (90061, "25h1m1s"), (-45, "-45s"),
])
def test_elapsed(spark, seconds, text):
    start = F.lit((NOW - timedelta(seconds=seconds)).isoformat(sep=" ")).cast("timestamp_ntz")
    assert spark.range(1).select(times.elapsed(start, now_column())).first()[0] == text


@pytest.mark.parametrize("minutes, text", [(2.5, "2"), (3.5, "4"), (2.51, "3"), (0.5, "0")])
def test_minutes(spark, minutes, text):
    start = F.lit((NOW - timedelta(minutes=minutes)).isoformat(sep=" ")).cast("timestamp_ntz")
    assert spark.range(1).select(times.minutes_ago(start, now_column())).first()[0] == text


def test_gap_of_exactly_the_limit_starts_a_session(spark):
    rows = ledger(spark, [("a", 120, "x"), ("a", 60, "x"), ("a", 0.000001, "x"), ("b", 7, "x")])
    sessions = silence.activity_sessions(rows, 60).orderBy("node_id", "session").collect()
    assert [(r["node_id"], r["session"], r["n_events"]) for r in sessions] == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1)]
    gap = silence.silent_gaps(rows, 60).collect()
    assert [(g["node_id"], g["silent_for"]) for g in gap] == [("a", "1m0s")]
