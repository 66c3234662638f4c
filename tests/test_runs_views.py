"""Runs, export, views and named questions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetskein.operators import filters, runs, unload, views

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "event_id long, node_id string, pillar string, component string, status string, event_timestamp timestamp_ntz, "
    "metrics string, params string"
)


def ledger(spark, rows):
    """Rows of (node, component, status, seconds after T0, metrics)."""
    data = [
        (i, node, "observer", comp, state, T0 + timedelta(seconds=at), metrics, "{}")
        for i, (node, comp, state, at, metrics) in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def start(node, at, run_id, duration):
    tail = "" if duration is None else f',"duration_sec":{duration}'
    return (node, "runner:benchmark", "runner-start", at, f'{{"run_id":{run_id}{tail}}}')


def sensor(node, at):
    return (node, "host-os", "active", at, "{}")


def test_run_interval_is_closed_and_fractional(spark):
    rows = ledger(spark, [
        start("a", 100, 1764575280123456789, "10.5"), sensor("a", 99.999999), sensor("a", 100), sensor("a", 110.5),
        sensor("a", 110.500001), sensor("b", 105), start("c", 50, 7, 1), start("d", 0, 9, None), sensor("d", 0),
    ])
    got = runs.latest_run_telemetry(rows).orderBy("event_id").collect()
    assert [(r["event_id"], r["run_id"]) for r in got] == [(2, 1764575280123456789), (3, 1764575280123456789)]
    assert got[1]["line"] == "[00:01:50.500] host-os: {}"
    counts = {r["node_id"]: r["n"] for r in runs.latest_run_counts(rows).collect()}
    assert counts == {"a": 2, "c": 0, "d": 0}


def test_overlapping_and_long_runs(spark):
    rows = ledger(spark, [
        start("a", 0, 1, 10**9), start("a", 5, 2, 3600 * 5), start("a", 7000, 3, 0), sensor("a", 7000), sensor("a", 90_000),
    ])
    got = sorted((r["run_id"], r["event_id"]) for r in runs.all_run_telemetry(rows, 3600).collect())
    assert got == [(1, 3), (1, 4), (2, 3), (3, 3)]
    plain = runs.runs(rows).alias("r").join(
        filters.not_run_markers(rows).alias("t"),
        (F.col("r.node_id") == F.col("t.node_id")) & F.col("t.event_timestamp").between(F.col("start_time"), F.col("end_time")),
    )
    assert plain.count() == len(got)


def test_metrics_of_a_run_are_read_once(spark, monkeypatch):
    """What is asked of a run's end before its slots are laid out doesn't parse the metrics again."""
    rows = ledger(spark, [start("a", 0, 1, 7200), start("a", 5, 2, -3), start("b", 9, 3, None), sensor("a", 60), sensor("b", 60)])
    laid_out = []
    monkeypatch.setattr(runs, "written", lambda df, label: laid_out.append(df) or df)
    found = runs.all_run_telemetry(rows)
    assert [(r["node_id"], r["run_id"], r["event_id"]) for r in found.collect()] == [("a", 1, 3)]
    parsers = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("get_json_object")
    assert 0 < parsers(laid_out[0]) <= parsers(runs.runs(rows))


def test_unload(spark):
    rows = ledger(spark, [sensor(f"n{i % 3}", (i * 7919) % 50_000) for i in range(500)])
    ordered = rows.orderBy("event_timestamp", "event_id").collect()
    for limit in (1, 77, 499, 500, 10_000):
        got = unload.unload(rows, limit=limit).collect()
        assert [r["event_id"] for r in got] == [str(r["event_id"]) for r in ordered[:limit]]
    assert unload.unload(rows, limit=-3).count() == 500
    assert {r["node_id"] for r in unload.unload(rows, "n_").collect()} == {"n0", "n1", "n2"}
    assert unload.unload(rows, "zzz").count() == 0
    assert unload.unload(rows, since=T0 + timedelta(seconds=49_000)).count() == rows.filter(
        F.col("event_timestamp") >= F.lit("2024-01-01 13:36:40")).count()


def test_unload_files(spark, tmp_path):
    rows = ledger(spark, [sensor("n", i * 40_000) for i in range(20)])
    unload.unload_all(rows, str(tmp_path / "all"), since=T0 + timedelta(days=1))
    back = spark.read.parquet(str(tmp_path / "all"))
    assert back.count() == unload.matching(rows, since=T0 + timedelta(days=1)).count() == 17
    unload.write_unload(unload.unload(rows, limit=5), str(tmp_path / "five"))
    assert spark.read.parquet(str(tmp_path / "five")).count() == 5


def test_text_and_number_comparison(spark):
    rows = ledger(spark, [("n", "c", "s", i, f'{{"temperature_c":{v}}}') for i, v in enumerate(["5", "100", "46.5", '"x"', "null"])])
    assert {r["value"] for r in filters.metric_above_text(rows, "temperature_c", "45").collect()} == {"5", "46.5", "x"}
    assert {r["value"] for r in filters.metric_above_number(rows, "temperature_c", 45).collect()} == {100.0, 46.5}


@pytest.mark.parametrize("name", ["1abc", "a-b", "a\n", "", "a b", "ä"])
def test_bad_view_names(spark, name):
    with pytest.raises(ValueError):
        views.register_view(spark, name, "SELECT 1 AS x")


def test_views(spark):
    views.register_view(spark, "_v1", "SELECT id, id % 2 = 0 AS even FROM range(4)")
    views.register_view(spark, "_v1", "SELECT id FROM range(3)")
    assert [r["row"] for r in views.query_maps(spark, "SELECT id, null AS x FROM _v1 WHERE id > ?", [1]).collect()] == ['{"id":2,"x":null}']
    views.run_statement(spark, "DROP VIEW _v1")
    assert not spark.catalog.tableExists("_v1")


def test_questions(spark):
    rows = ledger(spark, [sensor("a", i) for i in range(7)] + [start("b", 0, 1, 5), sensor("b", 1)])
    lines = lambda *a, **k: [r["line"] for r in views.ask(rows, *a, **k).collect()]
    assert lines("get_node_telemetry", {"node_id": "a"}) == [f"[00:00:0{i}] host-os: {{}}" for i in (6, 5, 4, 3, 2)]
    assert lines("get_node_telemetry", {"node_id": "z"}) == ["No recent telemetry found for z"]
    assert lines("get_node_telemetry", {"node_id": "z", "full_time": True}) == ["No telemetry found for z"]
    assert lines("analyze_latest_benchmark", {"node_id": "b"}) == [
        "Found 1 hardware telemetry events during the benchmark:", "[00:00:01.000] host-os: {}",
    ]
    assert lines("analyze_latest_benchmark", {"node_id": "a"}) == [
        "No telemetry was recorded during the last benchmark run for a"
    ]
    now = F.lit("2024-01-01 00:01:03").cast("timestamp_ntz")
    assert lines("check_offline_nodes", as_of=now) == ["⚠️ b (Last seen: 1m2s)"]
    early = F.lit("2024-01-01 00:00:05").cast("timestamp_ntz")
    assert lines("check_offline_nodes", as_of=early) == ["All nodes are currently online and reporting."]
    for name, args in (("get_node_telemetry", {}), ("analyze_latest_benchmark", {"node_id": 5}), ("nothing", {})):
        with pytest.raises(ValueError):
            views.ask(rows, name, args)


@pytest.mark.parametrize("name, error", [
    ("get_node_telemetry", "^Missing required argument 'node_id'$"),
    ("analyze_latest_benchmark", "^Missing node_id$"),
])
def test_error_texts(spark, name, error):
    with pytest.raises(ValueError, match=error):
        views.ask(spark.range(1), name)
