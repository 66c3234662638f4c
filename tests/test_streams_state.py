"""Streams with state: redeliveries, silence by the clock, run spans, snapshots, control runs; each across a restart."""

import time

import pytest
from pyspark.sql import functions as F
from test_streaming import in_files, same, zoned

from fleetskein import schemas
from fleetskein.operators import artifacts, control, redelivery, runs
from fleetskein.sources import decode, messages
from fleetskein.sources.fixtures import Fixtures
from fleetskein.streaming import control as stream_control, ingest, live, sinks

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, FOLDER)


def test_redelivered_messages_are_taken_in_once(spark, fx, tmp_path):
    """Every message twice, the second time in another file and partly after a restart."""
    once = zoned(redelivery.first_deliveries(messages.telemetry_route(fx.messages()), 10**9), "received_at").cache()
    again = once.withColumns({"msg_id": F.col("msg_id") + 10**9, "received_at": F.col("received_at") + F.expr("INTERVAL 5 MINUTES")})
    path, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    stream = lambda: messages.stream_messages(spark, path, max_files_per_trigger=1)
    start = lambda: ingest.start_ingest(stream(), root, checkpoint, redelivered_within="1 hour").awaitTermination()
    for part in (once.filter("msg_id % 2 = 0"), again.filter("msg_id % 4 = 0")):
        part.coalesce(1).write.mode("append").parquet(path)
    start()
    for part in (once.filter("msg_id % 2 = 1"), again):
        part.coalesce(1).write.mode("append").parquet(path)
    start()
    decoded = decode.decode(once)
    same(ingest.read_table(spark, root, "ledger"), decode.ledger_rows(decoded))
    same(ingest.read_table(spark, root, "traces"), decode.trace_rows(decoded))
    both = once.unionByName(again)
    same(redelivery.first_deliveries(both), once)


def test_first_deliveries(spark):
    rows = [(1, "t", "a", 0), (2, "t", "a", 3600), (3, "t", "a", 7200), (4, "t", "a", 10801), (5, "t", "b", 0), (7, "t", "b", 0), (6, "t", "b", 0), (8, "u", "a", 10), (9, "t", None, 5), (10, "t", None, 6), (11, None, "a", 6)]
    df = spark.createDataFrame(rows, "msg_id long, topic string, payload string, s long").select("*", F.timestamp_seconds("s").alias("received_at"))
    kept = redelivery.first_deliveries(df, 3600)
    assert sorted(r.msg_id for r in kept.collect()) == [1, 4, 5, 8, 9, 11] and kept.columns == df.columns
    assert redelivery.first_deliveries(df.limit(0)).count() == 0


def test_busy_content_is_reduced_before_the_shuffle(spark, fx):
    plan = redelivery.first_deliveries(fx.messages())._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.index("partial_min") > 0 and "BroadcastNestedLoop" not in plan


def events(spark, rows):
    return spark.createDataFrame([(n, float(s)) for n, s in rows], "node_id string, s double").select("node_id", F.col("s").cast("timestamp").alias("event_timestamp"))


def test_silence_without_traffic(spark, tmp_path):
    """The stream stops, and the alert comes; after a restart the node is back; what is too old is counted."""
    path, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    t = 1_700_000_000
    events(spark, [("a", t), ("a", t + 1), ("a", t + 10), ("b", t + 2), (None, t)]).coalesce(1).write.parquet(path)
    schema = "node_id string, event_timestamp timestamp"

    def run(until):
        query = live.start_silence_alerts(spark.readStream.schema(schema).parquet(path), out, checkpoint, 3, "500 milliseconds")
        try:
            for _ in range(60):
                time.sleep(0.5)
                rows = {(r.node_id, r.kind, r.at.timestamp() - t, r.n_events) for r in spark.read.schema(live.SILENCE_EVENTS).parquet(out).collect()} if query.lastProgress else set()
                if until <= rows:
                    return rows
        finally:
            query.stop()
        return rows

    # a: silent between its own rows and again at the end, when nothing comes any more; b likewise.
    first = {("a", "silent", 1.0, 2), ("a", "back", 10.0, 0), ("a", "silent", 10.0, 1), ("b", "silent", 2.0, 1)}
    assert run(first) == first
    events(spark, [("b", t + 2.5), ("a", t + 60), ("a", t + 3), ("a", t + 4)]).coalesce(1).write.mode("append").parquet(path)
    more = {("b", "back", 2.5, 0), ("a", "late", 3.0, 2), ("a", "back", 60.0, 0), ("a", "silent", 60.0, 1), ("b", "silent", 2.5, 1)}
    assert run(first | more) == first | more


def test_run_spans(spark, fx, tmp_path):
    """Equal to the batch form for all runs that the stream has passed; open runs are marked."""
    marks = zoned(fx.run_marks(), "event_timestamp").filter("event_id < 2000000000 OR event_id >= 3000000000").cache()
    path, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    ordered = marks.withColumn("at", F.unix_micros("event_timestamp"))
    low, high = ordered.agg(F.min("at"), F.max("at")).first()
    last = marks.limit(1).withColumns({"event_id": F.lit(-1).cast("bigint"), "status": F.lit("runner-end"), "metrics": F.lit('{"run_id":2}')})
    last = last.withColumn("event_timestamp", F.timestamp_micros(F.lit(high)) + F.expr("INTERVAL 30 DAYS"))
    pieces = [ordered.filter((F.col("at") >= low + (high - low) * k // 3) & (F.col("at") < low + (high - low) * (k + 1) // 3 + (k == 2))).drop("at") for k in range(3)]
    start = lambda: live.start_run_spans(spark.readStream.schema(marks.schema).option("maxFilesPerTrigger", 1).parquet(path), out, checkpoint, "6 hours").awaitTermination()
    for piece in pieces[:2]:
        piece.coalesce(1).write.mode("append").parquet(path)
    start()
    # The last rows move both watermarks past every run.
    closing = last.unionByName(last.withColumns({"status": F.lit("runner-start"), "metrics": F.lit('{"run_id":1,"duration_sec":1}')}))
    for piece in (pieces[2], closing, closing):
        piece.coalesce(1).write.mode("append").parquet(path)
    start()
    got = spark.read.parquet(out).filter("event_id <> -1")
    same(got, runs.run_spans(marks))
    states = {r.state: r["count"] for r in got.groupBy("state").count().collect()}
    assert states["open"] > 10 and states["ended"] > 10


def test_run_spans_of_odd_marks(spark):
    rows = [(1, "n", "runner-start", 0, '{"run_id":5,"duration_sec":"x"}'), (2, "n", "runner-end", -1, '{"run_id":5}'), (3, "n", "runner-end", 9, '{"run_id":5}'), (4, "n", "runner-end", 4, '{"run_id":5}'),
            (5, "m", "runner-end", 1, '{"run_id":5}'), (6, "n", "runner-start", 2, "{}"), (7, "n", "runner-end", 3, "{}"), (8, "n", "runner-start", 5, '{"run_id":5,"duration_sec":1}')]
    df = spark.createDataFrame(rows, "event_id long, node_id string, status string, s long, metrics string").withColumn("event_timestamp", F.timestamp_seconds("s"))
    found = {r.event_id: (r.state, r.lasted_sec, r.planned_end is None) for r in runs.run_spans(df).collect()}
    assert found == {1: ("ended", 4.0, False), 6: ("open", None, False), 8: ("ended", 4.0, False)}


def test_current_run_takes_over(spark):
    start = lambda i, s, d: (i, "n", "runner:benchmark", "runner-start", s, f'{{"run_id":{i},"duration_sec":{d}}}')
    row = lambda i, s: (i, "n", "host-os", "active", s, "{}")
    rows = [start(1, 0, 100_000), start(2, 5000, 10), start(3, 5000, 20), start(4, 90_000, '"x"'), *(row(10 + k, s) for k, s in enumerate((-1, 0, 4999, 5000, 5020, 5021, 90_001, 200_000)))]
    df = spark.createDataFrame(rows, "event_id long, node_id string, component string, status string, s long, metrics string").withColumn("event_timestamp", F.timestamp_seconds("s"))
    assert {r.event_id: r.run_id for r in runs.telemetry_of_current_run(df).collect()} == {11: 1, 12: 1, 13: 3, 14: 3}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_rows_of_current_runs_grow_no_faster_than_the_ledger(spark, folder):
    ledger = Fixtures(spark, f"/root/testdata/{folder}").ledger()
    found = runs.telemetry_of_current_run(ledger)
    assert 0 < found.count() <= ledger.count() and found.select("event_id").distinct().count() == found.count()


@pytest.mark.parametrize("seed", range(3))
def test_snapshots_merge_in_any_order(spark, seed):
    import random

    rng = random.Random(seed)
    log = [(k, rng.random() < 0.6, f"a{rng.randrange(6)}", f"k{rng.randrange(4)}", rng.choice([None, "n1", "n2"]), {f"m{rng.randrange(3)}": str(k)} if rng.random() < 0.8 else None, rng.randrange(1000), k) for k in range(120)]
    df = spark.createDataFrame(log, "seq long, from_event boolean, id string, kind string, node_id string, meta map<string,string>, c long, i long")
    df = df.select("*", F.timestamp_seconds("c").alias("created_at"), F.timestamp_seconds("i").alias("ingested_at")).drop("c", "i").cache()
    parts = [df.filter(F.col("seq") % 4 == k) for k in range(4)]
    rng.shuffle(parts)
    merged = artifacts.snapshot(parts[0])
    for part in parts[1:]:
        merged = artifacts.merge(artifacts.snapshot(part), merged)
    same(artifacts.current(merged), artifacts.compact(df))
    assert merged.schema.simpleString() == spark.createDataFrame([], artifacts.SNAPSHOT).schema.simpleString()


def test_snapshot_reads_new_batches_only(spark, fx, tmp_path):
    root = str(tmp_path / "out")
    rows = zoned(fx.messages(), "received_at").cache()
    assert ingest.update_snapshot.__doc__ and not sinks.newest_marker(spark, f"{root}/snapshots")
    for batch, part in enumerate([rows.filter("msg_id % 3 = 1"), rows.filter("msg_id % 3 = 0")]):
        ingest.write_events(messages.telemetry_route(part), root, batch)
    ingest.update_snapshot(spark, root)
    # An unfinished snapshot, and a log that is in the last snapshot already and would count again if it were read.
    sinks.write_part(spark.createDataFrame([], schemas.ARTIFACT_LOG), root, "artifact_log", 0)
    ingest.write_events(messages.telemetry_route(rows.filter("msg_id % 3 = 2")), root, 2)
    now = artifacts.current(ingest.update_snapshot(spark, root))
    same(now, artifacts.compact(decode.artifact_rows(decode.decode(messages.telemetry_route(rows)))))
    same(artifacts.current(ingest.update_snapshot(spark, root)), now)


def test_control_state_shrinks_after_runs_end(spark, tmp_path):
    say = lambda k, node, s, duration: (k, node, f'{{"runner":"benchmark","params":{{"duration_sec":{duration}}}}}', s)
    batches = [
        [say(1, "a", 0, 600), say(2, "b", 0, 86_400), say(3, "c", 10, 600)],
        [say(4, "a", 300, 60)],
        [say(5, "d", 9000, 60)],
        [say(6, "b", 9100, 60), say(7, "a", 9100, 60)],
    ]
    path, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    frame = lambda rows: spark.createDataFrame(rows, "msg_id long, node_id string, payload string, s long").select("msg_id", "node_id", "payload", F.timestamp_seconds("s").alias("received_at"))
    held = []
    for k, rows in enumerate(batches):
        frame(rows).coalesce(1).write.mode("append").parquet(path)
        stream = messages.stream_messages(spark, path, schema=schemas.CONTROL_MESSAGES, max_files_per_trigger=1)
        stream_control.start_control(stream, root, checkpoint, ["benchmark"]).awaitTermination()
        held.append(sorted(r.node_id for r in spark.read.parquet(f"{root}/state/batch_id={k}").collect()))
    assert held == [["a", "b", "c"], ["a", "b", "c"], ["b", "d"], ["a", "b", "d"]]
    same(stream_control.read_outcomes(spark, root), control.replay(frame(sum(batches, [])), ["benchmark"]))
    # Two states are left, and no table of the replay.
    import os

    from fleetskein.session import scratch_folder

    assert sorted(os.listdir(f"{root}/state")) == ["batch_id=2", "batch_id=3"]
    assert not [f for f in os.listdir(scratch_folder(spark)) if f.startswith("control-outcomes")]
