"""Stream results equal batch results, over split files and across a restart."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetskein import schemas
from fleetskein.operators import alerts, artifacts, control, latest, sensors, silence
from fleetskein.sources import decode, messages
from fleetskein.sources.fixtures import Fixtures
from fleetskein.streaming import control as stream_control, ingest, live, sinks

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, FOLDER)


def in_files(df, path, key, parts=4):
    """Write ``df`` in ``parts`` files that hold consecutive values of ``key``."""
    for i, piece in enumerate(_split(df, key, parts)):
        piece.coalesce(1).write.mode("append").parquet(str(path))
    return str(path)


def _split(df, key, parts):
    top = df.agg(F.max(key)).first()[0] + 1
    for i in range(parts):
        yield df.filter((F.col(key) >= top * i // parts) & (F.col(key) < top * (i + 1) // parts))


def zoned(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def same(left, right):
    columns = sorted(right.columns)
    as_rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    got, expected = as_rows(left), as_rows(right)
    assert got == expected
    assert expected


def test_ingest(spark, fx, tmp_path):
    rows = zoned(fx.messages(), "received_at").cache()
    path, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    pieces = list(_split(rows, "msg_id", 4))
    for piece in pieces[:3]:
        piece.coalesce(1).write.mode("append").parquet(path)
    stream = lambda: messages.stream_messages(spark, path, max_files_per_trigger=1)
    ingest.start_ingest(stream(), root, checkpoint).awaitTermination()
    pieces[3].coalesce(1).write.mode("append").parquet(path)
    ingest.start_ingest(stream(), root, checkpoint).awaitTermination()

    decoded = decode.decode(messages.telemetry_route(rows))
    same(ingest.read_table(spark, root, "ledger"), decode.ledger_rows(decoded))
    same(ingest.read_table(spark, root, "traces"), decode.trace_rows(decoded))
    log = ingest.read_table(spark, root, "artifact_log")
    same(artifacts.compact(log), artifacts.compact(decode.artifact_rows(decoded)))
    bad = spark.read.parquet(f"{root}/quarantine")
    assert bad.count() == decode.quarantine(decoded).count()

    # A batch that is run again replaces itself; one without a marker is not read.
    before = ingest.read_table(spark, root, "ledger").count()
    first = messages.telemetry_route(pieces[0])
    ingest.write_events(first, root, 0)
    assert ingest.read_table(spark, root, "ledger").count() == before
    sinks.write_part(decode.ledger_rows(decode.decode(first)), root, "ledger", 99, ["event_date"])
    assert spark.read.parquet(f"{root}/ledger").count() > before
    assert ingest.read_table(spark, root, "ledger").count() == before

    compacted = str(tmp_path / "table")
    ingest.compact_ledger(spark, root, compacted)
    assert spark.read.parquet(compacted).count() == ingest.read_table(spark, root, "ledger").count()


def test_append_ledger(spark, fx, tmp_path):
    path = str(tmp_path / "ledger")
    ingest.append_ledger(fx.ledger(), path)
    ingest.append_ledger(fx.ledger().drop("event_date"), path)
    assert spark.read.parquet(path).count() == 2 * fx.ledger().count()


def test_alerts(spark, fx, tmp_path):
    rows = zoned(fx.registry_messages(), "received_at")
    path = in_files(rows, tmp_path / "in", "msg_id")
    out = str(tmp_path / "out")
    live.start_alerts(messages.stream_messages(spark, path), out, str(tmp_path / "cp")).awaitTermination()
    same(spark.read.parquet(out), alerts.registry_alerts(messages.registry_route(rows)))


def test_closed_sessions(spark, fx, tmp_path):
    """All sessions but those still open at the end of the stream."""
    rows = zoned(fx.ledger(), "event_timestamp")
    path = in_files(rows, tmp_path / "in", "event_id")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "out")
    live.start_silence(stream, out, str(tmp_path / "cp"), 10_800, "1 hour").awaitTermination()
    got = spark.read.parquet(out)
    columns = ["node_id", "session_start", "last_seen", "n_events"]
    batch = silence.activity_sessions(rows, 10_800).select(*columns)
    newest = rows.agg(F.max("event_timestamp")).first()[0]
    ended = batch.filter(F.col("last_seen") < F.lit(newest - timedelta(hours=4)))
    same(got.select(*columns).filter(F.col("last_seen") < F.lit(newest - timedelta(hours=4))), ended)
    assert got.join(batch, columns, "left_anti").count() == 0


def test_latest_state(spark, fx, tmp_path):
    rows = fx.ledger()
    path = in_files(rows, tmp_path / "in", "event_id")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    root = str(tmp_path / "out")
    live.start_latest_state(stream, root, str(tmp_path / "cp")).awaitTermination()
    same(live.read_latest_state(spark, root), latest.latest_row(rows, "component", "status", "metrics"))


def test_control(spark, fx, tmp_path):
    rows = zoned(fx.control_messages(), "received_at").cache()
    path = str(tmp_path / "in")
    in_files(rows, path, "msg_id", 3)
    root = str(tmp_path / "out")
    stream = messages.stream_messages(spark, path, schema=schemas.CONTROL_MESSAGES, max_files_per_trigger=1)
    # Files are taken in order of their times, which is the order they were written in.
    stream_control.start_control(stream, root, str(tmp_path / "cp"), ["benchmark"]).awaitTermination()
    same(stream_control.read_outcomes(spark, root), control.replay(rows, ["benchmark"]))


def test_sensors(spark, fx, tmp_path):
    rows = zoned(fx.raw_sensor(), "captured_at").cache()
    path = in_files(rows, tmp_path / "in", "raw_id", 2)
    root = str(tmp_path / "out")
    stream = messages.stream_messages(spark, path, schema=schemas.RAW_SENSOR, max_files_per_trigger=1)
    live.start_sensors(stream, root, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(f"{root}/metrics").drop("batch_id")
    same(got, sensors.as_metrics(sensors.normalise(rows)))
    assert spark.read.parquet(f"{root}/readings").count() == sensors.normalise(rows).count()


def test_sensor_captures_split_over_files(spark, tmp_path):
    """A load average without its memory total and a temperature without its scan come first."""
    schema = "raw_id long, node_id string, sensor string, device string, captured_at string, raw string"
    scan = "Hailo Devices:\n[-] Device 0000:01:00.0"
    texts = [
        (1, "n", "loadavg", None, "2025-01-01 00:00:00", "0.5 0.4 0.3 1/100 7"),
        (2, "n", "hailo_temp", "0000:01:00.0", "2025-01-01 00:00:00", "41.5 C"),
        (3, "n", "loadavg", None, "2025-01-01 00:00:10", "0.7 0.4 0.3 1/100 7"),
        (4, "n", "meminfo", None, "2025-01-01 00:00:00", "MemTotal:  2048 kB"),
        (5, "n", "hailo_scan", None, "2025-01-01 00:00:00", scan),
        (6, "n", "hailo_power", "0000:01:00.0", "2025-01-01 00:00:00", "3.5 W"),
    ]
    rows = spark.createDataFrame(texts, schema).withColumn("captured_at", F.col("captured_at").cast("timestamp")).cache()
    root, expected = str(tmp_path / "out"), sensors.normalise(rows)
    path = in_files(rows, tmp_path / "in", "raw_id", 2)
    stream = messages.stream_messages(spark, path, schema=schemas.RAW_SENSOR, max_files_per_trigger=1)
    live.start_sensors(stream, root, str(tmp_path / "cp")).awaitTermination()
    metrics = live.read_sensors(spark, root)
    same(metrics, sensors.as_metrics(expected))
    assert metrics.filter("component LIKE 'hailo%'").count() >= 2 and metrics.filter("component = 'host-os'").count() == 3
    same(live.read_sensors(spark, root, "readings"), sensors.as_ledger(expected))
