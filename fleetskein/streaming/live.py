"""Stream forms of alerts, silence, latest state and sensor readings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetskein.operators import runs, sensors
from fleetskein.operators.alerts import registry_alerts
from fleetskein.operators.latest import latest_row
from fleetskein.sources.messages import REGISTRY_FILTER, registry_route
from fleetskein.streaming import sinks
from fleetskein.streaming.control import _last_state


def start_alerts(
    messages: DataFrame, path: str, checkpoint: str, every: str | None = None, registry: str = REGISTRY_FILTER
) -> StreamingQuery:
    """Alert rows from status messages; stateless, one alert per message."""
    return sinks.append_parquet(registry_alerts(registry_route(messages, registry)), path, checkpoint, every)


def closed_sessions(ledger: DataFrame, gap_seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """Stretches of activity that have ended: the node fell silent at ``last_seen``.

    The next session's start is the node's return. A gap of exactly ``gap_seconds``
    ends a session, as in the batch form.
    """
    at = F.col("event_timestamp").cast("timestamp")
    timed = ledger.select("node_id", at.alias("event_timestamp")).withWatermark("event_timestamp", lateness)
    sessions = timed.groupBy("node_id", F.session_window("event_timestamp", f"{gap_seconds} seconds")).agg(
        F.min("event_timestamp").alias("session_start"),
        F.max("event_timestamp").alias("last_seen"),
        F.count(F.lit(1)).alias("n_events"),
    )
    return sessions.drop("session_window")


def start_silence(
    ledger: DataFrame,
    path: str,
    checkpoint: str,
    gap_seconds: int = 60,
    lateness: str = "10 minutes",
    every: str | None = None,
) -> StreamingQuery:
    return sinks.append_parquet(closed_sessions(ledger, gap_seconds, lateness), path, checkpoint, every)


#: Events of a node's silence: when it fell silent or came back, what it had sent, rows that came too late.
SILENCE_EVENTS = "node_id string, kind string, at timestamp, n_events long"
_SILENCE_STATE = "last_seen timestamp, n_events long, silent boolean"


def silence_events(ledger: DataFrame, gap_seconds: int = 60) -> DataFrame:
    """Rows as soon as they are known: ``silent`` (since ``at``), ``back`` (since ``at``) and ``late`` (rows of an activity that has ended).

    A node is silent when its time of arrival is ``gap_seconds`` ago, also when nothing moves on the stream any more: the
    timer of each node runs on the clock. A node whose rows are themselves ``gap_seconds`` apart, as in a backlog, was silent between
    them. A row older than the last one by the gap or more is ``late``: ``at`` is the oldest such time of the batch, ``n_events`` their number, and
    nothing else follows from them. The state is one row per node; the ledger's rows are reduced to (node, slot) in the map tasks.
    """
    slot = gap_seconds * 1_000_000
    timed = ledger.select("node_id", F.col("event_timestamp").cast("timestamp").alias("event_timestamp")).filter("node_id IS NOT NULL AND event_timestamp IS NOT NULL")
    reduced = timed.mapInPandas(partial(_slots, slot), "node_id string, first_seen timestamp, last_seen timestamp, n_events long")
    return reduced.groupBy("node_id").applyInPandasWithState(partial(_silence, gap_seconds), SILENCE_EVENTS, _SILENCE_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def _slots(slot: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one slot lie less than a gap apart, so their first and last time and their number say all."""
    for frame in frames:
        micros = frame["event_timestamp"].astype("datetime64[us]").astype("int64")
        found = frame.groupby(["node_id", micros // slot])["event_timestamp"].agg(["min", "max", "size"]).reset_index(level=0)
        yield found.rename(columns={"min": "first_seen", "max": "last_seen", "size": "n_events"})


def _silence(gap_seconds: int, key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, n, silent = state.get if state.exists else (None, 0, False)
    out, gap = [], pd.Timedelta(seconds=gap_seconds)
    if state.hasTimedOut:
        state.update((last, 0, True))
        yield pd.DataFrame([(key[0], "silent", last, n)], columns=["node_id", "kind", "at", "n_events"])
        return
    parts = pd.concat(list(frames)).sort_values("first_seen")
    begun = parts["first_seen"] if last is None else parts["first_seen"].where(parts["first_seen"] > pd.Timestamp(last) - gap)
    late = parts[begun.isna()]
    if len(late):
        out.append(("late", late["first_seen"].min(), int(late["n_events"].sum())))
    for first, end, count in parts[begun.notna()][["first_seen", "last_seen", "n_events"]].itertuples(index=False):
        if last is not None and first - pd.Timestamp(last) >= gap:
            if not silent:
                out.append(("silent", last, n))
            out.append(("back", first, 0))
            n, silent = 0, False
        elif silent:
            # The clock was ahead of the rows: they go on where the node was taken for silent.
            out.append(("back", first, 0))
            silent = False
        last, n = end if last is None else max(pd.Timestamp(last), end), n + int(count)
    if last is not None:
        state.update((last, n, silent))
    if not silent:
        state.setTimeoutDuration(gap_seconds * 1000)
    yield pd.DataFrame([(key[0], *x) for x in out], columns=["node_id", "kind", "at", "n_events"])


def start_silence_alerts(ledger: DataFrame, path: str, checkpoint: str, gap_seconds: int = 60, every: str = "10 seconds") -> StreamingQuery:
    """Keep ``silence_events`` in a folder. It runs by a clock, since silence is not something that arrives."""
    return sinks.append_parquet(silence_events(ledger, gap_seconds), path, checkpoint, every)


def run_spans(ledger: DataFrame, longest: str = "1 day", lateness: str = "10 minutes") -> DataFrame:
    """Run starts with their ends on a stream, columns as ``runs.run_spans`` has them.

    An ended run comes out with its end; an open one when no end can come any more: ``longest`` after its start,
    and ``lateness`` for late rows. Starts wait that long in the state, ends no longer than the lateness. A run has one end.
    """
    timed = ledger.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    starts = runs.runs(timed).select("node_id", "event_id", "run_id", "start_time", F.col("end_time").alias("planned_end")).withWatermark("start_time", lateness)
    ends = runs.run_ends(timed).select(F.col("node_id").alias("_node"), F.col("run_id").alias("_run"), "end_time").withWatermark("end_time", lateness)
    met = (
        (F.col("node_id") == F.col("_node")) & (F.col("run_id") == F.col("_run"))
        & (F.col("end_time") >= F.col("start_time")) & (F.col("end_time") <= F.col("start_time") + F.expr(f"INTERVAL {longest}"))
    )
    return runs.with_state(starts.join(ends, met, "left").drop("_node", "_run"))


def start_run_spans(ledger: DataFrame, path: str, checkpoint: str, longest: str = "1 day", lateness: str = "10 minutes", every: str | None = None) -> StreamingQuery:
    return sinks.append_parquet(run_spans(ledger, longest, lateness), path, checkpoint, every)


def start_latest_state(ledger: DataFrame, root: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Latest row per node, kept up to date; the state is one row per node."""

    def save(batch: DataFrame, batch_id: int) -> None:
        sinks.write_part(batch, root, "latest", batch_id)
        sinks.commit(batch.sparkSession, root, batch_id)

    newest = latest_row(ledger, "component", "status", "metrics")
    return sinks.start(newest.writeStream.outputMode("update").foreachBatch(save), checkpoint, every)


def read_latest_state(spark: SparkSession, root: str) -> DataFrame:
    """The newest saved row per node."""
    rows = spark.read.option("basePath", f"{root}/latest").parquet(f"{root}/latest")
    rows = rows.join(sinks.commits(spark, root), "batch_id", "left_semi")
    row = F.struct("last_seen", "component", "status", "metrics")
    return rows.groupBy("node_id").agg(F.max_by(row, "batch_id").alias("row")).select("node_id", "row.*")


#: Sensors whose texts give a reading together with others of the same capture.
JOINED = ("hailo_scan", "hailo_temp", "hailo_power", "loadavg", "meminfo")


def start_sensors(raw: DataFrame, root: str, checkpoint: str, every: str | None = None, lateness: str = "1 hour") -> StreamingQuery:
    """Sensor dumps to ledger-shaped rows and to long metrics; ``read_sensors`` gives what holds.

    The texts of one capture may come in several micro-batches. Those of joined sensors are kept in a table written
    with each batch until their node has sent texts captured ``lateness`` later; when another text of the capture
    arrives, its rows are written anew and the earlier ones as withdrawn.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        parts = batch.filter(F.col("sensor").isin(*JOINED))
        held = _last_state(batch.sparkSession, root, batch_id)
        held = parts.limit(0) if held is None else held
        touched = parts.select(F.col("node_id").alias("_node"), F.col("captured_at").alias("_at")).distinct()
        same = F.col("node_id").eqNullSafe(F.col("_node")) & F.col("captured_at").eqNullSafe(F.col("_at"))
        again = held.join(touched, same, "left_semi").persist()
        readings = sensors.normalise(batch.unionByName(again)).persist()
        withdrawn = sensors.normalise(again).persist()
        try:
            for rows, prefix in ((readings, ""), (withdrawn, "withdrawn_")):
                sinks.write_part(sensors.as_ledger(rows), root, f"{prefix}readings", batch_id)
                sinks.write_part(sensors.as_metrics(rows), root, f"{prefix}metrics", batch_id)
            texts = held.unionByName(parts)
            newest = texts.groupBy(F.col("node_id").alias("_node")).agg(F.max("captured_at").alias("_newest"))
            recent = F.col("node_id").eqNullSafe(F.col("_node")) & (F.col("captured_at") >= F.col("_newest") - F.expr(f"INTERVAL {lateness}"))
            sinks.write_part(texts.join(newest, recent, "left_semi"), root, "state", batch_id)
            sinks.commit(batch.sparkSession, root, batch_id)
        finally:
            for table in (withdrawn, readings, again, batch):
                table.unpersist()

    return sinks.start(raw.writeStream.foreachBatch(save), checkpoint, every)


def read_sensors(spark: SparkSession, root: str, table: str = "metrics") -> DataFrame:
    """Rows of ``readings`` or ``metrics`` in complete batches, without those that were withdrawn later."""

    def rows(name: str) -> DataFrame:
        found = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
        return found.join(sinks.commits(spark, root), "batch_id", "left_semi").drop("batch_id")

    # Every withdrawn row was written once before.
    return rows(table).exceptAll(rows(f"withdrawn_{table}"))
