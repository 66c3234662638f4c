"""Control replay on a stream: the batch replay, with the open run of every key carried over."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetskein.operators.control import OUTCOME_COLUMNS, open_runs, replay_from
from fleetskein.session import passing, written
from fleetskein.streaming import sinks


def _last_state(spark: SparkSession, root: str, batch_id: int) -> DataFrame | None:
    """State written by the newest complete batch before this one; the batch number is all the driver sees."""
    if batch_id == 0:
        return None
    last = sinks.commits(spark, root).filter(F.col("batch_id") < batch_id).agg(F.max("batch_id")).first()[0]
    return None if last is None else spark.read.parquet(f"{root}/state/batch_id={last}")


def _lasting(opened: DataFrame, others: DataFrame | None, batch: DataFrame, lateness: str) -> DataFrame:
    """Runs that a later message can still meet."""
    every = opened if others is None else opened.unionByName(others)
    newest = batch.agg(F.max("received_at")).scalar()
    return every.filter(newest.isNull() | (F.col("ends_at") > newest - F.expr(f"INTERVAL {lateness}")))


def start_control(
    messages: DataFrame, root: str, checkpoint: str, known_runners: Iterable[str], every: str | None = None, lateness: str = "1 hour"
) -> StreamingQuery:
    """Outcome of every control message. Micro-batches count as arriving one after the other.

    The state is one row per node and runner with a run that may still be met, written with each batch; a replayed
    batch reads the same earlier state and gives the same rows. A run leaves the state when the newest message was received
    ``lateness`` after its end: a message that is later than that finds the runner idle. Only runs of
    (node, runner) pairs in the batch are replayed, the others are carried over as they are.
    """
    runners = list(known_runners)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            with passing():
                before = _last_state(spark, root, batch_id)
                asked, others = None, None
                if before is not None:
                    # Any node of the batch will do here; the runner stands in the payload, which is parsed once, later.
                    nodes = batch.select("node_id").distinct()
                    asked, others = before.join(nodes, "node_id", "left_semi"), before.join(nodes, "node_id", "left_anti")
                outcomes = written(replay_from(batch, runners, asked), "control-outcomes")
                sinks.write_part(outcomes.filter("NOT carried").select(*OUTCOME_COLUMNS), root, "outcomes", batch_id)
                sinks.write_part(_lasting(open_runs(outcomes), others, batch, lateness), root, "state", batch_id)
            sinks.commit(spark, root, batch_id)
        finally:
            batch.unpersist()
        # The state that this batch was made from stays, in case the batch is run again.
        sinks.forget(spark, root, "state", batch_id - 1)

    return sinks.start(messages.writeStream.foreachBatch(save), checkpoint, every)


def read_outcomes(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.option("basePath", f"{root}/outcomes").parquet(f"{root}/outcomes")
    return rows.join(sinks.commits(spark, root), "batch_id", "left_semi").drop("batch_id")
