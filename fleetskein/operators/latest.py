"""Latest rows per node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fleetskein.functions import times


def last_seen(ledger: DataFrame) -> DataFrame:
    """``node_id, last_seen``. Two columns are read; one row per node and task is shuffled."""
    return ledger.groupBy("node_id").agg(F.max("event_timestamp").alias("last_seen"))


def latest_row(ledger: DataFrame, *columns: str) -> DataFrame:
    """The newest row of every node. Equal times are decided by the higher ``event_id``.

    ``max_by`` keeps one row per node in every task before the shuffle, so a node
    with a large share of the ledger costs no more than any other.
    """
    order = F.struct("event_timestamp", "event_id")
    row = F.struct("event_timestamp", *columns)
    newest = ledger.groupBy("node_id").agg(F.max_by(row, order).alias("row"))
    return newest.select(
        "node_id", F.col("row.event_timestamp").alias("last_seen"), *[F.col(f"row.{c}").alias(c) for c in columns]
    )


def latest_n(ledger: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` rows of every node, with ``rank`` 1 for the newest.

    Spark limits each group in the map tasks (``WindowGroupLimit``), so at most
    ``n`` rows per node and task are shuffled.
    """
    newest_first = Window.partitionBy("node_id").orderBy(F.desc("event_timestamp"), F.desc("event_id"))
    ranked = ledger.withColumn("rank", F.row_number().over(newest_first)).filter(F.col("rank") <= n)
    return with_line(ranked.select("node_id", "rank", "event_id", "component", "metrics", "event_timestamp"))


def latest_of_node(ledger: DataFrame, node_id: str, n: int = 5) -> DataFrame:
    """The newest ``n`` rows of one node: a filter pushed to the scan and a top-n."""
    rows = (
        ledger.filter(F.col("node_id") == node_id)
        .orderBy(F.desc("event_timestamp"), F.desc("event_id"))
        .limit(n)
    )
    return with_line(rows.select("node_id", "event_id", "component", "metrics", "event_timestamp"))


def with_line(rows: DataFrame) -> DataFrame:
    time_text = times.clock(F.col("event_timestamp"))
    return rows.withColumn("line", times.reading_line(time_text, F.col("component"), F.col("metrics")))
