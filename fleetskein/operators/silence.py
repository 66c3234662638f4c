"""Periods of activity and of silence per node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fleetskein.functions import times


def activity_sessions(ledger: DataFrame, gap_seconds: int = 60) -> DataFrame:
    """Stretches of activity: a row at least ``gap_seconds`` after the one before starts a new one.

    Two rows in the same slot of ``gap_seconds`` can never be that far apart, so
    the first and last time of each (node, slot) hold all there is to know. The
    ledger is reduced to slots in the map tasks, and only slots are ordered per node.
    """
    slot = times.slot_of(F.col("event_timestamp"), gap_seconds)
    slots = ledger.groupBy("node_id", slot.alias("slot")).agg(
        F.min("event_timestamp").alias("first_seen"),
        F.max("event_timestamp").alias("last_seen"),
        F.count(F.lit(1)).alias("n_events"),
    )
    in_time = Window.partitionBy("node_id").orderBy("slot")
    silent_for = F.col("first_seen") - F.lag("last_seen").over(in_time)
    starts = slots.withColumn("starts", F.coalesce(silent_for >= times.seconds(gap_seconds), F.lit(True)))
    numbered = starts.withColumn("session", F.sum(F.col("starts").cast("long")).over(in_time))
    return numbered.groupBy("node_id", "session").agg(
        F.min("first_seen").alias("session_start"),
        F.max("last_seen").alias("last_seen"),
        F.sum("n_events").alias("n_events"),
    )


def silent_gaps(ledger: DataFrame, gap_seconds: int = 60) -> DataFrame:
    """One row per return of a node: when it went silent and when it was back."""
    in_time = Window.partitionBy("node_id").orderBy("session")
    sessions = activity_sessions(ledger, gap_seconds)
    back = sessions.withColumn("silent_since", F.lag("last_seen").over(in_time))
    return back.filter(F.col("silent_since").isNotNull()).select(
        "node_id",
        "silent_since",
        F.col("session_start").alias("back_at"),
        times.elapsed(F.col("silent_since"), F.col("session_start")).alias("silent_for"),
    )
