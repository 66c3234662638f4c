"""Filtered, ordered export of the ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetskein.functions import times
from fleetskein.operators.filters import in_pillar, node_like, since as not_before

#: The limit of a usual export; callers pass it.
USUAL_LIMIT = 100_000
COLUMNS = ["node_id", "pillar", "component", "status", "event_timestamp", "metrics", "params"]


def matching(
    ledger: DataFrame, pattern: str = "", pillar: str = "", since: datetime | str | Column | None = None
) -> DataFrame:
    return not_before(in_pillar(node_like(ledger, pattern), pillar), since)


def unload(
    ledger: DataFrame,
    pattern: str = "",
    pillar: str = "",
    since: datetime | str | Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The oldest ``limit`` matching rows in time order; all of them without a limit, or with one of 0 or less.

    A plain top-n would send ``limit`` rows of every task to one task. A count
    per hour, taken from the time column alone, first finds the hour in which the
    limit is reached; only rows up to that hour are sorted.
    """
    rows = matching(ledger, pattern, pillar, since)
    if limit is None or limit <= 0:
        return _typed(rows.orderBy("event_timestamp", "event_id"))
    n = limit
    hour = F.date_trunc("hour", F.col("event_timestamp").cast("timestamp"))
    per_hour = rows.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    running = per_hour.withColumn("upto", F.sum("n").over(Window.orderBy("hour")))
    # The whole input is shorter than the limit when no hour reaches it.
    last_hour = running.agg(
        F.coalesce(F.min(F.when(F.col("upto") >= n, F.col("hour"))), F.max("hour")).alias("hour")
    ).scalar()
    time_type = rows.schema["event_timestamp"].dataType
    early = rows.filter(F.col("event_timestamp") < (last_hour + times.seconds(3600)).cast(time_type))
    if "event_date" in rows.columns:
        early = early.filter(F.col("event_date") <= F.to_date(last_hour))
    return _typed(early.orderBy("event_timestamp", "event_id").limit(n))


def unload_all(
    ledger: DataFrame, path: str, pattern: str = "", pillar: str = "", since: datetime | str | Column | None = None
) -> None:
    """Every matching row as Snappy Parquet, one folder per date, sorted within files, with no global sort."""
    rows = matching(ledger, pattern, pillar, since)
    dated = _typed(rows).withColumn("event_date", F.to_date("event_timestamp"))
    (
        dated.repartition("event_date", F.pmod(F.xxhash64("node_id", "event_id"), F.lit(64)))
        .sortWithinPartitions("event_date", "node_id", "event_timestamp")
        .write.mode("overwrite")
        .option("compression", "snappy")
        .partitionBy("event_date")
        .parquet(path)
    )


def write_unload(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("compression", "snappy").parquet(path)


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("event_id").cast("string").alias("event_id"), *COLUMNS)
