"""Row predicates over the ledger. Only the filters that are asked for enter the plan."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from fleetskein.functions.values import json_text, number_or_null
from fleetskein.schemas import RUN_COMPONENT

_IDENTIFIER = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


def _moment(value: datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def for_node(ledger: DataFrame, node_id: str) -> DataFrame:
    return ledger.filter(F.col("node_id") == node_id)


def node_like(ledger: DataFrame, pattern: str = "") -> DataFrame:
    """LIKE pattern; empty means every node."""
    return ledger.filter(F.col("node_id").like(pattern)) if pattern and pattern != "%" else ledger


def in_pillar(ledger: DataFrame, pillar: str = "") -> DataFrame:
    return ledger.filter(F.col("pillar") == pillar) if pillar else ledger


def since(ledger: DataFrame, start: datetime | str | Column | None = None) -> DataFrame:
    """Inclusive lower bound; the date bound lets Spark skip whole partitions."""
    if start is None:
        return ledger
    bound = _moment(start).cast(ledger.schema["event_timestamp"].dataType)
    kept = ledger.filter(F.col("event_timestamp") >= bound)
    if "event_date" in ledger.columns:
        kept = kept.filter(F.col("event_date") >= F.to_date(bound))
    return kept


def with_status(ledger: DataFrame, status: str) -> DataFrame:
    return ledger.filter(F.col("status") == status)


def not_run_markers(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("component") != RUN_COMPONENT)


def is_degraded(status: Column) -> Column:
    low = F.lower(status)
    return low.contains("error") | low.contains("fail")


def is_blocking(status: Column) -> Column:
    """The two statuses that make a node unhealthy; exact, case-sensitive."""
    return status.isin("error", "critical")


def metric_above_text(ledger: DataFrame, key: str, threshold: str) -> DataFrame:
    """Text comparison, as the JSON ``->>`` operator does it: ``'5' > '45'``, ``'100' < '45'``."""
    return ledger.withColumn("value", json_text(F.col("metrics"), key)).filter(F.col("value") > F.lit(threshold))


def metric_above_number(ledger: DataFrame, key: str, threshold: float) -> DataFrame:
    """Numeric form of the same question; text that is no number is left out."""
    value = number_or_null(json_text(F.col("metrics"), key))
    return ledger.withColumn("value", value).filter(F.col("value") > F.lit(float(threshold)))


def is_identifier(name: str) -> bool:
    return _IDENTIFIER.fullmatch(name) is not None
