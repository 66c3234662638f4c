"""Transport rows: reading them, and routing them by topic.

A message is ``(msg_id, topic, payload, received_at)``. Files are read here; a
DataFrame with these columns from any other source fits the same functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fleetskein.functions import topics
from fleetskein.schemas import MESSAGES

FIREHOSE_FILTER = "fleet/ctd/v1/#"
REGISTRY_FILTER = "fleet/ctd/v1/registry/+/status"


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType = MESSAGES) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def stream_messages(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType = MESSAGES,
    max_files_per_trigger: int = 1000,
) -> DataFrame:
    """The same rows as a stream; a trigger takes a bounded number of files."""
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def subscribed(messages: DataFrame, topic_filter: str) -> DataFrame:
    return messages.filter(topics.matches(F.col("topic"), topic_filter))


def registry_route(messages: DataFrame, registry_filter: str = REGISTRY_FILTER) -> DataFrame:
    return subscribed(messages, registry_filter)


def telemetry_route(
    messages: DataFrame, firehose: str = FIREHOSE_FILTER, registry_filter: str = REGISTRY_FILTER
) -> DataFrame:
    """Everything under the firehose but the registry rows, whose own route goes first."""
    topic = F.col("topic")
    return messages.filter(topics.matches(topic, firehose) & ~topics.matches(topic, registry_filter))
