"""Alert rows from registry status messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetskein.functions import topics

DEFAULT_TITLE = "Hardware Alert"


def registry_alerts(messages: DataFrame, title: str = DEFAULT_TITLE) -> DataFrame:
    """One alert per ONLINE or OFFLINE message, in batch or on a stream. Other bodies and short topics give none."""
    topic, status = F.col("topic"), F.col("payload")
    down = status == "OFFLINE"
    node = topics.level(topic, 4)
    relevant = messages.filter((topics.level_count(topic) >= 6) & status.isin("OFFLINE", "ONLINE"))
    # Fixed texts of the alerts.
    lost, back = ("🚨 CRITICAL: ", " has dropped off the network."), ("✅ RECOVERY: ", " is back online.")
    return relevant.select(
        "msg_id",
        node.alias("node_id"),
        status.alias("status"),
        F.when(down, F.concat(F.lit(lost[0]), node, F.lit(lost[1])))
        .otherwise(F.concat(F.lit(back[0]), node, F.lit(back[1])))
        .alias("message"),
        F.lit(title).alias("title"),
        F.when(down, "warning,skull").otherwise("white_check_mark").alias("tags"),
        F.when(down, "high").alias("priority"),
        "received_at",
    )
