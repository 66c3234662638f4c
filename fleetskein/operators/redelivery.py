"""Removal of messages that the transport delivers again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fleetskein.functions import times


def first_deliveries(messages: DataFrame, within_seconds: int = 3600) -> DataFrame:
    """Messages without redeliveries: same topic and payload, at most ``within_seconds`` after the delivery before.

    A chain of deliveries counts once, as its earliest row (ties: smallest ``msg_id``); the same content after a longer pause
    is a message of its own. Contents meet by two 64-bit hashes, so that no payload is shuffled to be compared.
    Deliveries in one slot of that length belong to one chain, hence only the first and last time of a slot are ordered: a
    content that is sent all the time is reduced in the map tasks.
    """
    content = {"_h1": F.xxhash64("topic", "payload"), "_h2": F.xxhash64(F.lit(1), "payload", "topic")}
    keyed = messages.withColumns(content)
    key = ["_h1", "_h2"]
    slots = keyed.groupBy(*key, times.slot_of(F.col("received_at"), within_seconds).alias("_slot")).agg(
        F.min("received_at").alias("_first"), F.max("received_at").alias("_last")
    )
    before = F.lag("_last").over(Window.partitionBy(*key).orderBy("_slot"))
    pause = F.col("_first") - before > times.seconds(within_seconds)
    chains = slots.withColumn("_new", F.coalesce(pause, F.lit(True))).filter("_new").select(*key, F.col("_first").alias("received_at"))
    heads = keyed.join(chains, [*key, "received_at"], "left_semi").groupBy(*key, "received_at").agg(F.min("msg_id").alias("msg_id"))
    return keyed.join(heads, [*key, "received_at", "msg_id"], "left_semi").select(*messages.columns)
