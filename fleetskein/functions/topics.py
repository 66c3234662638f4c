"""Hierarchical topic filters and topic text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def filter_regex(topic_filter: str) -> str:
    """Anchored regex for a topic filter: ``+`` is one level, a final ``#`` is the rest."""
    levels = topic_filter.split("/")
    if "#" in levels[:-1] or any(len(x) > 1 and ("#" in x or "+" in x) for x in levels):
        raise ValueError(f"bad topic filter: {topic_filter}")
    rest = levels[-1] == "#"
    fixed = levels[:-1] if rest else levels
    body = "/".join("[^/]*" if x == "+" else re.escape(x) for x in fixed)
    if rest:
        # `a/#` also matches the parent level `a` itself.
        body = body + "(/.*)?" if fixed else ".*"
    return f"^{body}$"


def matches(topic: Column, topic_filter: str) -> Column:
    return topic.rlike(filter_regex(topic_filter))


def level(topic: Column, position: int) -> Column:
    """Level by 0-based position, NULL beyond the end."""
    return F.get(F.split(topic, "/"), F.lit(position))


def level_count(topic: Column) -> Column:
    return F.size(F.split(topic, "/"))


def event_topic(prefix: str, pillar: Column, node: Column, component: Column) -> Column:
    """``prefix/pillar/node/component``. Empty parts stay, as empty levels."""
    return F.concat_ws("/", F.lit(prefix), *[F.coalesce(x, F.lit("")) for x in (pillar, node, component)])
