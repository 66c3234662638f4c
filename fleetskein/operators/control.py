"""Control messages: validation, and replay of what each one did.

A start counts only when no accepted start of the same (node, runner) is still
active; an abort ends the active one. That rule is sequential, but an abort
always leaves the runner idle, and so does a moment after the end of every
earlier start. The log is cut at both, and each stretch, however long, is replayed
by following "next start that can be accepted" links, which double their reach
with every join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetskein.functions.times import bounded_seconds, seconds, slot_of
from fleetskein.functions.values import with_document
from fleetskein.session import discard, written

DEFAULT_DURATION = 60
ACTIONS = ("start", "abort")

_ENVELOPE = "struct<action variant, runner variant, params map<string,variant>>"
_KEY = ["node_id", "runner"]
OUTCOME_COLUMNS = ["msg_id", *_KEY, "received_at", "action", "outcome", "error"]
_STRETCH = [*_KEY, "calm", "aborts"]


def parse(messages: DataFrame) -> DataFrame:
    """Validated envelopes: ``action`` (empty means start), ``runner``, ``duration_sec``, ``error``."""
    e = F.col("_env.value")
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    text = lambda c: F.coalesce(F.when(kind(c) == "STRING", F.try_variant_get(c, "$", "string")), F.lit(""))
    readable = F.col("_env.ok") & kind(e["action"]).isin("STRING", "VOID") & kind(e["runner"]).isin("STRING", "VOID")
    action, runner = text(e["action"]), text(e["runner"])
    # Only a JSON number counts; it is held within the longest duration and cut to whole seconds.
    duration = e["params"]["duration_sec"]
    number = kind(duration).rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    duration_sec = F.when(number, bounded_seconds(F.try_variant_get(duration, "$", "double")).cast("bigint"))
    error = (
        F.when(~readable, "invalid envelope")
        .when(runner == "", "missing runner execution name")
        .when(~action.isin("", *ACTIONS), F.concat(F.lit("invalid action: "), action))
    )
    return with_document(messages, "payload", "_env", _ENVELOPE).select(
        "msg_id",
        "node_id",
        runner.alias("runner"),
        "received_at",
        F.coalesce(F.nullif(action, F.lit("")), F.lit("start")).alias("action"),
        F.coalesce(duration_sec, F.lit(DEFAULT_DURATION)).alias("duration_sec"),
        error.alias("error"),
    )


def replay(messages: DataFrame, known_runners: Iterable[str], slot_seconds: int = 3600) -> DataFrame:
    """Outcome of every control message, in order of (``received_at``, ``msg_id``) per node and runner.

    ``started``, ``duplicate_ignored``, ``aborted``, ``abort_ignored``,
    ``unknown_runner`` or ``invalid``.
    """
    return replay_from(messages, known_runners, None, slot_seconds).select(*OUTCOME_COLUMNS)


def replay_from(
    messages: DataFrame,
    known_runners: Iterable[str],
    open_before: DataFrame | None,
    slot_seconds: int = 3600,
) -> DataFrame:
    """Replay after runs that were open before (``node_id, runner, ends_at``).

    These take part as starts before all messages; they are marked ``carried`` in the result.
    """
    parsed = written(parse(messages), "control-parsed")
    known = F.col("runner").isin(*known_runners)
    abort = F.col("action") == "abort"
    bad = F.col("error").isNotNull()
    end = F.col("received_at") + seconds(F.col("duration_sec"))
    settled = parsed.withColumns({
        "outcome": F.when(bad, "invalid").when(~known & abort, "abort_ignored").when(~known, "unknown_runner"),
        "ends_at": F.when(F.col("action") == "start", end),
        "carried": F.lit(False),
    })
    simple = settled.filter(F.col("outcome").isNotNull())
    active = settled.filter(F.col("outcome").isNull())
    if open_before is not None:
        first = F.lit("1970-01-01 00:00:00").cast(parsed.schema["received_at"].dataType)
        active = active.unionByName(open_before.select(
            *_KEY, "ends_at", F.lit(-1).cast("bigint").alias("msg_id"), first.alias("received_at"),
            F.lit("start").alias("action"), F.lit(True).alias("carried"),
        ), allowMissingColumns=True)
    columns = [*OUTCOME_COLUMNS, "ends_at", "carried"]
    return simple.select(*columns).unionByName(replay_known(active, slot_seconds).select(*columns))


def open_runs(outcomes: DataFrame) -> DataFrame:
    """Runs still held open after a replay: per node and runner the last start, unless an abort followed."""
    last = (
        outcomes.filter(F.col("outcome").isin("started", "aborted"))
        .groupBy(*_KEY)
        .agg(F.max_by(F.struct("outcome", "ends_at"), F.struct("received_at", "msg_id")).alias("last"))
    )
    return last.filter(F.col("last.outcome") == "started").select(*_KEY, "last.ends_at")


def replay_known(valid: DataFrame, slot_seconds: int = 3600) -> DataFrame:
    """Replay valid messages of known runners (starts with their ``ends_at``)."""
    return _linked(written(_stretches(valid, slot_seconds), "control-stretches"), slot_seconds)


def _stretches(rows: DataFrame, slot_seconds: int) -> DataFrame:
    """Number the stretches: ``aborts`` counts aborts before the row, ``calm`` the idle slot starts.

    Counts run within a (node, runner, slot) first; only one summary row per slot
    is then ordered per node and runner.
    """
    is_abort = (F.col("action") == "abort").cast("long")
    slotted = rows.withColumn("slot", slot_of(F.col("received_at"), slot_seconds))
    per_slot = slotted.groupBy(*_KEY, "slot").agg(
        F.sum(is_abort).alias("slot_aborts"),
        F.max("ends_at").alias("slot_end"),
    )
    earlier = Window.partitionBy(*_KEY).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*_KEY).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    last_end = F.unix_micros(F.max("slot_end").over(earlier).cast("timestamp"))
    idle = F.coalesce(last_end <= F.col("slot"), F.lit(True)).cast("long")
    carried = (
        per_slot.withColumn("idle", idle)
        .withColumn("calm", F.sum("idle").over(upto))
        .withColumn("aborts_before", F.coalesce(F.sum("slot_aborts").over(earlier), F.lit(0)))
        .select(*_KEY, "slot", "calm", "aborts_before")
    )
    in_slot = (
        Window.partitionBy(*_KEY, "slot")
        .orderBy("received_at", "msg_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = slotted.withColumn("aborts_in_slot", F.coalesce(F.sum(is_abort).over(in_slot), F.lit(0)))
    return (
        counted.join(carried, [*_KEY, "slot"])
        .withColumn("aborts", F.col("aborts_before") + F.col("aborts_in_slot"))
        .drop("aborts_before", "aborts_in_slot", "slot")
    )


def _linked(rows: DataFrame, slot_seconds: int) -> DataFrame:
    """Replay the stretches: mark the starts on the chain of accepted ones, beginning with the first."""
    this = [*_KEY, "msg_id"]
    starts = rows.filter(F.col("action") == "start")
    links = written(_next_possible(starts, slot_seconds), "control-links")
    reached = written(
        starts.groupBy(*_STRETCH)
        .agg(F.min_by("msg_id", F.struct("received_at", "msg_id")).alias("msg_id"))
        .select(*this),
        "control-reached",
    )
    while not links.isEmpty():
        further = reached.join(links, this).select(*_KEY, F.col("next_id").alias("msg_id"))
        before = (reached, links)
        reached = written(reached.union(further).distinct(), "control-reached")
        hop = links.select(*_KEY, F.col("msg_id").alias("next_id"), F.col("next_id").alias("far_id"))
        doubled = links.join(hop, [*_KEY, "next_id"]).select(*this, F.col("far_id").alias("next_id"))
        links = written(doubled, "control-links")
        discard(*before)
    discard(links)

    # A stretch ends with its abort, if it has one: the run of the last accepted start is what it meets.
    last_until = starts.join(reached, this, "left_semi").groupBy(*_STRETCH).agg(
        F.max_by("ends_at", F.struct("received_at", "msg_id")).alias("until")
    )
    aborts = rows.filter(F.col("action") == "abort").join(last_until, _STRETCH, "left").withColumn(
        "outcome", F.when(F.col("received_at") < F.col("until"), "aborted").otherwise("abort_ignored")
    )
    marked = starts.join(reached.withColumn("hit", F.lit(True)), this, "left").withColumn(
        "outcome", F.when(F.col("hit"), "started").otherwise("duplicate_ignored")
    )
    columns = [*OUTCOME_COLUMNS, "ends_at", "carried"]
    return marked.select(*columns).unionByName(aborts.select(*columns))


def _next_possible(starts: DataFrame, slot_seconds: int) -> DataFrame:
    """``(node, runner, msg_id) -> next_id``: the first later start of the stretch at or after the end of this one's run.

    Every start is entered twice, at its own time and, as a question, at its end.
    Within a slot a window answers; what stays open takes the first start of the
    next slot that has any.
    """
    key = [*_STRETCH, "slot"]
    time = F.col("received_at")
    runs_on = F.col("ends_at") > time
    as_start = starts.select(
        *_STRETCH, time.alias("at"), F.col("msg_id").alias("tie"), F.lit(0).alias("asks"), "msg_id"
    )
    # An empty run asks from right behind itself.
    as_question = starts.select(
        *_STRETCH,
        F.when(runs_on, F.col("ends_at")).otherwise(time).alias("at"),
        F.when(runs_on, F.lit(-(2**63))).otherwise(F.col("msg_id")).alias("tie"),
        F.lit(1).alias("asks"),
        "msg_id",
    )
    both = as_start.unionByName(as_question).withColumn("slot", slot_of(F.col("at"), slot_seconds))
    start_id = F.when(F.col("asks") == 0, F.col("msg_id"))
    following = Window.partitionBy(*key).orderBy("at", "tie", "asks").rowsBetween(1, Window.unboundedFollowing)
    asked = both.withColumn("next_id", F.first(start_id, ignorenulls=True).over(following)).filter(
        F.col("asks") == 1
    )
    firsts = both.groupBy(*key).agg(F.min_by(start_id, F.when(F.col("asks") == 0, F.struct("at", "tie"))).alias("first_id"))
    later = Window.partitionBy(*_STRETCH).orderBy("slot").rowsBetween(1, Window.unboundedFollowing)
    later_first = firsts.withColumn("later_id", F.first("first_id", ignorenulls=True).over(later)).drop("first_id")
    return (
        asked.join(later_first, key)
        .select(*_KEY, "msg_id", F.coalesce("next_id", "later_id").alias("next_id"))
        .filter(F.col("next_id").isNotNull())
    )
