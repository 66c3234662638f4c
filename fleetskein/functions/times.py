"""Time slots, and text forms of times and durations as the command line prints them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Seconds in 100 years of 365 days: the longest duration a run can claim.
LONGEST = 3_153_600_000.0


def seconds(n: float | Column) -> Column:
    """A day-time interval of ``n`` seconds; fractions count."""
    zero = F.lit(0)
    secs = n if isinstance(n, Column) else F.lit(n)
    return F.make_dt_interval(zero, zero, zero, secs.cast("decimal(18,6)"))


def bounded_seconds(n: Column) -> Column:
    """A claimed duration, held within ``LONGEST`` either way, so that no value can leave the range of times."""
    return F.least(F.greatest(n, F.lit(-LONGEST)), F.lit(LONGEST))


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def slot_of(ts: Column, slot_seconds: int) -> Column:
    """Start of the time slot that holds ``ts``, in epoch microseconds."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return micros - F.pmod(micros, F.lit(slot_seconds * 1_000_000))


def minutes_ago(last_seen: Column, as_of: Column) -> Column:
    """Whole minutes as text, halves to even."""
    minutes = micros_between(last_seen, as_of) / F.lit(60_000_000.0)
    return F.bround(minutes, 0).cast("bigint").cast("string")


def elapsed(last_seen: Column, as_of: Column) -> Column:
    """Duration rounded to seconds, halves away from zero: ``45s``, ``1m0s``, ``1h0m5s``."""
    micros = micros_between(last_seen, as_of)
    total = F.round(F.abs(micros) / F.lit(1_000_000.0), 0).cast("bigint")
    hours = F.floor(total / 3600).cast("bigint")
    minutes = F.floor((total % 3600) / 60).cast("bigint")
    tail = F.concat((total % 60).cast("string"), F.lit("s"))
    with_minutes = F.concat(minutes.cast("string"), F.lit("m"), tail)
    body = (
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), with_minutes))
        .when(minutes > 0, with_minutes)
        .otherwise(tail)
    )
    return F.when((micros < 0) & (total > 0), F.concat(F.lit("-"), body)).otherwise(body)


def rfc3339(ts: Column) -> Column:
    """Whole seconds in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rfc3339_micros(ts: Column) -> Column:
    """Wire form: trailing zeros of the fraction are left out."""
    fraction = F.rtrim(F.date_format(ts, "SSSSSS"), F.lit("0"))
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def clock_millis(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS")


def reading_line(time_text: Column, component: Column, metrics: Column) -> Column:
    """``[time] component: metrics``"""
    return F.concat(F.lit("["), time_text, F.lit("] "), component, F.lit(": "), metrics)
