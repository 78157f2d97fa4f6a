"""Date and time column functions.  All of them take the reference time as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def timestamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def parse_posted_at(text: Column) -> Column:
    """Posting time from text: epoch seconds, epoch milliseconds (above 1e10) or ISO; null when unreadable."""
    number = text.try_cast("double")
    seconds = F.when(number > 10_000_000_000, number / 1000).otherwise(number)
    from_number = F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))
    return F.when(F.length(text) == 0, None).when(number.isNotNull(), from_number).otherwise(
        text.try_cast("timestamp"))


def age_days(now: Column, then: Column) -> Column:
    """Whole elapsed days, never negative (elapsed time, not calendar days)."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    # greatest() skips nulls, so an unknown time has to stay null explicitly.
    return F.when(then.isNotNull(), F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("int"))


def days_before(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))


def month_first(text: Column) -> Column:
    """``YYYY-MM`` to ``MM/YYYY``; other text unchanged."""
    return F.regexp_replace(text, r"^(\d{4})-(\d{2})$", "$2/$1")
