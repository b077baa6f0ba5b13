"""Small scalar expressions shared by reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_percent(part: Column, whole: Column) -> Column:
    """Integer percentage, 0 when there is nothing to divide by (half up)."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.round(part / whole * 100)).cast("int")


def percent_one_place(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, null when there is nothing to divide by."""
    return F.when(whole != 0, F.round(F.lit(100.0) * part / whole, 1))


def clock(ms: Column) -> Column:
    """Milliseconds as m:ss, rounded to seconds and floored at zero."""
    total = F.greatest(F.lit(0), F.round(ms / 1000)).cast("bigint")
    return F.format_string("%d:%02d", F.floor(total / 60), total % 60)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days between two timestamps of the same kind."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86_400_000_000.0)


def days_left(deadline: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(days_between(deadline, as_of))).cast("bigint")


def recency_words(at: Column, as_of: Column) -> Column:
    days = F.floor(days_between(as_of, at))
    return (
        F.when(at.isNull(), "never").when(days <= 0, "today").when(days == 1, "yesterday")
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )


def pacing_class(ms: Column, budget: int, risk: int) -> Column:
    return F.when(ms > risk, "risk").when(ms > budget, "over").otherwise("ok")


def rag(score: Column, green: float, amber: float) -> Column:
    return F.when(score >= green, "green").when(score >= amber, "amber").otherwise("red")
