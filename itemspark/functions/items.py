"""Predicates and derived columns over item rows (options, correct, boxes, images, explanation, ...)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemspark.functions.text import orphaned_letters, strip

c = F.col


def empty(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) <= 0


def blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def is_choice() -> Column:
    return c("type").isin("mcq-single", "mcq-multi")


def is_visual() -> Column:
    return c("type").isin("hotspot", "dragdrop")


def is_dead_end() -> Column:
    """Nothing to answer with and nothing to reveal."""
    return empty(c("options")) & empty(c("images")) & empty(c("boxes")) & blank(c("explanation"))


def is_usable() -> Column:
    return ~is_dead_end()


def is_gradable() -> Column:
    return is_usable() & ~c("self_graded")


def missing_letters() -> Column:
    return orphaned_letters(c("correct"), c("options"))


def broken_key() -> Column:
    return ~empty(c("options")) & ~empty(c("correct")) & (F.size(missing_letters()) > 0)


def response_kind() -> Column:
    return (
        F.when(c("self_graded") | is_dead_end(), "self")
        .when(~empty(c("options")) & ~empty(c("correct")), "choice")
        .when(~empty(c("boxes")), "boxes").otherwise("self")
    )


def self_graded() -> Column:
    return (is_visual() & empty(c("boxes"))) | (is_choice() & empty(c("options")) & empty(c("correct")))


def is_flagged() -> Column:
    return (c("currency") != "current") | (c("parse_confidence") == "low")


def box_suggestions() -> Column:
    return F.array_distinct(F.filter(F.transform(c("boxes"), lambda b: strip(b["answer"])), lambda x: x != ""))


def is_answered() -> Column:
    """A response row (kind, keys, box_values, verdict) holds enough to submit."""
    return (
        F.when(c("kind") == "choice", ~empty(c("keys")))
        .when(c("kind") == "boxes", F.coalesce(F.exists(c("box_values"), lambda v: ~blank(v)), F.lit(False)))
        .otherwise(c("verdict").isNotNull())
    )
