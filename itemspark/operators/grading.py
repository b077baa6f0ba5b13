"""Grading expressions: exact sets, fuzzy slots, option outcomes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemspark.functions import items as it
from itemspark.operators.stages import stage


def _latin_table() -> tuple[str, str]:
    """Lower-case Latin letters whose compatibility decomposition is one ASCII letter plus marks."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if ch == ch.lower() and len(base) == 1 and base.isascii() and base.isalnum():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _latin_table()


@F.pandas_udf(T.StringType())
def _decompose(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKD")


def normalise(text: Column, exact: bool = False) -> Column:
    """Lower case, accents and apostrophes off, every other run of non-alphanumerics to one blank.

    The default folds Latin letters with a translate table and stays in the JVM; ``exact`` decomposes all
    of Unicode in Arrow batches.
    """
    low = F.lower(text)
    low = _decompose(low) if exact else F.translate(low, ACCENTED, PLAIN)
    low = F.regexp_replace(low, "[̀-ͯ’']", "")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def normalised_match(given: Column, expected: Column) -> Column:
    """Equal, or within one slip per eight characters of the longer side; blanks never match."""
    allowed = F.floor(F.greatest(F.length(given), F.length(expected)) / 8)
    near = (F.abs(F.length(given) - F.length(expected)) <= allowed) & (F.levenshtein(given, expected) <= allowed)
    return F.coalesce(
        F.when((given == "") | (expected == ""), False).when(given == expected, True).otherwise(F.when(allowed > 0, near).otherwise(False)),
        F.lit(False))


def answers_match(given: Column, expected: Column, exact: bool = False) -> Column:
    return normalised_match(normalise(given, exact), normalise(expected, exact))


def same_set(a: Column, b: Column) -> Column:
    """All-or-nothing: equal as upper-cased multisets."""
    up = lambda xs: F.array_sort(F.transform(xs, F.upper))
    return F.coalesce(up(a) == up(b), F.lit(False))


def grade_slots(values: Column, boxes: Column, exact: bool = False) -> Column:
    """One verdict per slot; a missing response is wrong. Each side is normalised once."""
    pairs = F.transform(boxes, lambda b, i: F.struct(
        normalise(F.coalesce(F.get(values, i), F.lit("")), exact).alias("g"), normalise(b["answer"], exact).alias("e")))
    return F.transform(pairs, lambda p: normalised_match(p["g"], p["e"]))


def with_grade(rows: DataFrame, name: str = "grade") -> DataFrame:
    """Grade responses (kind, keys, box_values, verdict) joined to their items.

    Adds struct(correct, per_box, self_graded, ungradeable). A kind that does not fit the item falls
    through to self-judgement and is right only if the learner said so.
    """
    c = F.col
    out = stage(rows, {"_expected": it.response_kind()})
    boxes = (c("_expected") == "boxes") & (c("kind") == "boxes")
    out = stage(out, {"_slots": F.when(boxes, grade_slots(c("box_values"), c("boxes")))})
    choice, dead = (c("_expected") == "choice") & (c("kind") == "choice"), it.is_dead_end()
    correct = (
        F.when(dead, False).when(choice, same_set(c("keys"), c("correct")))
        .when(boxes, (F.size("_slots") > 0) & F.forall("_slots", lambda x: x))
        .otherwise(F.coalesce((c("kind") == "self") & (c("verdict") == "correct"), F.lit(False)))
    )
    return out.select(*rows.columns, F.struct(
        correct.alias("correct"), F.when(~dead, c("_slots")).alias("per_box"), (dead | ~(choice | boxes)).alias("self_graded"),
        dead.alias("ungradeable")).alias(name))


def option_outcome(key: Column, correct: Column, chosen: Column) -> Column:
    k = F.upper(key)
    has = lambda xs: F.coalesce(F.array_contains(F.transform(xs, F.upper), k), F.lit(False))
    right, picked = has(correct), has(chosen)
    return F.when(picked & right, "chosen-correct").when(picked, "chosen-wrong").when(right, "missed").otherwise("neutral")
