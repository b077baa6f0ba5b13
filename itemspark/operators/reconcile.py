"""Two parses of one source into one reconciled bank. One full outer join on the item id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.functions import items as it
from itemspark.functions.identity import content_hash
from itemspark.functions.text import BOXES_TYPE, OPTIONS_TYPE, key_list, legacy_notes, orphaned_letters
from itemspark.operators.stages import stage

RAW_FIELDS = {
    "type": "string", "stem": "string", "options": OPTIONS_TYPE, "correct": "array<string>", "explanation": "string",
    "refs": "array<string>", "boxes": BOXES_TYPE, "images": "array<string>", "pages": "array<int>", "background": "string",
    "parse_confidence": "string", "parse_notes": "array<string>",
}


def has_value(c: Column, dtype: str) -> Column:
    """Neither null nor empty."""
    size = F.size(c) if dtype.startswith("array") else F.length(c)
    return F.coalesce(size > 0, F.lit(False))


def prefer(first: Column, second: Column, dtype: str) -> Column:
    """The first value unless it is empty."""
    return F.when(has_value(first, dtype), first).otherwise(second)


def reconcile(a: DataFrame, b: DataFrame, on: Sequence[str] = ("id",), strict_hash: bool = False, note_bare_keys: bool = False) -> DataFrame:
    """Merge parse ``a`` (wins on text) with parse ``b`` (wins on media); conflicts of the key are recorded.

    With an empty stem the hash falls back to the id, as published; ``strict_hash`` hashes the empty stem.
    A key letter without its option is noted where there are options; ``note_bare_keys`` notes it also where
    there are none. Either lowers confidence.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        cols = [F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t) for n, t in RAW_FIELDS.items()]
        return df.select(*on, F.struct(*[c.alias(n) for c, n in zip(cols, RAW_FIELDS)]).alias(tag))

    rows = side(a, "a").join(side(b, "b"), list(on), "full_outer")
    both = lambda n: prefer(F.col(f"a.{n}"), F.col(f"b.{n}"), RAW_FIELDS[n])
    empty = lambda n: F.array().cast(RAW_FIELDS[n])
    key_a, key_b = F.col("a.correct"), F.col("b.correct")
    conflict = has_value(key_a, "array") & has_value(key_b, "array") & (key_a != key_b)
    letters = lambda c: F.array_join(c, "")
    dispute_note = F.concat(F.lit("answer key disagreement: A="), letters(key_a), F.lit(" B="), letters(key_b))

    rows = rows.select(
        *on,
        F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "merged").when(F.col("a").isNotNull(), "a").otherwise("b").alias("source"),
        F.coalesce("a.type", "b.type").alias("_type"),
        *[F.coalesce(both(n), F.lit("")).alias(n) for n in ("stem", "explanation")],
        *[F.coalesce(both(n), empty(n)).alias(n) for n in ("options", "refs", "boxes", "correct")],
        F.coalesce(prefer(F.col("b.images"), F.col("a.images"), "array"), empty("images")).alias("images"),
        F.coalesce("a.pages", empty("pages")).alias("pages"),
        both("background").alias("background"),
        F.when(conflict, F.struct(key_a.alias("a"), key_b.alias("b"))).alias("disagreement"),
        F.when(conflict, dispute_note).alias("_dispute"),
        F.when(F.col("a").isNotNull(), F.coalesce("a.parse_notes", empty("parse_notes")))
        .otherwise(F.coalesce("b.parse_notes", empty("parse_notes"))).alias("_notes"),
        (F.col("a").isNull() | F.coalesce(F.col("a.parse_confidence") == "low", F.lit(False))).alias("_a_low"),
    )
    choice = F.col("_type").startswith("mcq")
    rows = rows.withColumn("type", F.when(choice, F.when(F.size("correct") > 1, "mcq-multi").otherwise("mcq-single")).otherwise(F.col("_type")))
    rows = rows.withColumn("_orphans", orphaned_letters(F.col("correct"), F.col("options")))
    rows = stage(rows, {"_legacy": legacy_notes(F.concat_ws(" ", "stem", "explanation", F.array_join("refs", " ")))})
    no_option = F.when(F.size("options") > 0, F.lit(" has no matching option")).when(F.lit(note_bare_keys), F.lit(" without any option"))
    orphan_note = F.when(F.size("_orphans") > 0, F.concat(F.lit("answer key "), key_list(F.col("_orphans")), no_option))
    low = F.col("disagreement").isNotNull() | (F.size("_orphans") > 0) | F.col("_a_low") | (it.is_visual() & it.empty(F.col("boxes")))
    stem = F.col("stem") if strict_hash else F.when(F.col("stem") != "", F.col("stem")).otherwise(F.concat_ws(":", *on))
    extra = F.filter(F.array("_dispute", orphan_note), lambda x: x.isNotNull())
    return rows.withColumns({
        "self_graded": it.self_graded(),
        "currency_note": F.col("_legacy"),
        "currency": F.when(F.col("_legacy").isNull(), "current").otherwise("suspect"),
        "parse_confidence": F.when(low, "low").otherwise("high"),
        "parse_notes": F.array_distinct(F.concat("_notes", extra)),
        "content_hash": content_hash(F.col("type"), stem, F.col("options"), F.col("boxes"), F.col("images")),
    }).drop("_type", "_notes", "_dispute", "_a_low", "_orphans", "_legacy")


def agreement(a: DataFrame, b: DataFrame, on: Sequence[str] = ("id",), alarm: float = k.DISAGREEMENT_ALARM) -> DataFrame:
    """Key disagreements against both denominators: keyed in both, and present in both."""
    left = a.select(*on, F.col("correct").alias("_a"))
    right = b.select(*on, F.col("correct").alias("_b"))
    rows = left.join(right, list(on))
    keyed = has_value(F.col("_a"), "array") & has_value(F.col("_b"), "array")
    out = rows.agg(F.count(F.lit(1)).alias("present_in_both"), F.count_if(keyed).alias("keyed_in_both"),
                   F.count_if(keyed & (F.col("_a") != F.col("_b"))).alias("disputed"))
    rate = lambda d: F.coalesce(F.try_divide(F.col("disputed"), F.col(d)), F.lit(0.0))
    return out.withColumns({
        "rate_keyed": rate("keyed_in_both"), "alarm_keyed": rate("keyed_in_both") > alarm,
        "rate_present": rate("present_in_both"), "alarm_present": rate("present_in_both") > alarm,
    })
