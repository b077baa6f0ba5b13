"""Weighted keyword rules: scoring, margin, overrides, defaults, distributions.

Rules are configuration. They are expanded to literal expressions, so a document is scored where it is
read: no join with a rule table, no shuffle, and every pattern is compiled once per task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.operators.stages import stage


@dataclass(frozen=True)
class Rule:
    area: str
    subtopic: str
    weight: int
    patterns: tuple[str, ...]


def scoring_text(stem: Column, options: Column, explanation: Column, refs: Column) -> Column:
    c = lambda x: F.coalesce(x, F.lit(""))
    return F.concat(c(stem), F.lit(" "), c(F.array_join(F.transform(options, lambda o: o["text"]), " ")), F.lit(" "),
                    c(explanation), F.lit(" "), c(F.array_join(refs, " ")))


def latin_fold(low: Column) -> Column:
    """Lower-cased text in which all that matches a letter of ``PLAIN``, case ignored, is that letter."""
    for other, letter in (("i\u0307", "i"), ("\u0131", "i"), ("\u017f", "s")):
        low = F.replace(low, F.lit(other), F.lit(letter))
    return low


#: Words of Latin letters whose case is folded character by character, within word boundaries or not.
PLAIN = re.compile(r"(\\b)?([0-9A-Za-zÀ-ÖØ-Þà-öø-þ](?:[0-9A-Za-zÀ-ÖØ-Þà-öø-þ ]*[0-9A-Za-zÀ-ÖØ-Þà-öø-þ])?)(\\b)?")


def found(pattern: str, text: Column, low: Column, fold: Column) -> Column:
    """``text.rlike`` of the pattern, case ignored. ``low`` is the text in lower case, ``fold`` the folded text.

    Plain words are looked for as substrings: what the lower-cased text holds (between blanks where boundaries are
    asked for) matches, what the folded text does not hold, or holds only beside a letter or digit, cannot; the
    regular expression, which looks for a boundary at every character, decides what is left.
    """
    match = text.rlike(f"(?iU){pattern}")
    plain = PLAIN.fullmatch(pattern)
    if not plain:
        return match
    before, word, after = plain.groups()
    word = word.lower()
    maybe = fold.contains(word)
    if before or after:
        maybe &= fold.rlike(word + (f"(?<![0-9a-z_]{word})" if before else "") + ("(?![0-9a-z_])" if after else ""))
    return low.contains((" " if before else "") + word + (" " if after else "")) | (maybe & match)


def score(docs: DataFrame, text: Column, rules: Sequence[Rule]) -> DataFrame:
    """Add ``ranked``: per area with a hit, (score, first_rule, area, subtopic), best first.

    A pattern counts once however often it occurs; a rule's points are distinct hits times its weight.
    Equal scores rank by the first rule that hit; within an area the first best rule names the subtopic.
    """
    hit = lambda p: found(p, F.col("_scored"), F.col("_low"), F.col("_fold")).cast("int")
    hits = [sum((hit(p) for p in r.patterns[1:]), hit(r.patterns[0])) for r in rules]
    rows = stage(docs, {"_scored": text})
    rows = stage(rows, {"_low": F.lower("_scored")})
    rows = stage(rows, {"_fold": latin_fold(F.col("_low"))})
    rows = stage(rows, {"_points": F.array(*[h * F.lit(r.weight) for h, r in zip(hits, rules)])})
    areas = list(dict.fromkeys(r.area for r in rules))
    entries = []
    for area in areas:
        own = [(i, r) for i, r in enumerate(rules) if r.area == area]
        points = lambda i: F.get("_points", F.lit(i))
        total = sum((points(i) for i, _ in own[1:]), points(own[0][0]))
        first = F.least(*[F.when(points(i) > 0, F.lit(i)) for i, _ in own], F.lit(len(rules)))
        best = F.array_max(F.array(*[F.struct(points(i).alias("p"), F.lit(-i).alias("r"), F.lit(r.subtopic).alias("s")) for i, r in own]))
        entries.append(F.struct((-total).alias("neg"), first.alias("first_rule"), F.lit(area).alias("area"), best["s"].alias("subtopic"), total.alias("score")))
    ranked = F.array_sort(F.filter(F.array(*entries), lambda e: e["score"] > 0))
    return stage(rows, {"ranked": ranked}, keep=docs.columns)


def classify(docs: DataFrame, text: Column, rules: Sequence[Rule], min_score: int = k.MIN_SCORE,
             min_margin: int = k.MIN_MARGIN) -> DataFrame:
    """Add rule_area (null when unresolved), rule_subtopic, top_score, runner_up."""
    return resolve(score(docs, text, rules), min_score, min_margin)


def resolve(rows: DataFrame, min_score: int = k.MIN_SCORE, min_margin: int = k.MIN_MARGIN) -> DataFrame:
    """The verdict of rows that have ``ranked``."""
    top, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    rows = rows.withColumns({
        "top_score": F.coalesce(top["score"], F.lit(0)), "runner_up": F.coalesce(second["score"], F.lit(0)),
        "rule_subtopic": F.coalesce(top["subtopic"], F.lit("")),
    })
    sure = (F.col("top_score") >= min_score) & (F.col("top_score") - F.col("runner_up") >= min_margin)
    return rows.withColumn("rule_area", F.when(sure, top["area"]))


def assign(classified: DataFrame, overrides: DataFrame, default_area: str, key: str = "id") -> DataFrame:
    """Rules, else the override table (key, area, subtopic), else the default; ``origin`` says which."""
    o = overrides.select(key, F.col("area").alias("_oa"), F.col("subtopic").alias("_os"))
    rows = classified.join(o, key, "left")
    by_rule, by_override = F.col("rule_area").isNotNull(), F.col("_oa").isNotNull()
    own = F.col("rule_subtopic")
    subtopic = F.when(by_rule, own).when(by_override, F.coalesce("_os", own)).otherwise(F.when(own != "", own).otherwise("unclassified"))
    return rows.withColumns({
        "area": F.coalesce("rule_area", "_oa", F.lit(default_area)),
        "origin": F.when(by_rule, "rules").when(by_override, "override").otherwise("default"),
        "subtopic": F.when(subtopic == "", "general").otherwise(subtopic),
    }).drop("_oa", "_os")


def review_queue(classified: DataFrame, text: str, key: str = "id", chars: int = k.REVIEW_CHARS) -> DataFrame:
    """Unresolved rows: opening characters and the three best scores."""
    top = F.transform(F.slice("ranked", 1, 3), lambda e: F.concat(e["area"], F.lit("="), e["score"].cast("string")))
    return classified.filter(F.col("rule_area").isNull()).select(key, F.substring(text, 1, chars).alias("opening"), F.array_join(top, " ").alias("top_scores"))


def distribution(rows: DataFrame, strata: DataFrame, area: str = "area") -> DataFrame:
    """Share of each stratum against its target band."""
    counts = rows.groupBy(F.col(area).alias("area")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)))
    counts = counts.withColumn("percent", F.lit(100.0) * F.col("n") / total.scalar())
    out = strata.join(counts, "area", "left").withColumns({"n": F.coalesce("n", F.lit(0).cast("bigint")), "percent": F.coalesce("percent", F.lit(0.0))})
    return out.withColumn("off_band", ~F.col("percent").between(F.col("lo"), F.col("hi")))


def top_values(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(n)
