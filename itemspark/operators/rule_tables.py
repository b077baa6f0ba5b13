"""Keyword rules held in a table: thousands of patterns found in texts without a pass per pattern.

``classify`` expands rules into the plan, which suits a few dozen. Here the patterns are rows. From each pattern a
literal that every match must contain is derived, and one n-gram of that literal is posted in an inverted table of
``BUCKETS`` lists. The table reaches the tasks as one value (a scalar subquery), so a text is matched where it is
read: the distinct n-grams of its distinct words name candidate patterns, and a candidate is verified within the
text's row, first by its literal, then by the pattern held in the row. Texts are neither joined nor shuffled; only matches (key and rule)
leave the scan. The plan does not depend on the number of patterns, except that a table above ``SHARD`` patterns is
dealt into several such values. Patterns without a literal of n characters are tried on every text.

Case is folded for candidates only (so that every match under case-insensitive rules stays one); whether case counts
is decided by ``flags`` in front of each pattern. Null texts match nothing, null patterns are left out, equal
patterns of one rule count once; a pattern Java cannot compile fails the query. ``key`` names a row: rows that share
one are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.operators.classify import Rule, resolve
from itemspark.operators.stages import stage

GRAM, BUCKETS, SHARD = 3, 1 << 14, 20_000
#: The longer n-gram, taken where at most ``FEW`` patterns have a literal too short for it.
LONG, FEW = 5, 64
IGNORE_CASE, CASE = "(?iU)", "(?U)"


def rule_rows(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """A rule list as a table: one row per pattern (rule_id, area, subtopic, weight, pattern)."""
    rows = [(i, r.area, r.subtopic, r.weight, p) for i, r in enumerate(rules) for p in r.patterns]
    return spark.createDataFrame(rows, "rule_id int, area string, subtopic string, weight int, pattern string")


def folded(text: Column) -> Column:
    """Characters that match each other regardless of case become equal."""
    return F.replace(F.lower(F.upper(F.lower(text))), F.lit("i̇"), F.lit("i"))


def mandatory_literal(pattern: Column) -> Column:
    """The longest run of characters that every match of the pattern contains; empty where none is evident.

    Groups and alternatives are not looked into. Escapes, classes, wildcards, anchors and quantified characters end
    a run; what a quantifier makes optional is no part of one.
    """
    gap = "\u0001"
    runs = F.regexp_replace(pattern, r"\\(x\{[^}]*\}|x..|u....|c.|0[0-7]{1,3}|[pPN]\{[^}]*\}|[pP].|k<[^>]*>|[0-9]+|[\s\S])", gap)
    runs = F.regexp_replace(runs, r"\[\^?\]?[^\]]*\]", gap)
    runs = F.regexp_replace(runs, r"[\s\S](\?|\*|\{[^}]*\})[?+]?", gap)
    runs = F.regexp_replace(runs, r"[.^$+]", gap)
    longest = F.array_max(F.transform(F.split(folded(runs), gap), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return F.when(pattern.rlike(r"[|()]|\[[^\]]*\[|&&|\\Q"), "").otherwise(longest)


def grams(text: Column, n: int = GRAM) -> Column:
    """All n-grams without a blank of a text, in one pass."""
    return F.regexp_extract_all(text, F.lit(rf"(?=(\S{{{n}}}))"), 1)


def vocabulary(text: Column) -> Column:
    """The distinct words of a text, a blank apart: it holds what has no blank in it exactly where the text does."""
    return F.array_join(F.array_distinct(F.split(text, r"\s+")), " ")


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _numbered(patterns: DataFrame, n: int = GRAM) -> DataFrame:
    """Patterns with a place, their literal and the bucket of the literal's gram that fewest literals share."""
    rows = patterns.where("pattern IS NOT NULL").distinct().withColumn("literal", mandatory_literal(F.col("pattern")))
    # The rule table is small beside the texts: one task numbers it.
    rows = rows.withColumn("at", F.row_number().over(Window.orderBy(*sorted(patterns.columns))) - 1)
    own = rows.select("at", F.explode(F.array_distinct(grams(F.col("literal"), n))).alias("gram"))
    shared = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = own.join(shared, "gram").groupBy("at").agg(F.min_by(bucket(F.col("gram")), F.struct("n", "gram")).alias("bucket"))
    return rows.join(best, "at", "left")


def _index(numbered: DataFrame) -> Column:
    """By bucket, the places of the patterns posted there; the last list holds those without a bucket."""
    posted = numbered.groupBy(F.coalesce("bucket", F.lit(BUCKETS)).alias("bucket")).agg(F.sort_array(F.collect_list("at")).alias("own"))
    every = numbered.sparkSession.range(BUCKETS + 1).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(posted, "bucket", "left").select("bucket", F.coalesce("own", F.array().cast("array<int>")).alias("own"))
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "own"))), lambda x: x["own"]).alias("index")).scalar()


def matches(docs: DataFrame, key: Sequence[str], text: Column, patterns: DataFrame, flags: str = IGNORE_CASE, shard: int = SHARD) -> DataFrame:
    """One row per text and pattern found in it: the key and the pattern's columns (``pattern`` and any others)."""
    kept = [c for c in patterns.columns if c not in key]
    size = F.length(mandatory_literal(F.col("pattern")))
    count, short = patterns.where("pattern IS NOT NULL").agg(F.count(F.lit(1)), F.count_if((size >= GRAM) & (size < LONG))).first()
    many, n = max(1, -(-count // shard)), LONG if short <= FEW else GRAM
    parts = [patterns.select(*kept) if many == 1 else patterns.select(*kept).where(F.pmod(F.xxhash64("pattern"), F.lit(many)) == s) for s in range(many)]
    rows = stage(docs, {"_fold": folded(text), "_text": text}, keep=list(key))
    rows = stage(rows, {"_words": vocabulary(F.col("_fold"))})
    every = F.array(F.lit(BUCKETS))
    rows = stage(rows, {"_buckets": F.concat(every, F.array_distinct(F.transform(F.array_distinct(grams(F.col("_words"), n)), bucket)))})
    # A plain pattern found in the lower-cased text needs no regular expression (compiled anew for every candidate).
    plain = F.col("pattern").rlike(r"\A[A-Za-z0-9_ ]+\z") if flags in (IGNORE_CASE, CASE) else F.lit(False)
    found_plain = F.when(plain, F.lower("pattern") if flags == IGNORE_CASE else F.col("pattern"))
    rows = stage(rows, {"_search": F.lower("_text") if flags == IGNORE_CASE else F.col("_text")})
    out = None
    for part in parts:
        numbered = _numbered(part, n)
        entry = F.struct("literal", F.col("literal").rlike(r"\s").alias("blank"), found_plain.alias("plain"), F.struct(*kept).alias("row"))
        table = numbered.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", entry.alias("e")))), lambda x: x["e"]).alias("t")).scalar()
        # Candidates are verified within the text's row: a row per candidate would carry the text along.
        found = rows.withColumns({"_index": _index(numbered), "_table": table})
        candidates = F.flatten(F.transform("_buckets", lambda b: F.get("_index", b)))
        verified = F.filter(F.transform(candidates, lambda at: F.get("_table", at)), lambda e: F.contains(F.when(e["blank"], F.col("_fold")).otherwise(F.col("_words")), e["literal"]) & (
            F.coalesce(F.contains("_search", e["plain"]), F.lit(False)) | F.rlike("_text", F.concat(F.lit(flags), e["row"]["pattern"]))))
        found = stage(found, {"_rows": F.transform(verified, lambda e: e["row"])}, keep=list(key)).select(*key, F.explode("_rows").alias("_row")).select(*key, "_row.*")
        out = found if out is None else out.unionByName(found)
    return out


def score(docs: DataFrame, key: Sequence[str], text: Column, rules: DataFrame) -> DataFrame:
    """Per key and area with a hit: score, first_rule, subtopic, as ``classify.score`` ranks them.

    ``rules``: (rule_id, area, subtopic, weight, pattern), one row per pattern.
    """
    hits = matches(docs, key, text, rules.select("rule_id", "area", "subtopic", "weight", "pattern"))
    points = hits.groupBy(*key, "area", "rule_id", "subtopic").agg(F.sum("weight").cast("int").alias("points"))
    best = F.max_by("subtopic", F.struct("points", -F.col("rule_id")))
    return points.groupBy(*key, "area").agg(F.sum("points").cast("int").alias("score"), F.min("rule_id").alias("first_rule"), best.alias("subtopic")).where("score > 0")


def classify(docs: DataFrame, key: Sequence[str], text: Column, rules: DataFrame, min_score: int = k.MIN_SCORE, min_margin: int = k.MIN_MARGIN) -> DataFrame:
    """Per row the key and what ``classify.classify`` adds; only keys of rows without a hit are read again."""
    entry = F.struct((-F.col("score")).alias("neg"), "first_rule", "area", "subtopic", "score")
    ranked = score(docs, key, text, rules).groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("ranked"))
    return resolve(docs.select(*key).join(ranked, list(key), "left"), min_score, min_margin)


def notes(docs: DataFrame, key: Sequence[str], text: Column, terms: DataFrame) -> DataFrame:
    """Per row the key and ``notes``: the distinct notes of the case-sensitive terms its text holds, first place first.

    ``terms``: (place, pattern, note).
    """
    hits = matches(docs, key, text, terms.select("place", "pattern", "note"), flags=CASE).groupBy(*key, "note").agg(F.min("place").alias("place"))
    found = hits.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "note"))), lambda h: h["note"]).alias("notes"))
    return docs.select(*key).join(found, list(key), "left").select(*key, F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))
