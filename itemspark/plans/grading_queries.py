"""Predicates over items and graded responses, on the dump's items and on part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspark.operators import grading as g
from itemspark.functions import items as it
from itemspark.operators.stages import stage
from itemspark.operators.analytics import defect_counters as count_defects
from itemspark.plans import adapters as ad
from itemspark.plans.dump import CTE_ITEMS, dump_items
from itemspark.plans.extract_queries import LOW, NOTES

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


# Items lose their explanation where the number ends in 4, so that some become dead ends.
def patchy_items(spark, sf):
    items = dump_items(spark, sf, ["type", "options", "correct", "explanation", "boxes", "self_graded"])
    return items.withColumn("explanation", F.when(F.col("id") % 10 == 4, "  ").otherwise(F.col("explanation")))


CTE_PATCHY = f"""{CTE_ITEMS},
patchy AS (SELECT *, CASE WHEN n % 10 = 4 THEN '' ELSE explanation END AS ex2, NOT choice AND len(boxes) = 0 AS self_graded,
  NOT choice AND len(boxes) = 0 AND n % 10 = 4 AS dead, len(options) > 0 AND len(correct) > 0 AND len(list_filter(correct, lambda c: c NOT IN ('A', 'B', 'C'))) > 0 AS broken FROM items)"""
KIND = "CASE WHEN self_graded OR dead THEN 'self' WHEN len(options) > 0 AND len(correct) > 0 THEN 'choice' WHEN len(boxes) > 0 THEN 'boxes' ELSE 'self' END"


@register("item_predicates", f"""WITH {CTE_PATCHY} SELECT doc_id, id, dead, NOT dead AS usable, NOT dead AND NOT self_graded AS gradable, broken, {KIND} AS kind FROM patchy""")
def item_predicates(spark, sf):
    return patchy_items(spark, sf).select(
        "doc_id", "id", it.is_dead_end().alias("dead"), it.is_usable().alias("usable"), it.is_gradable().alias("gradable"),
        it.broken_key().alias("broken"), it.response_kind().alias("kind"))


@register("missing_letters", f"WITH {CTE_PATCHY} SELECT doc_id, id, 'D' AS letters FROM patchy WHERE broken")
def missing_letters(spark, sf):
    return patchy_items(spark, sf).filter(it.broken_key()).select("doc_id", "id", F.array_join(it.missing_letters(), "").alias("letters"))


@register("flagged_items", f"WITH {CTE_ITEMS} SELECT doc_id, id, n % 13 = 0 AS suspect, n % 13 = 0 OR ({LOW}) = 'low' AS flagged FROM (SELECT *, {NOTES} AS notes FROM items)")
def flagged_items(spark, sf):
    return dump_items(spark, sf, ["parse_confidence", "currency"]).select("doc_id", "id", (F.col("currency") != "current").alias("suspect"), it.is_flagged().alias("flagged"))


# Responses derived from each item: by its number, right, permuted, partial, slipped, blank or self-judged.
def responses(spark, sf):
    items = patchy_items(spark, sf)
    turn, real = F.col("id") % 5, it.response_kind()
    kind = F.when(F.col("id") % 17 == 0, "self").otherwise(real)
    lower_reversed = F.reverse(F.transform("correct", F.lower))
    keys = F.when(turn == 0, lower_reversed).when(turn == 1, F.slice("correct", 1, 1)).when(turn == 2, F.array().cast("array<string>")).otherwise(F.col("correct"))
    slip = lambda a: F.concat(F.lit("x"), a)
    answers = F.transform("boxes", lambda b: b["answer"])
    values = (F.when(turn == 0, F.transform(answers, lambda a: F.concat(F.lit(" - "), a, F.lit("!")))).when(turn == 1, F.slice(answers, 1, 1))
              .when(turn == 2, F.transform(answers, slip)).when(turn == 3, F.transform(answers, lambda a: F.lit(" "))).otherwise(answers))
    verdict = F.when(turn < 2, "correct").when(turn < 4, "wrong")
    return stage(items, {"kind": kind, "keys": keys, "box_values": values, "verdict": verdict})


CTE_RESPONSES = f"""{CTE_PATCHY},
resp AS (SELECT *, {KIND} AS real, CASE WHEN n % 17 = 0 THEN 'self' ELSE {KIND} END AS kind,
  CASE n % 5 WHEN 0 THEN list_reverse(list_transform(correct, lambda c: lower(c))) WHEN 1 THEN correct[1:1] WHEN 2 THEN [] ELSE correct END AS keys,
  list_transform(boxes, lambda b: b.answer) AS answers, CASE WHEN n % 5 < 2 THEN 'correct' WHEN n % 5 < 4 THEN 'wrong' END AS verdict FROM patchy),
norm AS (SELECT *, list_transform(answers, lambda a: trim(regexp_replace(strip_accents(lower(a)), '[^a-z0-9]+', ' ', 'g'))) AS na,
  list_transform(answers, lambda a: trim(regexp_replace(strip_accents(lower('x' || a)), '[^a-z0-9]+', ' ', 'g'))) AS nx FROM resp),
slots AS (SELECT *, CASE n % 5 WHEN 1 THEN list_transform(answers, lambda a, i: i = 1) WHEN 3 THEN list_transform(answers, lambda a: false)
  WHEN 2 THEN list_transform(list_zip(na, nx), lambda z: floor(greatest(length(z[1]), length(z[2])) / 8) > 0) ELSE list_transform(answers, lambda a: true) END AS per_box FROM norm)"""


@register("graded_responses", f"""WITH {CTE_RESPONSES} SELECT doc_id, id, kind,
  CASE WHEN dead THEN false WHEN real = 'choice' AND kind = 'choice' THEN list_sort(list_transform(keys, lambda k: upper(k))) = correct
       WHEN real = 'boxes' AND kind = 'boxes' THEN len(list_filter(per_box, lambda x: NOT x)) = 0
       ELSE coalesce(kind = 'self' AND verdict = 'correct', false) END AS correct,
  CASE WHEN NOT dead AND real = 'boxes' AND kind = 'boxes' THEN array_to_string(list_transform(per_box, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') END AS per_box,
  dead OR NOT ((real = 'choice' AND kind = 'choice') OR (real = 'boxes' AND kind = 'boxes')) AS self_graded, dead AS ungradeable FROM slots""")
def graded_responses(spark, sf):
    rows = g.with_grade(responses(spark, sf), "g")
    per_box = F.array_join(F.transform("g.per_box", lambda x: F.when(x, "1").otherwise("0")), "")
    return rows.select("doc_id", "id", "kind", "g.correct", per_box.alias("per_box"), "g.self_graded", "g.ungradeable")


@register("answered_responses", f"""WITH {CTE_RESPONSES} SELECT doc_id, id, CASE kind WHEN 'choice' THEN len(keys) > 0
  WHEN 'boxes' THEN len(boxes) > 0 AND n % 5 <> 3 ELSE verdict IS NOT NULL END AS answered FROM resp""")
def answered_responses(spark, sf):
    return responses(spark, sf).select("doc_id", "id", it.is_answered().alias("answered"))


@register("option_outcomes", f"""WITH {CTE_RESPONSES} SELECT outcome, count(*) AS n FROM (
  SELECT CASE WHEN k IN (SELECT unnest(keys_up)) AND k IN (SELECT unnest(correct)) THEN 'chosen-correct' WHEN k IN (SELECT unnest(keys_up)) THEN 'chosen-wrong'
    WHEN k IN (SELECT unnest(correct)) THEN 'missed' ELSE 'neutral' END AS outcome
  FROM (SELECT correct, list_transform(keys, lambda x: upper(x)) AS keys_up, unnest(list_transform(options, lambda o: o.key)) AS k FROM resp WHERE real = 'choice')) GROUP BY 1""")
def option_outcomes(spark, sf):
    rows = responses(spark, sf).filter(it.response_kind() == "choice").select("correct", "keys", F.explode("options").alias("o"))
    return rows.groupBy(g.option_outcome(F.col("o.key"), F.col("correct"), F.col("keys")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@register("answer_suggestions", f"""WITH {CTE_ITEMS} SELECT doc_id, id, CASE WHEN len(boxes) = 0 THEN '' WHEN boxes[1].answer = boxes[2].answer THEN boxes[1].answer
  ELSE boxes[1].answer || '|' || boxes[2].answer END AS suggestions FROM items""")
def answer_suggestions(spark, sf):
    return dump_items(spark, sf, ["type", "options", "boxes"]).select("doc_id", "id", F.array_join(it.box_suggestions(), "|").alias("suggestions"))


NORMAL = "trim(regexp_replace(strip_accents(lower(replace(text, '''', ''))), '[^a-z0-9]+', ' ', 'g'))"


@register("normalised_texts", f"SELECT doc_id, md5({NORMAL}) AS text_md5 FROM documents")
def normalised_texts(spark, sf):
    return ad.documents(spark, sf).select("doc_id", F.md5(g.normalise(F.col("text"))).alias("text_md5"))


@register("normalised_texts_exact", ORACLES["normalised_texts"])
def normalised_texts_exact(spark, sf):
    return ad.documents(spark, sf).select("doc_id", F.md5(g.normalise(F.col("text"), exact=True)).alias("text_md5"))


@register("fuzzy_matches", """WITH p AS (SELECT p_partkey, p_name AS e, lower(CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'i', 'í') WHEN 2 THEN p_name || 'x' ELSE reverse(p_name) END) AS g FROM part),
n AS (SELECT p_partkey, trim(regexp_replace(strip_accents(g), '[^a-z0-9]+', ' ', 'g')) AS g, trim(regexp_replace(strip_accents(lower(e)), '[^a-z0-9]+', ' ', 'g')) AS e FROM p)
SELECT p_partkey, CASE WHEN g = '' OR e = '' THEN false WHEN g = e THEN true
  ELSE greatest(length(g), length(e)) >= 8 AND levenshtein(g, e) <= floor(greatest(length(g), length(e)) / 8) END AS ok FROM n""")
def fuzzy_matches(spark, sf):
    p, n = ad.table(spark, sf, "part"), F.col("p_name")
    turn = F.col("p_partkey") % 4
    given = F.when(turn == 0, F.upper(n)).when(turn == 1, F.replace(n, F.lit("i"), F.lit("í"))).when(turn == 2, F.concat(n, F.lit("x"))).otherwise(F.reverse(n))
    return p.select("p_partkey", g.answers_match(given, n).alias("ok"))


@register("defect_counters", f"""WITH {CTE_PATCHY} SELECT count(*) AS total, count(*) FILTER (self_graded) AS self_graded,
  count(*) FILTER (n % 13 = 0 AND n % 10 <> 4) AS not_current, count(*) FILTER (broken) AS broken_keys, count(*) FILTER (dead) AS dead_ends FROM patchy""")
def defect_counters(spark, sf):
    items = patchy_items(spark, sf)
    return count_defects(items.withColumn("currency", F.when(F.col("explanation").contains("Common Data Service"), "suspect").otherwise("current")))
