"""Keyword classification of ``documents`` by language rules, legacy terms, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.functions import text as t
from itemspark.operators import classify as cl
from itemspark.operators import rule_tables as rt
from itemspark.operators.selection import strata_frame
from itemspark.plans import adapters as ad
from itemspark.plans.dump import CTE_ITEMS, dump_items, raw_dump

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


# (area, subtopic, weight, patterns); a pattern in blanks matches a whole word.
RULE_TABLE = [
    ("en", "function words", 1, (" the ", " of ", " was ", " with ")),
    ("en", "endings", 2, ("tionth", "ingth", "blew")),
    ("fr", "function words", 1, (" les ", " des ", " dans ", " pour ")),
    ("fr", "endings", 2, ("eaux", "ement", "éo")),
    ("de", "function words", 1, (" der ", " die ", " und ", " nicht ")),
    ("de", "endings", 2, ("keit", "ungen", "schü")),
    ("es", "function words", 1, (" los ", " una ", " para ", " por ")),
    ("es", "endings", 2, ("ción", "mente", "ados")),
]


def java(p: str) -> str:
    return rf"\b{p.strip()}\b" if p.startswith(" ") else p


def re2(p: str) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return rf"(?i)(^|{edge}){p.strip()}($|{edge})" if p.startswith(" ") else f"(?i){p}"


RULES = [cl.Rule(a, s, w, tuple(java(p) for p in ps)) for a, s, w, ps in RULE_TABLE]
# One column per rule with constant patterns, so DuckDB compiles each once.
RULE_POINTS = "\nUNION ALL ".join(
    f"SELECT doc_id, {i} AS rule_id, '{a}' AS area, '{s}' AS subtopic, {w} * (" + " + ".join(f"CAST(regexp_matches(text, '{re2(p)}') AS INTEGER)" for p in ps) + ") AS points FROM documents"
    for i, (a, s, w, ps) in enumerate(RULE_TABLE))

CTE_SCORES = f"""points AS (SELECT * FROM ({RULE_POINTS}) WHERE points > 0),
totals AS (SELECT doc_id, area, CAST(sum(points) AS INTEGER) AS score, min(rule_id) AS first_rule, arg_max(subtopic, (points, -rule_id)) AS subtopic FROM points GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS next_score FROM totals WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, first_rule)),
top AS (SELECT d.doc_id, d.text, d.lang, r.area, coalesce(r.subtopic, '') AS rule_subtopic, coalesce(score, 0) AS top_score, coalesce(next_score, 0) AS runner_up,
  CASE WHEN score >= 3 AND score - coalesce(next_score, 0) >= 2 THEN r.area END AS rule_area FROM documents d LEFT JOIN ranked r ON d.doc_id = r.doc_id AND rn = 1)"""


def classified(spark, sf):
    return cl.classify(ad.documents(spark, sf), F.col("text"), RULES)


@register("rule_scores", f"WITH {CTE_SCORES} SELECT doc_id, area, score, subtopic FROM totals")
def rule_scores(spark, sf):
    rows = cl.score(ad.documents(spark, sf), F.col("text"), RULES)
    return rows.select("doc_id", F.inline("ranked")).select("doc_id", "area", "score", "subtopic")


@register("rule_classes", f"WITH {CTE_SCORES} SELECT doc_id, rule_area, rule_subtopic, top_score, runner_up FROM top")
def rule_classes(spark, sf):
    return classified(spark, sf).select("doc_id", "rule_area", "rule_subtopic", "top_score", "runner_up")


# The labels stand in for reviewed answers: a good document is filed by its language, a toxic one under a subtopic too.
def overrides(spark, sf):
    lab, doc = ad.table(spark, sf, "labels"), ad.documents(spark, sf).select("doc_id", "lang")
    return lab.join(doc, "doc_id").filter(F.col("quality") == 1).select(
        "doc_id", F.col("lang").alias("area"), F.when(F.col("toxic") == 1, "reviewed").alias("subtopic"))


CTE_ASSIGNED = f"""{CTE_SCORES}, o AS (SELECT doc_id, lang AS oa, CASE WHEN toxic = 1 THEN 'reviewed' END AS os FROM labels JOIN documents USING (doc_id) WHERE quality = 1),
assigned AS (SELECT doc_id, coalesce(rule_area, oa, 'en') AS area, CASE WHEN rule_area IS NOT NULL THEN 'rules' WHEN oa IS NOT NULL THEN 'override' ELSE 'default' END AS origin,
  coalesce(nullif(CASE WHEN rule_area IS NOT NULL THEN rule_subtopic WHEN oa IS NOT NULL THEN coalesce(os, rule_subtopic)
       WHEN rule_subtopic <> '' THEN rule_subtopic ELSE 'unclassified' END, ''), 'general') AS subtopic FROM top LEFT JOIN o USING (doc_id))"""


def assigned(spark, sf):
    return cl.assign(classified(spark, sf), overrides(spark, sf), "en", "doc_id")


@register("assigned_areas", f"WITH {CTE_ASSIGNED} SELECT * FROM assigned")
def assigned_areas(spark, sf):
    return assigned(spark, sf).select("doc_id", "area", "origin", "subtopic")


@register("review_queue", f"""WITH {CTE_SCORES} SELECT doc_id, left(text, 400) AS opening,
  coalesce((SELECT string_agg(area || '=' || score, ' ' ORDER BY rn) FROM ranked r WHERE r.doc_id = top.doc_id AND rn <= 3), '') AS top_scores FROM top WHERE rule_area IS NULL""")
def review_queue(spark, sf):
    return cl.review_queue(classified(spark, sf), "text", "doc_id")


@register("scoring_texts", f"""WITH {CTE_ITEMS} SELECT doc_id, id,
  md5(stem || ' ' || array_to_string(list_transform(options, lambda o: o.text), ' ') || ' ' || explanation || ' ' || array_to_string(refs, ' ')) AS text_md5 FROM items""")
def scoring_texts(spark, sf):
    text = cl.scoring_text(F.col("stem"), F.col("options"), F.col("explanation"), F.col("refs"))
    return dump_items(spark, sf, ["stem", "options", "explanation", "refs"]).select("doc_id", "id", F.md5(text).alias("text_md5"))


@register("legacy_terms", """SELECT doc_id, CASE WHEN bool_or(length(line) % 13 = 0) THEN
  'References Common Data Service; terminology superseded by Dataverse. References CDS; terminology superseded by Dataverse.' END AS note
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1""")
def legacy_terms(spark, sf):
    return raw_dump(spark, sf).select("doc_id", t.legacy_notes(F.col("text")).alias("note"))


BANDS = [("1-URGENT", "Urgent", 10, 20, 0.2), ("2-HIGH", "High", 19, 21, 0.2), ("3-MEDIUM", "Medium", 0, 15, 0.2),
         ("4-NOT SPECIFIED", "Not specified", 10, 25, 0.1), ("5-LOW", "Low", 15, 25, 0.2), ("6-NEVER", "Never", 0, 10, 0.1)]
BAND_VALUES = ", ".join(f"('{a}', {lo}, {hi})" for a, _, lo, hi, _ in BANDS)


@register("distribution_against_bands", f"""WITH b(area, lo, hi) AS (VALUES {BAND_VALUES}),
c AS (SELECT o_orderpriority AS area, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM orders GROUP BY 1)
SELECT area, coalesce(n, 0) AS n, round(coalesce(percent, 0), 6) AS percent, NOT (coalesce(percent, 0) BETWEEN lo AND hi) AS off_band FROM b LEFT JOIN c USING (area)""")
def distribution_against_bands(spark, sf):
    o = ad.table(spark, sf, "orders")
    return cl.distribution(o, strata_frame(o, BANDS), "o_orderpriority").select("area", "n", F.round("percent", 6).alias("percent"), "off_band")


@register("top_subtopics", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def top_subtopics(spark, sf):
    return cl.top_values(ad.table(spark, sf, "part"), "p_brand")


@register("rule_table_scores", ORACLES["rule_scores"])
def rule_table_scores(spark, sf):
    """The rules of ``rule_scores`` held in a table."""
    return rt.score(ad.documents(spark, sf), ["doc_id"], F.col("text"), rt.rule_rows(spark, RULES)).select("doc_id", "area", "score", "subtopic")


@register("rule_table_classes", ORACLES["rule_classes"])
def rule_table_classes(spark, sf):
    rows = rt.classify(ad.documents(spark, sf), ["doc_id"], F.col("text"), rt.rule_rows(spark, RULES))
    return rows.select("doc_id", "rule_area", "rule_subtopic", "top_score", "runner_up")


@register("legacy_terms_by_table", ORACLES["legacy_terms"])
def legacy_terms_by_table(spark, sf):
    terms = spark.createDataFrame([(i, p, note) for i, (p, note) in enumerate(k.LEGACY_TERMS)], "place int, pattern string, note string")
    rows = rt.notes(raw_dump(spark, sf), ["doc_id"], F.col("text"), terms)
    return rows.select("doc_id", F.when(F.size("notes") > 0, F.array_join("notes", " ")).alias("note"))


# Thousands of patterns: every longer word of the benchmark, filed by the first item that has it.
WORD_RULES = "SELECT word, min(item_id) AS rule_id FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM benchmark) GROUP BY word"


@register("word_rule_scores", f"""WITH w AS ({WORD_RULES})
SELECT doc_id, 'b' || (rule_id % 8) AS area, CAST(count(*) AS INTEGER) AS score FROM documents JOIN w ON contains(lower(text), word) GROUP BY ALL""")
def word_rule_scores(spark, sf):
    words = ad.table(spark, sf, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)).alias("pattern"))
    rules = words.groupBy("pattern").agg(F.min("item_id").alias("rule_id"))
    rules = rules.select("rule_id", F.concat(F.lit("b"), F.col("rule_id") % 8).alias("area"), F.lit("").alias("subtopic"), F.lit(1).alias("weight"), "pattern")
    return rt.score(ad.documents(spark, sf), ["doc_id"], F.col("text"), rules).select("doc_id", "area", "score")
