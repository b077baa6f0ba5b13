"""The whole bank from end to end: dump, two parses, reconciliation, parent groups, filing, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspark.operators import classify as cl
from itemspark.operators import identity as idn
from itemspark.operators import quality as q
from itemspark.operators import reconcile as rec
from itemspark.operators.stages import stage
from itemspark.plans.classify_queries import RULE_TABLE, RULES, overrides, re2
from itemspark.plans.dump import CTE_ITEMS, raw_items
from itemspark.plans.extract_queries import LOW, NOTES
from itemspark.session import stored

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


AREAS = ("en", "fr", "de", "es")
MIN_BACKGROUND = 20

# The first parse misses every ninth item, the second every tenth and misreads the key of every eighth.
MERGED = f"""{CTE_ITEMS}, noted AS (SELECT *, {NOTES} AS notes FROM items),
sides AS (SELECT *, {LOW} = 'low' AS a_low, id % 9 <> 0 AS in_a, id % 10 <> 0 AS in_b, CASE WHEN id % 8 = 1 THEN ['B'] ELSE correct END AS cb FROM noted),
m0 AS (SELECT *, in_a AND in_b AND len(correct) > 0 AND len(cb) > 0 AND correct <> cb AS conflict,
  CASE WHEN in_a AND len(correct) > 0 THEN correct WHEN in_b THEN cb ELSE [] END AS key FROM sides WHERE in_a OR in_b),
merged AS (SELECT *, doc_id * 1000000 + id AS item_no, CASE WHEN in_a AND in_b THEN 'merged' WHEN in_a THEN 'a' ELSE 'b' END AS source,
  len(list_filter(key, lambda x: NOT choice OR x NOT IN ('A', 'B', 'C'))) > 0 AS orphan, NOT choice AND len(boxes) = 0 AS bare,
  stem || ' ' || array_to_string(list_transform(options, lambda o: o.text), ' ') || ' ' || explanation || ' ' || array_to_string(refs, ' ') AS text,
  lower(trim(regexp_replace(background, '\\s+', ' ', 'g'))) AS bk FROM m0)"""
POINTS = "\nUNION ALL ".join(
    f"SELECT item_no, {i} AS rule_id, '{a}' AS area, {w} * (" + " + ".join(f"CAST(regexp_matches(text, '{re2(p)}') AS INTEGER)" for p in ps) + ") AS points FROM merged"
    for i, (a, _, w, ps) in enumerate(RULE_TABLE))


@register("bank_pipeline", f"""WITH {MERGED},
parents AS (SELECT left(bk, 200) AS k FROM merged WHERE length(background) > 0 GROUP BY 1 HAVING length(arg_min(background, item_no)) >= {MIN_BACKGROUND}),
totals AS (SELECT item_no, area, sum(points) AS score, min(rule_id) AS first_rule FROM ({POINTS}) WHERE points > 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS next_score FROM totals WINDOW w AS (PARTITION BY item_no ORDER BY score DESC, first_rule)),
o AS (SELECT doc_id, lang AS oa FROM labels JOIN documents USING (doc_id) WHERE quality = 1),
filed AS (SELECT m.*, oa, CASE WHEN score >= 3 AND score - coalesce(next_score, 0) >= 2 THEN r.area END AS ra FROM merged m
  LEFT JOIN ranked r ON r.item_no = m.item_no AND rn = 1 LEFT JOIN o ON o.doc_id = m.doc_id)
SELECT source, CASE WHEN ra IS NOT NULL THEN 'rules' WHEN oa IS NOT NULL THEN 'override' ELSE 'default' END AS origin, coalesce(ra, oa, 'en') AS area, count(*) AS n,
  count(*) FILTER (left(bk, 200) IN (SELECT k FROM parents)) AS grouped, count(*) FILTER (conflict) AS disputed,
  count(*) FILTER (conflict OR orphan OR NOT in_a OR a_low OR bare) AS low_confidence,
  count(*) FILTER (choice AND len(key) = 0) + count(*) FILTER (choice AND orphan) AS problems FROM filed GROUP BY ALL""")
def bank_pipeline(spark, sf):
    """Per source, way of filing and area: items, those in a parent group, disputed keys, low confidence, problem rows."""
    on = ("doc_id", "id")
    a, b = raw_items(spark, sf, "a", spread=on), raw_items(spark, sf, "b", spread=on)
    # What a parse misses is taken out after it, in a column of its own: a filter by id would be pushed below the part
    # that both parses have in common, which would then be two.
    a = stage(a, {"_seen": F.col("id") % 9 != 0}).filter("_seen").drop("_seen")
    b = stage(b, {"_seen": F.col("id") % 10 != 0}).filter("_seen").drop("_seen")
    b = b.withColumn("correct", F.when(F.col("id") % 8 == 1, F.array(F.lit("B"))).otherwise(F.col("correct")))
    items = rec.reconcile(a, b, on).withColumn("item_no", F.col("doc_id") * 1000000 + F.col("id"))
    items = stored(items, "reconciled")
    linked = idn.link_parents(items, idn.parent_groups(items, "item_no", min_chars=MIN_BACKGROUND))
    text = cl.scoring_text(F.col("stem"), F.col("options"), F.col("explanation"), F.col("refs"))
    filed = cl.assign(cl.classify(linked, text, RULES), overrides(spark, sf), "en", "doc_id")
    filed = stored(filed, "bank")
    found = q.problems(filed, AREAS, id_col="item_no").groupBy("item_no").agg(F.count(F.lit(1)).alias("found"))
    return filed.join(found, "item_no", "left").groupBy("source", "origin", "area").agg(
        F.count(F.lit(1)).alias("n"), F.count("group_id").alias("grouped"), F.count("disagreement").alias("disputed"),
        F.count_if(F.col("parse_confidence") == "low").alias("low_confidence"), F.coalesce(F.sum("found"), F.lit(0).cast("bigint")).alias("problems"))
