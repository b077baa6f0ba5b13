"""Queries that choose items: filters, seeded orders, quotas, papers, weak lists, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspark.operators import selection as sel
from itemspark.plans import adapters as ad
from itemspark.plans.progress_queries import SITTING_AS_OF, SITTING_STATE, sitting_as_of, sitting_state, ts, ts_sql

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


FILTER = sel.ItemFilter(area="STANDARD", type="mcq-single", graded_only=True, wrong_twice=True)
JOINED = f"""{SITTING_STATE},
joined AS (SELECT b.*, coalesce(p.box, 1) AS box, coalesce(p.attempts, 0) AS attempts, coalesce(p.times_wrong, 0) AS times_wrong,
  p.last_correct, p.last_confidence, p.last_at, p.due_at,
  p.due_at IS NULL OR p.due_at <= TIMESTAMP '{SITTING_AS_OF}' AS due FROM bank b LEFT JOIN progress p USING (item_id))"""
NARROW = "area = 'STANDARD' AND type = 'mcq-single' AND NOT self_graded AND times_wrong >= 2"


def bank(spark, sf):
    return ad.item_bank(spark, sf)


def unique_bank(spark, sf):
    return sel.keep_first(bank(spark, sf), "content_hash", "item_id")


UNIQUE = "item_id IN (SELECT min(item_id) FROM bank GROUP BY content_hash)"


@register("selected_items", f"""{JOINED}
SELECT item_id, md5('7:' || item_id) AS ticket FROM joined WHERE {NARROW} AND due AND {UNIQUE}""")
def selected_items(spark, sf):
    from dataclasses import replace
    return sel.select_items(unique_bank(spark, sf), sitting_state(spark, sf), replace(FILTER, seed=7), sitting_as_of()).select("item_id", "ticket")


@register("selected_items_unknown_area", f"""{JOINED}
SELECT item_id FROM joined WHERE times_wrong >= 2 ORDER BY md5('3:' || item_id), item_id LIMIT 25""")
def selected_items_unknown_area(spark, sf):
    """An area the strata do not know narrows nothing; the whole pool, not only due items; top 25."""
    flt = sel.ItemFilter(area="NO SUCH AREA", wrong_twice=True, due_only=False, limit=25, seed=3)
    flt = flt.known_to([s[0] for s in ad.PART_STRATA])
    return sel.select_items(bank(spark, sf), sitting_state(spark, sf), flt, sitting_as_of()).select("item_id")


@register("filter_counts", f"""{JOINED}
SELECT count(*) FILTER ({NARROW}) AS matching, count(*) FILTER ({NARROW} AND due) AS due FROM joined""")
def filter_counts(spark, sf):
    return sel.filter_counts(bank(spark, sf), sitting_state(spark, sf), FILTER, sitting_as_of())


@register("session_modes", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' OR o_totalprice > 400000
  THEN 'weak-area' ELSE 'drill' END AS mode FROM orders""")
def session_modes(spark, sf):
    """Each order stands for a set of parameters: status F an area, urgent a subtopic, a high price graded-only."""
    o = ad.table(spark, sf, "orders")
    mode = sel.session_mode(
        F.when(F.col("o_orderstatus") == "F", F.lit("area")), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("sub")),
        F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.col("o_totalprice") > 400000)
    return o.select("o_orderkey", mode.alias("mode"))


@register("filter_descriptions", """SELECT o_orderkey, concat_ws(' · ', CASE WHEN o_orderstatus = 'F' THEN 'area F' END,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Hotspot' END, CASE WHEN o_totalprice > 400000 THEN 'wrong at least twice' END,
  CASE WHEN o_totalprice > 300000 THEN 'machine-graded only' END, CASE WHEN o_orderstatus = 'O' THEN 'whole pool' ELSE 'due only' END,
  CASE WHEN o_orderstatus = 'P' THEN 'capped at 20' END) AS words FROM orders""")
def filter_descriptions(spark, sf):
    from itemspark.functions.digest import describe_filter
    o = ad.table(spark, sf, "orders")
    return o.select("o_orderkey", describe_filter(
        area=F.when(F.col("o_orderstatus") == "F", F.lit("area F")), subtopic=F.lit(None).cast("string"),
        type_label=F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Hotspot")),
        wrong_twice=F.col("o_totalprice") > 400000, graded_only=F.col("o_totalprice") > 300000,
        due_only=F.when(F.col("o_orderstatus") == "O", F.lit(False)), limit=F.when(F.col("o_orderstatus") == "P", F.lit(20))).alias("words"))


@register("subtopics_by_area", "SELECT DISTINCT p_type AS area, p_brand AS subtopic FROM part WHERE p_brand <> ''")
def subtopics_by_area(spark, sf):
    return sel.subtopics(bank(spark, sf))


@register("subtopics_of_one_area", "SELECT DISTINCT p_type AS area, p_brand AS subtopic FROM part WHERE p_brand <> '' AND p_type = 'PROMO'")
def subtopics_of_one_area(spark, sf):
    return sel.subtopics(bank(spark, sf), "PROMO")


@register("seeded_order", "SELECT doc_id, md5('42:' || doc_id) AS ticket FROM documents")
def seeded_order(spark, sf):
    return sel.seeded_order(ad.table(spark, sf, "documents").select("doc_id"), "doc_id", 42).select("doc_id", "ticket")


@register("seeded_order_limited", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 40")
def seeded_order_limited(spark, sf):
    return sel.seeded_order(ad.table(spark, sf, "documents").select("doc_id"), "doc_id", 42, 40).select("doc_id")


# Weights from the data: each order priority's share of all orders.
def priority_strata(spark, sf):
    o = ad.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("area")).agg(F.count(F.lit(1)).alias("capacity"))
    total = ad.table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"))
    return o, o.select("area", "capacity", (F.col("capacity") / total.scalar()).alias("weight"))


QUOTA_SQL = """s AS (SELECT o_orderpriority AS area, count(*) AS cap, count(*) / (SELECT count(*) FROM orders) AS weight FROM orders GROUP BY 1),
q AS (SELECT *, round(weight * {n}, 12) AS exact FROM s),
r AS (SELECT *, CAST(floor(exact) AS INTEGER) + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 12) DESC, weight DESC, area)
   <= {n} - (SELECT sum(floor(exact)) FROM q) THEN 1 ELSE 0 END AS quota FROM q)"""


@register("quotas_by_weight", f"WITH {QUOTA_SQL.format(n=47)} SELECT area, quota FROM r")
def quotas_by_weight(spark, sf):
    return sel.allocate(priority_strata(spark, sf)[1].drop("capacity"), 47).select("area", "quota")


# Capacity of a priority: its customers' nations in region 0 of status F — small enough for some quotas to overflow.
CAP_SQL = """c AS (SELECT o_orderpriority AS area, count(DISTINCT o_orderstatus) * CASE WHEN o_orderpriority < '3' THEN 2 ELSE 8 END AS capacity
  FROM orders GROUP BY 1)"""


@register("quotas_under_capacity", f"""WITH RECURSIVE {QUOTA_SQL.format(n=60)}, {CAP_SQL},
start AS (SELECT list({{'area': area, 'w': weight, 'quota': least(quota, capacity), 'cap': capacity}} ORDER BY weight DESC, area) AS st,
  CAST(sum(greatest(quota - capacity, 0)) AS BIGINT) AS left_over, 0 AS i FROM r JOIN c USING (area)),
turn AS (SELECT * FROM start UNION ALL
  SELECT list_transform(st, lambda x, k: CASE WHEN k - 1 = i % len(st) AND x.quota < x.cap THEN
      {{'area': x.area, 'w': x.w, 'quota': x.quota + 1, 'cap': x.cap}} ELSE x END),
    left_over - CASE WHEN st[i % len(st) + 1].quota < st[i % len(st) + 1].cap THEN 1 ELSE 0 END, i + 1
  FROM turn WHERE left_over > 0 AND i < 1000),
done AS (SELECT arg_max(st, i) AS st FROM turn)
SELECT x.area AS area, CAST(x.quota AS INTEGER) AS quota FROM (SELECT unnest(st) AS x FROM done)""")
def quotas_under_capacity(spark, sf):
    _, strata = priority_strata(spark, sf)
    cap = ad.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("area")).agg(
        F.countDistinct("o_orderstatus").alias("k")).select(
        "area", (F.col("k") * F.when(F.col("area") < "3", 2).otherwise(8)).alias("capacity"))
    return sel.allocate(strata.drop("capacity"), 60, cap).select("area", "quota")


PAPER_SQL = f"""{ad.CTE_STRATA},
q AS (SELECT key AS area, weight, round(weight * 50, 12) AS exact FROM strata),
shape AS (SELECT area, weight, CAST(floor(exact) AS INTEGER) + CASE WHEN row_number() OVER (ORDER BY round(exact - floor(exact), 12) DESC, weight DESC, area)
   <= 50 - (SELECT sum(floor(exact)) FROM q) THEN 1 ELSE 0 END AS quota FROM q)"""


@register("paper_shape", f"WITH {PAPER_SQL} SELECT area, quota, n AS capacity FROM shape JOIN (SELECT p_type AS area, count(*) AS n FROM part GROUP BY 1) USING (area)")
def paper_shape(spark, sf):
    return sel.paper_shape(bank(spark, sf), ad.PART_STRATA, 50).select("area", "quota", "capacity")


@register("sampled_paper", f"""{JOINED}, {PAPER_SQL},
ranked AS (SELECT item_id, area, CAST(self_graded AS INTEGER) * 3 + CASE WHEN attempts = 0 THEN 0 WHEN due THEN 1 ELSE 2 END AS tier,
  row_number() OVER (PARTITION BY area ORDER BY CAST(self_graded AS INTEGER) * 3 + CASE WHEN attempts = 0 THEN 0 WHEN due THEN 1 ELSE 2 END,
     md5('11:' || item_id), item_id) AS rn FROM joined WHERE {UNIQUE})
SELECT item_id, ranked.area AS area, tier, md5('11/place:' || item_id) AS place FROM ranked JOIN shape USING (area) WHERE rn <= quota""")
def sampled_paper(spark, sf):
    return sel.sample_paper(unique_bank(spark, sf), sitting_state(spark, sf), ad.PART_STRATA, 50, 11, sitting_as_of()).select(
        "item_id", "area", "tier", "place")


@register("paper_fidelity", f"""WITH {PAPER_SQL}, {ad.CTE_BANK},
ranked AS (SELECT seed, area, row_number() OVER (PARTITION BY seed, area ORDER BY CAST(self_graded AS INTEGER), md5(seed || ':' || item_id), item_id) AS rn
  FROM bank, (SELECT unnest(range(1, 1001)) AS seed)),
drawn AS (SELECT area, count(*) AS n FROM ranked JOIN shape USING (area) WHERE rn <= quota GROUP BY 1)
SELECT area, n AS drawn, round(n / (SELECT sum(n) FROM drawn), 6) AS share, round(100 * abs(n / (SELECT sum(n) FROM drawn) - weight), 6) AS gap_pp
FROM drawn JOIN shape USING (area)""")
def paper_fidelity(spark, sf):
    from itemspark.operators.analytics import sampling_fidelity
    items = bank(spark, sf)
    return sampling_fidelity(items, ad.PART_STRATA, 50, 1000).select("area", "drawn", F.round("share", 6).alias("share"), F.round("gap_pp", 6).alias("gap_pp"))


WEAK_ORDER = "times_wrong DESC, CAST(last_correct AS INTEGER), last_at DESC, item_id"


@register("weak_items", f"""{JOINED}
SELECT item_id, times_wrong, last_correct, row_number() OVER (ORDER BY {WEAK_ORDER}) AS place
FROM joined WHERE {UNIQUE} AND attempts > 0 AND (times_wrong >= 12 OR (last_correct AND coalesce(last_confidence, 'unsure') <> 'confident'))
QUALIFY place <= 200""")
def weak_items(spark, sf):
    rows = sel.weak_list(unique_bank(spark, sf), sitting_state(spark, sf), 12, include_shaky=True, limit=200)
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("times_wrong"), F.col("last_correct").cast("int"), F.desc("last_at"), "item_id")
    return rows.withColumn("place", F.row_number().over(w).cast("bigint")).select("item_id", "times_wrong", "last_correct", "place")


@register("weak_items_of_area", f"""{JOINED}
SELECT item_id, times_wrong FROM joined WHERE {UNIQUE} AND attempts > 0 AND times_wrong >= 2 AND area = 'SMALL' AND subtopic = 'Brand#7'""")
def weak_items_of_area(spark, sf):
    return sel.weak_list(unique_bank(spark, sf), sitting_state(spark, sf), area="SMALL", subtopic="Brand#7").select("item_id", "times_wrong")


@register("export_items", f"""{JOINED}
SELECT item_id FROM joined WHERE {UNIQUE} AND attempts > 0 AND times_wrong >= 1 AND NOT self_graded ORDER BY {WEAK_ORDER} LIMIT 10""")
def export_items(spark, sf):
    return sel.export_list(unique_bank(spark, sf), sitting_state(spark, sf), include_self_graded=False).select("item_id")


RESULTS = f"WITH {ad.CTE_RESULTS}"


@register("slowest_per_session", f"""{RESULTS}
SELECT session_id, item_id, elapsed_ms, CAST(row_number() OVER (PARTITION BY session_id ORDER BY elapsed_ms DESC, item_id) AS INTEGER) AS place
FROM results QUALIFY place <= 3""")
def slowest_per_session(spark, sf):
    return sel.slowest(ad.sitting_results(spark, sf)).select("session_id", "item_id", "elapsed_ms", "place")


@register("missed_items", f"""{RESULTS}
SELECT session_id, item_id, p_name AS stem FROM results JOIN part ON p_partkey = item_id WHERE NOT correct""")
def missed_items(spark, sf):
    return sel.missed(ad.sitting_results(spark, sf), bank(spark, sf)).select("session_id", "item_id", "stem")


@register("wrong_only_review", f"{RESULTS} SELECT session_id, item_id, area FROM results WHERE NOT correct")
def wrong_only_review(spark, sf):
    return ad.sitting_results(spark, sf).filter(~F.col("correct")).orderBy("session_id", "item_id").select("session_id", "item_id", "area")


@register("sessions_by_recency", f"SELECT o_orderkey AS session_id, {ts_sql('o_orderdate').replace('AS o_orderdate', 'AS started_at')} FROM orders")
def sessions_by_recency(spark, sf):
    return sel.most_recent_first(ad.sittings(spark, sf)).select("session_id", ts("started_at"))


@register("id_set_operations", """SELECT 'union' AS op, id FROM (SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer)
UNION ALL SELECT 'difference', id FROM (SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def id_set_operations(spark, sf):
    a = ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    b = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return (sel.id_union(a, b, "id").withColumn("op", F.lit("union"))
            .unionByName(sel.id_difference(b, a, "id").withColumn("op", F.lit("difference"))))
