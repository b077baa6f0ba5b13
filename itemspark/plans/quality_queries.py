"""Data-quality counters over the dump's items, documents with labels, and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspark.functions.scalars import percent_one_place, whole_percent
from itemspark.operators import identity as idn
from itemspark.operators import quality as q
from itemspark.operators.selection import strata_frame
from itemspark.plans import adapters as ad
from itemspark.plans.dump import CTE_ITEMS, dump_items
from itemspark.plans.extract_queries import NOTED
from itemspark.session import work_dir
from itemspark.sources.stored import written_counting

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


PRIORITIES = [("1-URGENT", "Urgent", 10, 20, 0.2), ("2-HIGH", "High", 15, 25, 0.2), ("3-MEDIUM", "Medium", 20, 42, 0.2),
              ("4-NOT SPECIFIED", "Not specified", 10, 20, 0.1), ("5-LOW", "Low", 15, 25, 0.1), ("9-NONE", "None", 5, 10, 0.2)]
PRIORITY_VALUES = ", ".join(f"('{a}', '{b}', {lo}, {hi}, {w})" for a, b, lo, hi, w in PRIORITIES)


@register("pool_adequacy", f"""WITH s(area, label, lo, hi, weight) AS (VALUES {PRIORITY_VALUES}), c AS (SELECT o_orderpriority AS area, count(*) AS n FROM orders GROUP BY 1)
SELECT area, coalesce(n, 0) AS n, CAST(round_even(60 * hi / 100.0, 0) * 300 AS INTEGER) AS need, CASE WHEN coalesce(n, 0) >= round_even(60 * hi / 100.0, 0) * 300 THEN 'ok' ELSE 'thin' END AS verdict FROM s LEFT JOIN c USING (area)""")
def pool_adequacy(spark, sf):
    o = ad.table(spark, sf, "orders").withColumn("area", F.col("o_orderpriority"))
    return q.pool_adequacy(o, strata_frame(o, PRIORITIES), 60, 300).select("area", "n", "need", "verdict")


def labelled_docs(spark, sf):
    """Documents as a bank: toxic is low confidence, bad quality suspect, short ones lack references."""
    d = ad.table(spark, sf, "documents").join(ad.table(spark, sf, "labels"), "doc_id", "left")
    short = F.col("n_chars") < 1000
    return d.select(
        "doc_id", F.col("lang").alias("area"), F.col("text").alias("background"),
        F.when(F.col("toxic") == 1, "low").otherwise("high").alias("parse_confidence"),
        F.when(F.col("quality") == 0, "suspect").when(F.col("quality").isNull(), "superseded").otherwise("current").alias("currency"),
        F.when(F.col("source") == "src0", "  ").otherwise(F.col("text")).alias("explanation"),
        F.when(short, F.array()).otherwise(F.array("source")).cast("array<string>").alias("refs"))


CTE_LABELLED = """docs AS (SELECT doc_id, lang AS area, text, coalesce(toxic = 1, false) AS low, CASE WHEN quality = 0 THEN 'suspect' WHEN quality IS NULL THEN 'superseded' ELSE 'current' END AS currency,
  source = 'src0' AS bare, n_chars < 1000 AS unreferenced FROM documents LEFT JOIN labels USING (doc_id)),
keys AS (SELECT doc_id, text, left(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 200) AS k FROM documents),
parents AS (SELECT k, count(*) AS n_items, arg_min(text, doc_id) AS text FROM keys GROUP BY 1 HAVING length(trim(arg_min(text, doc_id), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 200)"""


@register("quality_counters", f"""WITH {CTE_LABELLED} SELECT count(*) AS total, count(*) FILTER (low) AS low_confidence, count(*) FILTER (currency = 'suspect') AS suspect,
  count(*) FILTER (currency = 'superseded') AS superseded, count(*) FILTER (bare) AS no_explanation, count(*) FILTER (unreferenced) AS no_reference,
  (SELECT count(*) FROM parents) AS parents, CAST((SELECT sum(n_items) FROM parents) AS BIGINT) AS children FROM docs""")
def quality_counters(spark, sf):
    d = labelled_docs(spark, sf)
    return q.quality_counters(d, idn.parent_groups(d, "doc_id"))


@register("written_bank_counters", f"""WITH {CTE_LABELLED} SELECT count(*) AS total, count(*) FILTER (low) AS low_confidence, count(*) FILTER (currency = 'suspect') AS suspect,
  count(*) FILTER (currency = 'superseded') AS superseded, count(*) FILTER (bare) AS no_explanation, count(*) FILTER (unreferenced) AS no_reference FROM docs""")
def written_bank_counters(spark, sf):
    """The bank's counters from the pass that writes it."""
    return written_counting(labelled_docs(spark, sf), work_dir(spark, "counted"), q.bank_counters())


@register("currency_statement", f"""WITH {CTE_LABELLED} SELECT count(*) AS total, count(*) FILTER (currency <> 'current') AS suspect, count(*) FILTER (low) AS low_confidence,
  count(*) FILTER (currency = 'superseded') AS superseded, count(*) FILTER (currency <> 'current' OR low) AS flagged, count(*) FILTER (NOT unreferenced) AS with_references FROM docs""")
def currency_statement(spark, sf):
    return q.currency_statement(labelled_docs(spark, sf))


LANGS = [("en", "English", 0, 0, 0.2), ("fr", "French", 0, 0, 0.2), ("de", "German", 0, 0, 0.2), ("es", "Spanish", 0, 0, 0.2), ("xx", "Unused", 0, 0, 0.2)]


@register("currency_by_area", f"""WITH {CTE_LABELLED}, s(area, label) AS (VALUES ('en', 'English'), ('fr', 'French'), ('de', 'German'), ('es', 'Spanish'), ('xx', 'Unused'))
SELECT area, label, count(doc_id) AS total, count(*) FILTER (currency <> 'current') AS suspect, count(*) FILTER (low) AS low_confidence FROM s LEFT JOIN docs USING (area) GROUP BY ALL""")
def currency_by_area(spark, sf):
    d = labelled_docs(spark, sf)
    return q.currency_statement(d, strata_frame(d, LANGS))


@register("percentages", """WITH c AS (SELECT o_custkey, count(*) FILTER (o_totalprice > 100000) AS big, count(*) FILTER (o_totalprice > 100000 AND o_orderstatus = 'F') AS fin FROM orders GROUP BY 1)
SELECT o_custkey, CAST(CASE WHEN big = 0 THEN 0 ELSE round(fin / big * 100) END AS INTEGER) AS whole, CASE WHEN big <> 0 THEN round(100.0::DOUBLE * fin / big, 1) END AS one_place FROM c""")
def percentages(spark, sf):
    big = F.col("o_totalprice") > 100000
    c = ad.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(big).alias("big"), F.count_if(big & (F.col("o_orderstatus") == "F")).alias("fin"))
    return c.select("o_custkey", whole_percent(F.col("fin"), F.col("big")).alias("whole"), percent_one_place(F.col("fin"), F.col("big")).alias("one_place"))


# Weights measured from the data: each language's share; the band is five points around it.
@register("weight_checks", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT lang, n / sum(n) OVER () AS w, CAST(floor(100.0 * n / sum(n) OVER ()) AS INTEGER) AS pc FROM c),
b AS (SELECT lang, w, greatest(pc - 3, 0) AS lo, pc + 3 AS hi FROM s)
SELECT round(sum(w), 9) AS weight_sum, bool_and(w * 100 BETWEEN lo AND hi) AS all_in_band, round(max(abs(w / ((lo + hi) / 200) - 1 / 0.95::DOUBLE)), 9) AS scale_error, arg_max(lang, w) AS heaviest FROM b""")
def weight_checks(spark, sf):
    return q.weight_checks(lang_bands(spark, sf)).select(F.round("weight_sum", 9).alias("weight_sum"), "all_in_band", F.round("scale_error", 9).alias("scale_error"), "heaviest")


def lang_bands(spark, sf):
    from pyspark.sql import Window
    c = ad.table(spark, sf, "documents").groupBy(F.col("lang").alias("area")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return c.withColumn("weight", share).withColumn("_pc", F.floor(F.col("weight") * 100).cast("int")).select(
        "area", F.col("area").alias("label"), F.greatest(F.col("_pc") - 3, F.lit(0)).alias("lo"), (F.col("_pc") + 3).alias("hi"), "weight")


@register("weights_from_bands", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT lang, CAST(floor(100.0 * n / sum(n) OVER ()) AS INTEGER) AS pc FROM c),
b AS (SELECT lang AS area, (greatest(pc - 3, 0) + pc + 3) / 2 AS mid FROM s) SELECT area, round(mid / sum(mid) OVER (), 9) AS weight FROM b""")
def weights_from_bands(spark, sf):
    return q.weights_from_bands(lang_bands(spark, sf).drop("weight")).select("area", F.round("weight", 9).alias("weight"))


@register("note_frequency", f"{NOTED}, x AS (SELECT unnest(notes) AS note FROM noted) SELECT note, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, note LIMIT 8")
def note_frequency(spark, sf):
    return q.note_frequency(dump_items(spark, sf, ["parse_notes"]))


@register("content_counters", f"""WITH {CTE_ITEMS} SELECT count(*) AS parsed, count(*) FILTER (len(options) > 0) AS with_options, count(*) FILTER (len(correct) > 0) AS with_key,
  count(*) FILTER (len(boxes) > 0) AS with_boxes, count(*) FILTER (explanation <> '') AS with_explanation, count(*) FILTER (len(refs) > 0) AS with_references, count(background) AS with_background FROM items""")
def content_counters(spark, sf):
    return q.content_counters(dump_items(spark, sf, ["options", "correct", "boxes", "explanation", "refs", "background"]))


@register("duplicate_id_problems", """SELECT l_orderkey AS id, 'duplicate id' AS rule, '' AS detail FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey) > 1""")
def duplicate_id_problems(spark, sf):
    return q.duplicate_ids(ad.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id")))


@register("spot_check", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 200000 ORDER BY o_orderkey LIMIT 5")
def spot_check(spark, sf):
    o = ad.table(spark, sf, "orders")
    return q.spot_check(o, (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000), ["o_orderkey"]).select("o_orderkey", "o_totalprice")
