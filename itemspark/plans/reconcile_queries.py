"""Reconciling two parses: ``orders`` is the first, order rows derived from ``lineitem`` the second."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspark.functions.text import BOXES_TYPE, OPTIONS_TYPE
from itemspark.operators import quality as q
from itemspark.operators import reconcile as rec
from itemspark.plans import adapters as ad
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


def letters(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def opts(*xs):
    return F.array(*[F.struct(F.lit(x).alias("key"), F.lit(f"status {x}").alias("text")) for x in xs]).cast(OPTIONS_TYPE)


def parse_a(spark, sf):
    """Orders, except the low-priority partial ones this parse missed. A = finished, B = open."""
    o = ad.table(spark, sf, "orders")
    p, s, price = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.filter(~((p == "5-LOW") & (s == "P"))).select(
        F.col("o_orderkey").alias("id"),
        F.when(p == "1-URGENT", "hotspot").when(p == "2-HIGH", "dragdrop").otherwise("mcq-single").alias("type"),
        F.when((p == "3-MEDIUM") & (s == "P"), "").otherwise(F.concat(F.lit("Order of "), day)).alias("stem"),
        F.when(p == "4-NOT SPECIFIED", F.array().cast(OPTIONS_TYPE)).otherwise(opts("A", "B")).alias("options"),
        F.when(p == "1-URGENT", letters()).when(s == "F", letters("A")).when(s == "O", letters("B")).otherwise(letters("A", "B")).alias("correct"),
        F.when(price < 50000, "").when(price > 480000, "Moved from Common Data Service to docs.microsoft.com").otherwise("priced").alias("explanation"),
        F.when(p == "1-URGENT", F.when(price > 250000, F.array(F.struct(F.lit(1).alias("box"), day.alias("answer")))))
        .otherwise(F.array()).cast(BOXES_TYPE).alias("boxes"),
        F.when(price > 450000, "low").otherwise("high").alias("parse_confidence"),
        F.when(price > 450000, letters("expensive")).otherwise(letters()).alias("parse_notes"),
    )


def parse_b(spark, sf):
    """Orders as their lines tell them; only the key, options, media and a stem are known."""
    g = ad.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.bool_or(F.col("l_linestatus") == "F").alias("f"), F.bool_or(F.col("l_linestatus") == "O").alias("o"),
        F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.max("l_quantity").alias("q"))
    key = F.when(F.col("f") & F.col("o"), letters("A", "B")).when(F.col("f"), letters("A")).otherwise(letters("B"))
    return g.select(
        "id", F.lit("mcq-single").alias("type"), F.concat(F.lit("Lines of "), F.col("id").cast("string")).alias("stem"),
        opts("A", "B", "C").alias("options"), F.when(F.col("q") >= 45, letters()).otherwise(key).alias("correct"),
        F.lit("from lines").alias("explanation"),
        F.when(F.col("r"), F.array(F.concat(F.lit("img-"), F.col("id").cast("string")))).otherwise(F.array()).cast("array<string>").alias("images"),
        letters("second source").alias("parse_notes"),
    )


CTE_PARSES = """a AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'hotspot' WHEN '2-HIGH' THEN 'dragdrop' ELSE 'mcq-single' END AS type,
    CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN '' ELSE 'Order of ' || strftime(o_orderdate, '%Y-%m-%d') END AS stem,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE 'AB' END AS options,
    CASE WHEN o_orderpriority = '1-URGENT' THEN '' WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderstatus = 'O' THEN 'B' ELSE 'AB' END AS correct,
    CASE WHEN o_totalprice < 50000 THEN '' WHEN o_totalprice > 480000 THEN 'Moved from Common Data Service to docs.microsoft.com' ELSE 'priced' END AS explanation,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 250000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS box,
    o_totalprice > 450000 AS low FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderstatus = 'P')),
b AS (SELECT l_orderkey AS id, 'Lines of ' || l_orderkey AS stem, CASE WHEN max(l_quantity) >= 45 THEN '' WHEN bool_or(l_linestatus = 'F') AND bool_or(l_linestatus = 'O') THEN 'AB'
    WHEN bool_or(l_linestatus = 'F') THEN 'A' ELSE 'B' END AS correct, CASE WHEN bool_or(l_returnflag = 'R') THEN 'img-' || l_orderkey ELSE '' END AS images FROM lineitem GROUP BY 1),
m AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'a' WHEN a.id IS NULL THEN 'b' ELSE 'merged' END AS source, a.id IS NOT NULL AS in_a, b.id IS NOT NULL AS in_b,
    a.correct AS ca, b.correct AS cb, coalesce(a.low, false) AS a_low, coalesce(a.box, '') AS box,
    CASE WHEN coalesce(a.stem, '') <> '' THEN a.stem ELSE coalesce(b.stem, '') END AS stem,
    CASE WHEN coalesce(a.options, '') <> '' THEN a.options WHEN b.id IS NOT NULL THEN 'ABC' ELSE '' END AS options,
    CASE WHEN coalesce(a.correct, '') <> '' THEN a.correct ELSE coalesce(b.correct, '') END AS correct,
    CASE WHEN coalesce(a.explanation, '') <> '' THEN a.explanation WHEN b.id IS NOT NULL THEN 'from lines' ELSE '' END AS explanation,
    coalesce(b.images, '') AS images, coalesce(a.type, 'mcq-single') AS t0 FROM a FULL JOIN b ON a.id = b.id),
n AS (SELECT *, CASE WHEN t0 = 'mcq-single' AND length(correct) > 1 THEN 'mcq-multi' ELSE t0 END AS type,
    coalesce(ca <> '' AND cb <> '' AND ca <> cb, false) AS conflict, options = '' AND correct <> '' AS orphan FROM m),
items AS (SELECT *, (type IN ('hotspot', 'dragdrop') AND box = '') OR (type LIKE 'mcq%' AND options = '' AND correct = '') AS self_graded,
    conflict OR orphan OR NOT in_a OR a_low OR (type IN ('hotspot', 'dragdrop') AND box = '') AS low FROM n)"""


def reconciled(spark, sf):
    return rec.reconcile(parse_a(spark, sf), parse_b(spark, sf))


def keys_text(c):
    return F.array_join(F.transform(c, lambda o: o["key"]), "").alias("options")


@register("reconciled_fields", f"""WITH {CTE_PARSES}
SELECT id, source, type, stem, options, correct, explanation, images, box AS boxes, self_graded, CASE WHEN low THEN 'low' ELSE 'high' END AS confidence FROM items""")
def reconciled_fields(spark, sf):
    return reconciled(spark, sf).select(
        "id", "source", "type", "stem", keys_text("options"), F.array_join("correct", "").alias("correct"), "explanation",
        F.array_join("images", "").alias("images"), F.array_join(F.transform("boxes", lambda b: b["answer"]), "").alias("boxes"),
        "self_graded", F.col("parse_confidence").alias("confidence"))


@register("reconciled_notes", f"""WITH {CTE_PARSES}
SELECT id, concat_ws('; ', CASE WHEN NOT in_a THEN 'second source' END, CASE WHEN a_low THEN 'expensive' END,
    CASE WHEN conflict THEN 'answer key disagreement: A=' || ca || ' B=' || cb END) AS notes,
  CASE WHEN conflict THEN ca || '/' || cb END AS disagreement,
  CASE WHEN explanation LIKE 'Moved%' THEN 'suspect' ELSE 'current' END AS currency,
  CASE WHEN explanation LIKE 'Moved%' THEN 'References Common Data Service; terminology superseded by Dataverse. Links to docs.microsoft.com; content has moved to learn.microsoft.com.' END AS currency_note
FROM items""")
def reconciled_notes(spark, sf):
    d = F.col("disagreement")
    return reconciled(spark, sf).select(
        "id", F.array_join("parse_notes", "; ").alias("notes"),
        F.when(d.isNotNull(), F.concat(F.array_join(d["a"], ""), F.lit("/"), F.array_join(d["b"], ""))).alias("disagreement"),
        "currency", "currency_note")


@register("reconciled_hashes", f"""WITH {CTE_PARSES}
SELECT id, left(sha256(lower(trim(regexp_replace(concat_ws(chr(1), type, CASE WHEN stem = '' THEN CAST(id AS VARCHAR) ELSE stem END,
   CASE WHEN options <> '' THEN array_to_string(list_transform(string_split(options, ''), lambda o: o || ':status ' || o), chr(1)) END,
   CASE WHEN box <> '' THEN '1:' || box END, CASE WHEN images <> '' THEN images END), '\\s+', ' ', 'g')))), 16) AS content_hash FROM items""")
def reconciled_hashes(spark, sf):
    return reconciled(spark, sf).select("id", "content_hash")


@register("source_split", f"""WITH {CTE_PARSES} SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM items GROUP BY 1""")
def source_split(spark, sf):
    return q.split_and_shares(reconciled(spark, sf), "source")


@register("key_agreement", f"""WITH {CTE_PARSES}, c AS (SELECT count(*) AS present_in_both, count(*) FILTER (ca <> '' AND cb <> '') AS keyed_in_both,
  count(*) FILTER (conflict) AS disputed FROM items WHERE in_a AND in_b)
SELECT present_in_both, keyed_in_both, disputed, round(disputed / keyed_in_both, 6) AS rate_keyed, disputed / keyed_in_both > 0.05 AS alarm_keyed,
  round(disputed / present_in_both, 6) AS rate_present, disputed / present_in_both > 0.05 AS alarm_present FROM c""")
def key_agreement(spark, sf):
    return rec.agreement(parse_a(spark, sf), parse_b(spark, sf)).select(
        "present_in_both", "keyed_in_both", "disputed", F.round("rate_keyed", 6).alias("rate_keyed"), "alarm_keyed",
        F.round("rate_present", 6).alias("rate_present"), "alarm_present")


@register("type_breakdown", f"WITH {CTE_PARSES} SELECT type, count(*) AS n, count(*) FILTER (NOT self_graded) AS machine_graded FROM items GROUP BY 1")
def type_breakdown(spark, sf):
    return q.type_breakdown(reconciled(spark, sf))


@register("usability_verdict", f"""WITH {CTE_PARSES}, v AS (SELECT count(*) AS total, count(*) FILTER (type LIKE 'mcq%' AND options <> '' AND correct <> '') AS interactive,
  count(*) FILTER (box <> '' AND NOT self_graded) AS boxed, count(*) FILTER (self_graded) AS self_graded,
  count(*) FILTER (options = '' AND images = '' AND box = '' AND trim(explanation) = '') AS dead FROM items)
SELECT *, interactive + boxed AS drillable FROM v""")
def usability_verdict(spark, sf):
    return q.usability(reconciled(spark, sf))


@register("bank_problems", f"""WITH {CTE_PARSES}, p AS (
  SELECT id, 'empty options' AS rule, type AS detail FROM items WHERE type LIKE 'mcq%' AND NOT self_graded AND options = ''
  UNION ALL SELECT id, 'no answer key', '' FROM items WHERE type LIKE 'mcq%' AND NOT self_graded AND correct = ''
  UNION ALL SELECT id, 'key without option', '[' || CASE correct WHEN 'AB' THEN '''A'', ''B''' ELSE '''' || correct || '''' END || ']' FROM items WHERE type LIKE 'mcq%' AND NOT self_graded AND orphan
  UNION ALL SELECT id, 'nothing to reveal', '' FROM items WHERE self_graded AND images = '' AND trim(explanation) = ''
  UNION ALL SELECT id, 'unknown area', source FROM items WHERE source = 'b'
  UNION ALL SELECT id, 'empty stem', '' FROM items WHERE trim(stem) = ''
  UNION ALL SELECT id, 'missing id', '' FROM (SELECT unnest(range(1, (SELECT max(o_orderkey) + 1 FROM orders))) AS id) WHERE id NOT IN (SELECT id FROM items))
SELECT * FROM p""")
def bank_problems(spark, sf):
    """The reconciled bank against the row and set rules; the source label stands for the area.

    The bank is stored first: each family of rules reads it, and both parses are joined once.
    """
    items = stored(reconciled(spark, sf).withColumn("area", F.col("source")), "problems")
    return q.problems(items, ["a", "merged"], ad.table(spark, sf, "orders").agg(F.max("o_orderkey")))


@register("problem_status", f"WITH p AS ({ORACLES['bank_problems'].replace('WITH ' + CTE_PARSES, 'WITH ' + CTE_PARSES)}) SELECT rule, count(*) AS n FROM p GROUP BY 1")
def problem_status(spark, sf):
    """Problem count per rule: the figures behind a non-zero exit status."""
    return bank_problems(spark, sf).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@register("conflict_spot_check", f"WITH {CTE_PARSES} SELECT id, ca, cb FROM items WHERE conflict AND type = 'mcq-multi' ORDER BY id LIMIT 5")
def conflict_spot_check(spark, sf):
    d = F.col("disagreement")
    return q.spot_check(reconciled(spark, sf), d.isNotNull() & (F.col("type") == "mcq-multi"), ["id"]).select(
        "id", F.array_join(d["a"], "").alias("ca"), F.array_join(d["b"], "").alias("cb"))
