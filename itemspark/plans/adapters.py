"""Views of the driver's tables in the shape the operators expect. Every view reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.functions.identity import content_hash
from itemspark.sources.readers import dealt

# Weights of the six part types, heaviest first (the published shape: one at 13/38, five at 5/38).
PART_STRATA = [
    ("ECONOMY", "Economy", 10, 15, 5 / 38), ("LARGE", "Large", 10, 15, 5 / 38),
    ("MEDIUM", "Medium", 10, 15, 5 / 38), ("PROMO", "Promo", 10, 15, 5 / 38),
    ("SMALL", "Small", 10, 15, 5 / 38), ("STANDARD", "Standard", 30, 35, 13 / 38),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` for the text-heavy queries."""
    return dealt(table(spark, sf_dir, "documents"), "doc_id")


def attempts(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The attempt feed: one row per event, with the event columns to ``keep``. A sitting is a learner's day."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("learner"),
        F.concat_ws("-", "user_id", F.to_date("ts")).alias("session_id"),
        "event_id",
        F.get_json_object("props", "$.k").alias("content_hash"),
        F.col("ts").alias("at"),
        (kind != "error").alias("correct"),
        F.when(kind == "view", "guessed").when(kind == "click", "unsure")
        .when(kind.isin("purchase", "signup"), "confident").alias("confidence"),
        (kind == "signup").alias("self_graded"),
        F.round(F.col("value") * 1000).cast("bigint").alias("elapsed_ms"),
        *keep,
    )


def item_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item bank: one row per part, with the key the attempts name and a content hash."""
    size = F.col("p_size")
    kind = F.when(size > 40, "hotspot").when(size > 30, "mcq-multi").otherwise("mcq-single")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_type").alias("area"),
        F.col("p_brand").alias("subtopic"),
        kind.alias("type"),
        (size > 45).alias("self_graded"),
        F.col("p_name").alias("stem"),
        content_hash(kind, F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_size")).alias("content_hash"),
    )


def sittings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of one learner each: one row per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("learner"),
        F.col("o_orderdate").alias("started_at"),
        F.col("o_orderpriority").alias("mode"),
    )


def sitting_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results per session and item, with the item's area; paper order is the item id."""
    lines = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("item_id")
    ).agg(
        (F.max("l_returnflag") != "R").alias("correct"),
        F.max("l_quantity").alias("_q"),
        F.max("l_linestatus").alias("_s"),
    )
    area = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("area"))
    return lines.join(area, "item_id").select(
        "session_id", "item_id", "area", "correct",
        F.when(F.col("_s") == "F", "guessed").when(F.col("_q") > 25, "confident").otherwise("unsure").alias("confidence"),
        (F.col("_q") * 6000).cast("bigint").alias("elapsed_ms"),
    )


def sitting_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results as one attempt history per item, ordered by sitting date then session."""
    s = sittings(spark, sf_dir).select("session_id", F.col("started_at").alias("at"))
    return sitting_results(spark, sf_dir).join(s, "session_id").withColumnRenamed("session_id", "event_id")


# The same views as DuckDB common table expressions, for the oracles.
CTE_ATTEMPTS = """attempts AS (
  SELECT user_id AS learner, user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, event_id,
         json_extract_string(props, '$.k') AS content_hash, ts AS att, event_type <> 'error' AS correct,
         CASE event_type WHEN 'view' THEN 'guessed' WHEN 'click' THEN 'unsure' WHEN 'purchase' THEN 'confident'
              WHEN 'signup' THEN 'confident' END AS confidence,
         event_type = 'signup' AS self_graded, CAST(round(value * 1000) AS BIGINT) AS elapsed_ms
  FROM events)"""

CTE_BANK = """bank AS (
  SELECT *, left(sha256(lower(trim(regexp_replace(type || chr(1) || p_name || ' ' || subtopic || ' ' || area || ' ' || p_size, '\\s+', ' ', 'g')))), 16) AS content_hash
  FROM (SELECT p_partkey AS item_id, p_type AS area, p_brand AS subtopic, p_name, p_size, p_name AS stem,
               CASE WHEN p_size > 40 THEN 'hotspot' WHEN p_size > 30 THEN 'mcq-multi' ELSE 'mcq-single' END AS type,
               p_size > 45 AS self_graded FROM part))"""

CTE_RESULTS = """results AS (
  SELECT session_id, item_id, p_type AS area, correct,
         CASE WHEN s = 'F' THEN 'guessed' WHEN q > 25 THEN 'confident' ELSE 'unsure' END AS confidence,
         CAST(q * 6000 AS BIGINT) AS elapsed_ms
  FROM (SELECT l_orderkey AS session_id, l_partkey AS item_id, max(l_returnflag) <> 'R' AS correct,
               max(l_quantity) AS q, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2)
  JOIN part ON p_partkey = item_id)"""

CTE_STRATA = """strata(key, label, lo, hi, weight) AS (VALUES
  ('ECONOMY', 'Economy', 10, 15, CAST(5 AS DOUBLE) / 38), ('LARGE', 'Large', 10, 15, CAST(5 AS DOUBLE) / 38),
  ('MEDIUM', 'Medium', 10, 15, CAST(5 AS DOUBLE) / 38), ('PROMO', 'Promo', 10, 15, CAST(5 AS DOUBLE) / 38),
  ('SMALL', 'Small', 10, 15, CAST(5 AS DOUBLE) / 38), ('STANDARD', 'Standard', 30, 35, CAST(13 AS DOUBLE) / 38))"""

# Sequential replay of the review state, one attempt at a time.
_STEP = """list_reduce(list({{'box': 0, 'ok': correct, 'g': coalesce(confidence = 'guessed', false)}} ORDER BY {order}),
  lambda s, e: {{'box': CASE WHEN NOT e.ok THEN 1
                            WHEN e.g AND ((s.ok AND s.g) OR s.box >= 2) THEN s.box
                            WHEN e.g THEN 2 ELSE least(5, s.box + 1) END, 'ok': e.ok, 'g': e.g}},
  {{'box': 1, 'ok': false, 'g': false}}).box"""

_DAYS = "CASE box WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 7 ELSE 14 END"


def cte_progress(source: str, keys: str, order: str = "att, event_id", name: str = "progress") -> str:
    return f"""{name} AS (
  SELECT *, last_at + to_days({_DAYS}) AS due_at FROM (
    SELECT {keys}, CAST({_STEP.format(order=order)} AS INTEGER) AS box, count(*) AS attempts,
           count(*) FILTER (NOT correct) AS times_wrong, max(att) AS last_at,
           arg_max(correct, ({order})) AS last_correct, last(confidence ORDER BY {order}) AS last_confidence
    FROM {source} GROUP BY {keys}))"""


CTE_SITTING_ATTEMPTS = """sitting_attempts AS (
  SELECT r.*, r.session_id AS event_id, o_orderdate AS att FROM results r JOIN orders ON o_orderkey = session_id)"""
