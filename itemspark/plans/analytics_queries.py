"""Readiness, session statistics, pacing and activity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspark.functions.scalars import clock, days_left, pacing_class, recency_words
from itemspark.operators import analytics as an
from itemspark.operators import progress as prog
from itemspark.operators.scans import by_time
from itemspark.plans import adapters as ad
from itemspark.plans.progress_queries import SITTING_STATE, sitting_state, ts, ts_sql
from itemspark.plans.selection_queries import bank, unique_bank

QUERIES: dict = {}
ORACLES: dict = {}

DEADLINE = "2001-09-17 00:00:00"
NOW = "2001-08-01 12:30:00"


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def deadline():
    return F.to_timestamp_ntz(F.lit(DEADLINE))


def now():
    return F.to_timestamp_ntz(F.lit(NOW))


AREAS = f"""{SITTING_STATE}, {ad.CTE_STRATA},
ub AS (SELECT * FROM bank WHERE item_id IN (SELECT min(item_id) FROM bank GROUP BY content_hash)),
counts AS (SELECT area, count(*) AS total, count(p.attempts) AS attempted, count(*) FILTER (p.last_correct) AS n_correct
  FROM ub LEFT JOIN progress p USING (item_id) GROUP BY 1),
rates AS (SELECT key AS area, label, weight, coalesce(total, 0) AS total, coalesce(attempted, 0) AS attempted,
  CASE WHEN coalesce(attempted, 0) = 0 THEN 0.0::DOUBLE ELSE n_correct / attempted END AS accuracy,
  CASE WHEN coalesce(total, 0) = 0 THEN 0.0::DOUBLE ELSE attempted / total END AS coverage FROM strata LEFT JOIN counts ON key = area),
areas AS (SELECT *, accuracy * (0.6::DOUBLE + 0.4::DOUBLE * coverage) AS score FROM rates)"""
RAG = "CASE WHEN score >= 0.75 THEN 'green' WHEN score >= 0.55 THEN 'amber' ELSE 'red' END"


def areas(spark, sf):
    return an.readiness(unique_bank(spark, sf), sitting_state(spark, sf), ad.PART_STRATA)


@register("readiness_by_area", f"""{AREAS}
SELECT area, label, round(weight, 6) AS weight, total, attempted, round(accuracy, 6) AS accuracy, round(coverage, 6) AS coverage,
  round(score, 6) AS score, {RAG} AS rag FROM areas""")
def readiness_by_area(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return areas(spark, sf).select("area", "label", r("weight"), "total", "attempted", r("accuracy"), r("coverage"), r("score"), "rag")


LEARNER_AREAS = f"""WITH {ad.CTE_ATTEMPTS}, {ad.CTE_STRATA},
state AS (SELECT learner, content_hash, arg_max(correct, event_id) AS last_correct FROM attempts GROUP BY ALL),
pool AS (SELECT p_type AS area, count(*) AS total FROM part GROUP BY 1),
seen AS (SELECT learner, p_type AS area, count(*) AS attempted, count(*) FILTER (last_correct) AS n_correct
  FROM state JOIN part ON p_partkey = CAST(content_hash AS BIGINT) GROUP BY ALL),
areas AS (SELECT learner, key AS area, label, weight, total, coalesce(attempted, 0) AS attempted,
   coalesce(n_correct / attempted, 0) AS accuracy, coalesce(attempted, 0) / total AS coverage,
   coalesce(n_correct / attempted, 0) * (0.6::DOUBLE + 0.4::DOUBLE * (coalesce(attempted, 0) / total)) AS score
 FROM (SELECT DISTINCT learner FROM state) CROSS JOIN strata JOIN pool ON pool.area = key LEFT JOIN seen USING (learner, area))"""


def learner_areas(spark, sf):
    items = ad.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("content_hash"), F.col("p_type").alias("area"))
    state = prog.progress(ad.attempts(spark, sf))
    return an.readiness(items, state, ad.PART_STRATA, "content_hash", ["learner"])


@register("readiness_by_learner", f"""{LEARNER_AREAS}
SELECT learner, area, total, attempted, round(score, 6) AS score, {RAG} AS rag FROM areas""")
def readiness_by_learner(spark, sf):
    return learner_areas(spark, sf).select("learner", "area", "total", "attempted", F.round("score", 6).alias("score"), "rag")


@register("readiness_rollup", f"""{SITTING_STATE}
SELECT area, subtopic, count(*) AS total, count(p.attempts) AS attempted, count(*) FILTER (p.last_correct) AS n_correct
FROM bank LEFT JOIN progress p USING (item_id) GROUP BY ROLLUP (area, subtopic)""")
def readiness_rollup(spark, sf):
    return an.readiness_rollup(bank(spark, sf), sitting_state(spark, sf)).select("area", "subtopic", "total", "attempted", "n_correct")


@register("projected_score", f"""{AREAS}
SELECT CAST(round(round(1000 * sum(weight * score), 6)) AS INTEGER) AS projected_score, round(round(1000 * sum(weight * score), 6)) >= 700 AS on_track,
  greatest(0, CAST(ceil(epoch_us(TIMESTAMP '{DEADLINE}' - TIMESTAMP '{NOW}') / 86400000000) AS BIGINT)) AS days_to_exam FROM areas""")
def projected_score(spark, sf):
    return an.projection(areas(spark, sf), deadline(), now())


@register("projected_score_by_learner", f"""{LEARNER_AREAS}
SELECT learner, CAST(round(round(1000 * sum(weight * score), 6)) AS INTEGER) AS projected_score FROM areas GROUP BY 1""")
def projected_score_by_learner(spark, sf):
    return an.projection(learner_areas(spark, sf), deadline(), now(), ["learner"]).select("learner", "projected_score")


NEXT = """best AS (SELECT {by} area, weight, total, attempted, accuracy, coverage,
  row_number() OVER ({part} ORDER BY weight * greatest(0.0::DOUBLE, 0.75::DOUBLE - score) DESC, total - attempted DESC, label) AS rn
  FROM areas WHERE weight * greatest(0.0::DOUBLE, 0.75::DOUBLE - score) > 0)
SELECT {by} 'drill' AS action, area, CASE WHEN total - attempted > 0 AND coverage < 0.5
  THEN CAST(round(weight * 100) AS INTEGER) || '% of the exam, ' || (total - attempted) || ' of ' || total || ' still unseen.'
  ELSE CAST(round(weight * 100) AS INTEGER) || '% of the exam, scoring ' || CAST(round(accuracy * 100) AS INTEGER) || '% on ' || attempted || ' attempted.' END AS detail
FROM best WHERE rn = 1"""


@register("next_action", f"{AREAS}, {NEXT.format(by='', part='')}")
def next_action(spark, sf):
    return an.next_action(areas(spark, sf))


@register("next_action_by_learner", f"{LEARNER_AREAS}, {NEXT.format(by='learner,', part='PARTITION BY learner')}")
def next_action_by_learner(spark, sf):
    return an.next_action(learner_areas(spark, sf), ["learner"])


@register("priority_table", f"""{LEARNER_AREAS}
SELECT learner, area, CAST(row_number() OVER (PARTITION BY learner ORDER BY weight * (1 - score) DESC, total - attempted DESC, label) AS INTEGER) AS place FROM areas""")
def priority_table(spark, sf):
    return an.priority_table(learner_areas(spark, sf), ["learner"]).select("learner", "area", "place")


TALLY = f"""WITH {ad.CTE_RESULTS}, {ad.CTE_STRATA},
tally AS (SELECT session_id, area, coalesce(weight, 0) AS weight, count(*) AS seen, count(*) FILTER (correct) AS n_correct, sum(elapsed_ms) AS elapsed_ms
  FROM results LEFT JOIN strata ON key = area GROUP BY ALL)"""


@register("session_scores", f"""{TALLY}, scores AS (
SELECT session_id, CAST(round(round(1000 * (sum(weight * (n_correct / seen)) / sum(weight)), 6)) AS INTEGER) AS score,
  round(round(1000 * (sum(weight * (n_correct / seen)) / sum(weight)), 6)) >= 700 AS passed, CAST(sum(seen) AS BIGINT) AS seen,
  CAST(sum(n_correct) AS BIGINT) AS n_correct, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms FROM tally GROUP BY 1)
SELECT o_orderkey AS session_id, coalesce(score, 0) AS score, coalesce(passed, false) AS passed, coalesce(seen, 0) AS seen, coalesce(n_correct, 0) AS n_correct,
  coalesce(elapsed_ms, 0) AS elapsed_ms FROM orders LEFT JOIN scores ON session_id = o_orderkey""")
def session_scores(spark, sf):
    """Every sitting, those without any result included."""
    return an.session_scores(ad.sitting_results(spark, sf), ad.PART_STRATA, sessions=ad.sittings(spark, sf))


@register("session_area_table", f"""{TALLY}
SELECT session_id, area, seen, n_correct, CAST(row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, area) AS INTEGER) AS place FROM tally""")
def session_area_table(spark, sf):
    return an.session_area_table(ad.sitting_results(spark, sf), ad.PART_STRATA).select("session_id", "area", "seen", "n_correct", "place")


@register("result_feed", f"""WITH {ad.CTE_RESULTS}
SELECT {ts_sql('o_orderdate').replace('AS o_orderdate', 'AS started_at')}, session_id, item_id, correct
FROM results JOIN orders ON o_orderkey = session_id""")
def result_feed(spark, sf):
    """Results of all sessions in (start, session, paper position) order."""
    s = ad.sittings(spark, sf).select("session_id", "started_at")
    return ad.sitting_results(spark, sf).join(s, "session_id").orderBy("started_at", "session_id", "item_id").select(
        ts("started_at"), "session_id", "item_id", "correct")


TOTALS = f"""WITH {ad.CTE_RESULTS},
rows AS (SELECT o_custkey AS learner, o_orderkey AS session_id, o_orderdate AS started_at, item_id, correct, elapsed_ms
  FROM orders LEFT JOIN results ON session_id = o_orderkey),
totals AS (SELECT learner, count(DISTINCT session_id) AS sessions, count(item_id) AS total_attempts, count(*) FILTER (correct) AS total_correct,
  count(DISTINCT CASE WHEN item_id IS NOT NULL THEN CAST(started_at AS DATE) END) AS active_days,
  max(CASE WHEN item_id IS NOT NULL THEN started_at END) AS last_studied_at, count(DISTINCT item_id) AS distinct_seen FROM rows GROUP BY 1)"""


def totals(spark, sf):
    return an.activity_totals(ad.sittings(spark, sf), ad.sitting_results(spark, sf), ["learner"])


@register("activity_totals", f"""{TOTALS}
SELECT learner, sessions, total_attempts, total_correct, active_days, distinct_seen, {ts_sql('last_studied_at')},
  CASE WHEN total_attempts = 0 THEN 0 ELSE round(total_correct / total_attempts, 6) END AS accuracy FROM totals""")
def activity_totals(spark, sf):
    return totals(spark, sf).select("learner", "sessions", "total_attempts", "total_correct", "active_days", "distinct_seen",
                                    ts("last_studied_at"), F.round("accuracy", 6).alias("accuracy"))


@register("study_pace", f"""{TOTALS}, d AS (SELECT *, (SELECT count(*) FROM part) - distinct_seen AS remaining, 47 AS days_left,
  CASE WHEN active_days = 0 THEN 0 ELSE total_attempts / active_days END AS rate FROM totals)
SELECT learner, remaining, CAST(days_left AS BIGINT) AS days_to_exam, round(rate, 6) AS attempts_per_day,
  CAST(ceil(remaining / days_left) AS BIGINT) AS required_per_day, remaining = 0 OR rate >= ceil(remaining / days_left) AS on_pace FROM d""")
def study_pace(spark, sf):
    n_items = ad.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n"))
    return an.pace(totals(spark, sf), n_items, deadline(), now()).select(
        "learner", "remaining", "days_to_exam", F.round("attempts_per_day", 6).alias("attempts_per_day"), "required_per_day", "on_pace")


@register("rolling_accuracy", f"""WITH {ad.CTE_ATTEMPTS},
r AS (SELECT learner, correct, row_number() OVER (PARTITION BY learner ORDER BY att DESC, event_id DESC) AS rn FROM attempts)
SELECT learner, count(*) AS n, round(count(*) FILTER (correct) / count(*), 6) AS rolling_accuracy FROM r WHERE rn <= 50 GROUP BY 1""")
def rolling_accuracy(spark, sf):
    return an.rolling_accuracy(ad.attempts(spark, sf), ["learner"], ["at", "event_id"]).withColumn("rolling_accuracy", F.round("rolling_accuracy", 6))


@register("rolling_accuracy_trace", f"""WITH {ad.CTE_ATTEMPTS}
SELECT learner, event_id, row_number() OVER w AS nth,
  round(avg(CAST(correct AS INTEGER)) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS rolling_accuracy
FROM attempts WINDOW w AS (PARTITION BY learner ORDER BY att, event_id)""")
def rolling_accuracy_trace(spark, sf):
    out = an.rolling_accuracy_trace(ad.attempts(spark, sf), ["learner"], ["at", "event_id"], by_time("at"))
    return out.select("learner", "event_id", "nth", F.round("rolling_accuracy", 6).alias("rolling_accuracy"))


DAILY = f"""{TOTALS}, daily AS (SELECT learner, strftime(started_at, '%Y-%m-%d') AS day, count(item_id) AS attempts, count(*) FILTER (correct) AS n_correct
  FROM rows GROUP BY ALL)"""


def daily(spark, sf):
    return an.daily_activity(ad.sittings(spark, sf), ad.sitting_results(spark, sf), ["learner"])


@register("daily_activity", f"{DAILY} SELECT *, attempts > 0 AS active FROM daily")
def daily_activity(spark, sf):
    return daily(spark, sf)


@register("recent_activity_bars", f"""{DAILY}, recent AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY day DESC) AS rn FROM daily)
SELECT learner, day, attempts, CAST(round(100 * attempts / greatest(max(attempts) OVER (PARTITION BY learner), 1)) AS INTEGER) AS height
FROM recent WHERE rn <= 14""")
def recent_activity_bars(spark, sf):
    return an.recent_bars(daily(spark, sf), ["learner"]).select("learner", "day", "attempts", "height")


@register("recency_words", f"""WITH last AS (SELECT c_custkey, max(o_orderdate) AS d FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
f AS (SELECT *, CAST(floor(epoch_us(TIMESTAMP '{NOW}' - d) / 86400000000) AS BIGINT) AS days FROM last)
SELECT c_custkey, CASE WHEN d IS NULL THEN 'never' WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' ELSE days || ' days ago' END AS words FROM f""")
def recency(spark, sf):
    last = ad.table(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("d"))
    c = ad.table(spark, sf, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", recency_words(F.col("d"), now()).alias("words"))


@register("dwell_times", f"""WITH {ad.CTE_ATTEMPTS},
gaps AS (SELECT session_id, content_hash, coalesce(least(greatest(date_diff('microsecond', att, lead(att) OVER (PARTITION BY session_id ORDER BY att, event_id)) // 1000, 0), 600000), 0) AS ms FROM attempts)
SELECT session_id, content_hash, CAST(sum(ms) AS BIGINT) AS dwell_ms, count(*) AS views FROM gaps GROUP BY ALL""")
def dwell_times(spark, sf):
    return an.dwell_times(ad.attempts(spark, sf), ["session_id"], "content_hash", "at", ["at", "event_id"], by_time("at"))


@register("pacing_counts", f"""WITH {ad.CTE_RESULTS}
SELECT session_id, count(*) FILTER (elapsed_ms <= 120000) AS ok, count(*) FILTER (elapsed_ms > 120000 AND elapsed_ms <= 240000) AS over,
  count(*) FILTER (elapsed_ms > 240000) AS risk FROM results GROUP BY 1""")
def pacing_counts(spark, sf):
    return an.pacing_counts(ad.sitting_results(spark, sf), ["session_id"])


@register("pacing_classes", f"""WITH {ad.CTE_RESULTS}
SELECT session_id, item_id, CASE WHEN elapsed_ms > 240000 THEN 'risk' WHEN elapsed_ms > 120000 THEN 'over' ELSE 'ok' END AS pace,
  (CAST(round(elapsed_ms / 1000) AS BIGINT) // 60) || ':' || lpad(CAST(CAST(round(elapsed_ms / 1000) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM results""")
def pacing_classes(spark, sf):
    return ad.sitting_results(spark, sf).select(
        "session_id", "item_id", pacing_class(F.col("elapsed_ms"), 120_000, 240_000).alias("pace"), clock(F.col("elapsed_ms")).alias("clock"))


# Answered rows of a sitting ended early: the row on screen when it ended was never advanced.
@register("early_ended_sessions", f"""WITH {ad.CTE_ATTEMPTS},
adv AS (SELECT *, lead(att) OVER (PARTITION BY session_id ORDER BY att, event_id) AS advanced_at FROM attempts)
SELECT session_id, count(*) AS kept FROM adv WHERE advanced_at IS NOT NULL GROUP BY 1""")
def early_ended_sessions(spark, sf):
    from itemspark.operators.scans import next_value
    from itemspark.streaming.attempts import keep_advanced
    rows = next_value(ad.attempts(spark, sf), ["session_id"], ["at", "event_id"], by_time("at"), F.col("at"), "advanced_at")
    return keep_advanced(rows).groupBy("session_id").agg(F.count(F.lit(1)).alias("kept"))


@register("defaulted_confidence", f"""WITH {ad.CTE_ATTEMPTS}
SELECT coalesce(confidence, 'unsure') AS confidence, correct, count(*) AS n FROM attempts GROUP BY ALL""")
def defaulted_confidence(spark, sf):
    from itemspark.streaming.attempts import with_default_confidence
    return with_default_confidence(ad.attempts(spark, sf)).groupBy("confidence", "correct").agg(F.count(F.lit(1)).alias("n"))


@register("days_left", f"""SELECT o_orderkey, greatest(0, CAST(ceil(epoch_us(o_orderdate - TIMESTAMP '1998-01-01 06:00:00') / 86400000000) AS BIGINT)) AS days FROM orders""")
def deadline_days(spark, sf):
    o = ad.table(spark, sf, "orders")
    return o.select("o_orderkey", days_left(F.col("o_orderdate"), F.to_timestamp_ntz(F.lit("1998-01-01 06:00:00"))).alias("days"))
