"""Readiness, session statistics, pacing and activity.

Item attributes are joined only after attempts were reduced to one row per key, and rankings with a
fixed depth are written so that the optimizer can cut each task's rows before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.functions.scalars import days_left, rag
from itemspark.operators.scans import next_value, running_totals
from itemspark.operators.selection import Strata, sample_papers, strata_array, strata_frame


def area_score(accuracy: Column, coverage: Column) -> Column:
    return accuracy * (F.lit(k.COVERAGE_FLOOR) + F.lit(k.COVERAGE_SPAN) * coverage)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _mark(share: Column) -> Column:
    """Whole marks out of 1000. Rounding at 6 places first keeps exact halves independent of summing order."""
    return F.round(F.round(F.lit(1000) * share, 6))


def _scored(df: DataFrame) -> DataFrame:
    df = df.withColumns({
        "total": F.coalesce("total", F.lit(0).cast("bigint")),
        "attempted": F.coalesce("attempted", F.lit(0).cast("bigint")),
        "n_correct": F.coalesce("n_correct", F.lit(0).cast("bigint")),
    })
    df = df.withColumn("accuracy", _ratio(F.col("n_correct"), F.col("attempted")))
    df = df.withColumn("coverage", _ratio(F.col("attempted"), F.col("total")))
    df = df.withColumn("score", area_score(F.col("accuracy"), F.col("coverage")))
    return df.withColumn("rag", rag(F.col("score"), k.GREEN_FROM, k.AMBER_FROM))


def readiness(items: DataFrame, state: DataFrame, strata: Strata, key: str = "item_id",
              by: Sequence[str] = ()) -> DataFrame:
    """Per stratum: pool, attempted, accuracy of the latest answers, coverage, score, band.

    ``by`` splits the state (for example per learner); every group lists every stratum.
    """
    # One count per stratum of the literal table, looked up in a map: no join on a few area values.
    pool = items.filter(F.col("area").isin([s[0] for s in strata])).groupBy("area").agg(F.count(F.lit(1)).alias("total"))
    pool = pool.agg(F.map_from_entries(F.collect_list(F.struct("area", "total"))))
    seen = (
        state.select(*by, key, "attempts", "last_correct").filter(F.col("attempts") > 0)
        .join(items.select(key, "area"), key)
        .groupBy(*by, "area")
        .agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("last_correct")).alias("n_correct"))
    )
    if by:
        frame = state.select(*by).distinct().select(*by, F.inline(strata_array(strata)))
    else:
        frame = strata_frame(items, strata)
    frame = frame.withColumn("total", F.element_at(pool.scalar(), F.col("area")))
    return _scored(frame.join(seen, [*by, "area"], "left"))


def readiness_rollup(items: DataFrame, state: DataFrame, key: str = "item_id") -> DataFrame:
    """Readiness figures per subtopic, per area and in total."""
    rows = items.join(state.select(key, "attempts", "last_correct"), key, "left")
    return _scored(rows.rollup("area", "subtopic").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(F.col("attempts") > 0, F.lit(False))).alias("attempted"),
        F.count_if(F.coalesce(F.col("last_correct"), F.lit(False))).alias("n_correct")))


def projection(areas: DataFrame, deadline: Column, as_of: Column, by: Sequence[str] = ()) -> DataFrame:
    """Projected mark out of 1000, pass forecast, days left."""
    score = _mark(F.sum(F.col("weight") * F.col("score"))).cast("int")
    return areas.groupBy(*by).agg(score.alias("projected_score")).withColumns({
        "on_track": F.col("projected_score") >= k.PASS_MARK,
        "days_to_exam": days_left(deadline, as_of),
    })


def next_action(areas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The stratum where an hour buys most marks: weight times the shortfall to the target score."""
    value = F.col("weight") * F.greatest(F.lit(0.0), F.lit(k.TARGET_SCORE) - F.col("score"))
    best = F.min(F.when(value > 0, F.struct(
        (-value).alias("v"), (F.col("attempted") - F.col("total")).alias("u"), "label", "area", "weight", "total",
        "attempted", "accuracy", "coverage")))
    picked = areas.groupBy(*by).agg(F.sum("attempted").alias("_seen"), F.sum("total").alias("_pool"), best.alias("b"))
    gap = F.col("b.total") - F.col("b.attempted")
    share = F.round(F.col("b.weight") * 100).cast("int").cast("string")
    unseen = F.concat(share, F.lit("% of the exam, "), gap.cast("string"), F.lit(" of "), F.col("b.total").cast("string"), F.lit(" still unseen."))
    scoring = F.concat(share, F.lit("% of the exam, scoring "), F.round(F.col("b.accuracy") * 100).cast("int").cast("string"),
                       F.lit("% on "), F.col("b.attempted").cast("string"), F.lit(" attempted."))
    start = F.col("_seen") == 0
    return picked.select(
        *by,
        F.when(start, "start").when(F.col("b").isNull(), "full paper").otherwise("drill").alias("action"),
        F.when(~start, F.col("b.area")).alias("area"),
        F.when(start, F.concat(F.col("_pool").cast("string"), F.lit(" questions, none attempted.")))
        .when(F.col("b").isNull(), "Every area is at or above target.")
        .when((gap > 0) & (F.col("b.coverage") < 0.5), unseen).otherwise(scoring).alias("detail"))


def priority_table(areas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Strata ranked by weight times everything still missing (not the next-action quantity)."""
    w = Window.partitionBy(*by).orderBy(F.desc("value"), F.desc("unseen"), "label")
    rows = areas.withColumn("value", F.col("weight") * (F.lit(1) - F.col("score"))).withColumn("unseen", F.col("total") - F.col("attempted"))
    return rows.withColumn("place", F.row_number().over(w))


def session_scores(results: DataFrame, strata: Strata, session: str = "session_id", sessions: DataFrame | None = None) -> DataFrame:
    """Mark out of 1000 per sitting, weighted by stratum and renormalised over the strata asked.

    With ``sessions`` every sitting gets a row; one without results scores 0.
    """
    areas = session_areas(results, strata, session)
    total = F.sum("weight")
    scores = areas.groupBy(session).agg(
        F.when(total == 0, 0).otherwise(_mark(F.sum(F.col("weight") * (F.col("n_correct") / F.col("seen"))) / total))
        .cast("int").alias("score"),
        F.sum("seen").alias("seen"), F.sum("n_correct").alias("n_correct"), F.sum("elapsed_ms").alias("elapsed_ms"),
    )
    if sessions is not None:
        scores = sessions.select(session).distinct().join(scores, session, "left")
        scores = scores.withColumns({c: F.coalesce(c, F.lit(0).cast(scores.schema[c].dataType)) for c in scores.columns if c != session})
    return scores.withColumn("passed", F.col("score") >= k.PASS_MARK)


def session_areas(results: DataFrame, strata: Strata, session: str = "session_id") -> DataFrame:
    """Per sitting and stratum: asked, correct, weight (0 for an unknown stratum)."""
    tally = results.groupBy(session, "area").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("correct")).alias("n_correct"), F.sum("elapsed_ms").alias("elapsed_ms"))
    weights = F.element_at(F.map_from_arrays(F.array(*[F.lit(s[0]) for s in strata]), F.array(*[F.lit(float(s[4])) for s in strata])), F.col("area"))
    return tally.withColumn("weight", F.coalesce(weights, F.lit(0.0)))


def session_area_table(results: DataFrame, strata: Strata, session: str = "session_id") -> DataFrame:
    w = Window.partitionBy(session).orderBy(F.desc("weight"), "area")
    return session_areas(results, strata, session).withColumn("place", F.row_number().over(w))


def flatten_sessions(sessions: DataFrame) -> DataFrame:
    """Nested result lists to one row per result, in (start, session, position) order."""
    return sessions.select("id", "started_at", F.posexplode("results").alias("pos", "r")).select(
        F.col("id").alias("session_id"), "started_at", "pos", "r.*").orderBy("started_at", "session_id", "pos")


def activity_totals(sessions: DataFrame, results: DataFrame, by: Sequence[str], key: str = "item_id",
                    session: str = "session_id") -> DataFrame:
    """Sessions, attempts, correct, distinct items, active days and last study time per group."""
    per_session = results.groupBy(session).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("correct")).alias("_ok"))
    rows = sessions.select(*by, session, "started_at").join(per_session, session, "left")
    active = F.col("_n").isNotNull()
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_attempts"),
        F.coalesce(F.sum("_ok"), F.lit(0)).alias("total_correct"),
        F.countDistinct(F.when(active, F.to_date("started_at"))).alias("active_days"),
        F.max(F.when(active, F.col("started_at"))).alias("last_studied_at"),
    )
    distinct = results.select(session, key).join(sessions.select(*by, session), session).select(*by, key).distinct()
    seen = distinct.groupBy(*by).agg(F.count(F.lit(1)).alias("distinct_seen"))
    return base.join(seen, list(by), "left").withColumn("distinct_seen", F.coalesce("distinct_seen", F.lit(0).cast("bigint"))).withColumn(
        "accuracy", _ratio(F.col("total_correct"), F.col("total_attempts")))


def pace(totals: DataFrame, n_items: DataFrame, deadline: Column, as_of: Column) -> DataFrame:
    """Attempts per active day against what the remaining items need; ``n_items`` is a one-row count."""
    left = days_left(deadline, as_of)
    remaining = n_items.scalar() - F.col("distinct_seen")
    rows = totals.withColumn("remaining", remaining)
    remaining = F.col("remaining")
    rows = rows.withColumns({
        "days_to_exam": left,
        "attempts_per_day": _ratio(F.col("total_attempts"), F.col("active_days")),
        "required_per_day": F.when(left == 0, remaining).otherwise(F.ceil(remaining / left)).cast("bigint"),
    })
    return rows.withColumn("on_pace", (F.col("remaining") == 0) | (F.col("attempts_per_day") >= F.col("required_per_day")))


def rolling_accuracy(attempts: DataFrame, by: Sequence[str], order: Sequence[str], window: int = k.ROLLING_WINDOW) -> DataFrame:
    """Accuracy over each group's latest ``window`` attempts."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    recent = attempts.select(*by, *[c for c in order if c not in by], "correct").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= window)
    return recent.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("correct")) / F.count(F.lit(1))).alias("rolling_accuracy"))


def rolling_accuracy_trace(attempts: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column,
                           window: int = k.ROLLING_WINDOW) -> DataFrame:
    """Rolling accuracy at every attempt: difference of two running counts ``window`` attempts apart.

    The second count is fetched by an equi-join on (key, ordinal), which no hot key can skew.
    """
    rows = running_totals(attempts.select(*by, *[c for c in order if c not in by], "correct"), by, order, chunk,
                          {"nth": F.lit(1), "right": F.col("correct").cast("int")})
    before = rows.select(*by, (F.col("nth") + F.lit(window)).alias("nth"), F.col("right").alias("_before"))
    out = rows.join(before, [*by, "nth"], "left")
    hits = F.col("right") - F.coalesce("_before", F.lit(0))
    return out.select(*by, *[c for c in order if c not in by], "nth", (hits / F.least(F.col("nth"), F.lit(window))).alias("rolling_accuracy"))


def daily_activity(sessions: DataFrame, results: DataFrame, by: Sequence[str], session: str = "session_id") -> DataFrame:
    """Attempts and correct per day of session start; days with only empty sessions show zero."""
    per_session = results.groupBy(session).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("correct")).alias("_ok"))
    rows = sessions.select(*by, session, F.date_format(F.to_date("started_at"), "yyyy-MM-dd").alias("day")).join(per_session, session, "left")
    return rows.groupBy(*by, "day").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("attempts"), F.coalesce(F.sum("_ok"), F.lit(0)).alias("n_correct")
    ).withColumn("active", F.col("attempts") > 0)


def recent_bars(daily: DataFrame, by: Sequence[str], days: int = 14) -> DataFrame:
    """The latest buckets of each group, scaled to their peak (at least 1)."""
    w = Window.partitionBy(*by).orderBy(F.desc("day"))
    recent = daily.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= days).drop("_rn")
    peak = F.greatest(F.max("attempts").over(Window.partitionBy(*by)), F.lit(1))
    return recent.withColumn("height", F.round(F.lit(100) * F.col("attempts") / peak).cast("int"))


def dwell_times(views: DataFrame, session: Sequence[str], item: str, at: str, order: Sequence[str], chunk: Column,
                cap_ms: int = k.MAX_CARD_MS) -> DataFrame:
    """Time on each card: gap to the next navigation of the session, clamped to [0, cap], summed."""
    rows = next_value(views, session, order, chunk, F.col(at), "_next")
    gap = F.timestamp_diff("MILLISECOND", F.col(at), F.col("_next"))
    spent = F.coalesce(F.least(F.greatest(gap, F.lit(0)), F.lit(cap_ms)), F.lit(0))
    return rows.groupBy(*session, item).agg(F.sum(spent).alias("dwell_ms"), F.count(F.lit(1)).alias("views"))


def pacing_counts(results: DataFrame, by: Sequence[str], budget: int = k.MS_PER_QUESTION, risk: int = k.RISK_MS) -> DataFrame:
    ms = F.col("elapsed_ms")
    return results.groupBy(*by).agg(
        F.count_if(ms <= budget).alias("ok"), F.count_if((ms > budget) & (ms <= risk)).alias("over"), F.count_if(ms > risk).alias("risk"))


def sampling_fidelity(items: DataFrame, strata: Strata, n: int, n_seeds: int, key: str = "item_id") -> DataFrame:
    """Share of each stratum over many seeded papers against its weight, in percentage points."""
    papers = sample_papers(items, None, strata, n, n_seeds, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), key)
    drawn = papers.groupBy("area", "weight").agg(F.count(F.lit(1)).alias("drawn"))
    share = F.col("drawn") / F.sum("drawn").over(Window.partitionBy())
    return drawn.withColumn("share", share).withColumn("gap_pp", F.abs(F.col("share") - F.col("weight")) * 100)


def defect_counters(items: DataFrame) -> DataFrame:
    """Known limits of the bank: self-graded, flagged out of date, broken keys, dead ends."""
    from itemspark.functions.items import broken_key, is_dead_end

    return items.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("self_graded")).alias("self_graded"),
        F.count_if(F.col("currency") != "current").alias("not_current"),
        F.count_if(broken_key()).alias("broken_keys"), F.count_if(is_dead_end()).alias("dead_ends"))
