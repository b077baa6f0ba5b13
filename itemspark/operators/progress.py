"""Five-box review state: a sequential fold computed with aggregates and chunked scans.

A wrong answer sends an item to box 1. A correct one lifts it, but a correct guess lifts only from
box 1, and not twice running. From an empty record the box after a history depends only on the *run*
of attempts since the last wrong one: 1 if the run is empty, else min(5, 2 + non-guesses after the
run's first attempt). Runs of adjacent chunks concatenate, so chunk summaries combine by addition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemspark.functions.constants import BOX_INTERVAL_DAYS, MAX_BOX
from itemspark.operators.scans import by_time, medians

KEYS = ("learner", "content_hash")
ORDER = ("at", "event_id")


def is_guess() -> Column:
    return F.coalesce(F.col("confidence") == "guessed", F.lit(False))


def box_of_run(run_len: Column, non_guesses: Column, first_is_guess: Column) -> Column:
    """Box after a run that starts at box 1 behind a wrong answer or an empty record."""
    after_first = non_guesses - F.when(first_is_guess, 0).otherwise(1)
    return F.when(run_len == 0, F.lit(1)).otherwise(F.least(F.lit(MAX_BOX), F.lit(2) + after_first)).cast("int")


def box_from_seed(seed_box: Column, seed_guess: Column, run_len: Column, non_guesses: Column,
                  first_is_guess: Column) -> Column:
    """Box after an all-correct run on top of a stored record (box, last answer was a correct guess)."""
    start = F.least(F.lit(MAX_BOX), F.greatest(F.lit(1), F.round(seed_box)))
    stuck = F.least(F.lit(MAX_BOX), F.lit(1) + non_guesses)
    return (
        F.when(run_len == 0, start)
        .when(start >= 2, F.least(F.lit(MAX_BOX), start + non_guesses))
        .when(seed_guess, stuck)
        .otherwise(box_of_run(run_len, non_guesses, first_is_guess))
        .cast("int")
    )


def due_at(at: Column, box: Column) -> Column:
    days = F.element_at(F.create_map(*[F.lit(x) for kv in BOX_INTERVAL_DAYS.items() for x in kv]), box)
    return at + F.make_dt_interval(days)


def chunk_runs(attempts: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
               chunk: Column | None = None) -> DataFrame:
    """One summary row per key and chunk: the chunk's trailing all-correct run plus counters."""
    seq = F.struct(*order)
    rows = attempts.withColumn("_chunk", by_time(order[0]) if chunk is None else chunk).withColumn("_guess", is_guess())
    w = Window.partitionBy(*keys, "_chunk")
    rows = rows.withColumn("_lw", F.max(F.when(~F.col("correct"), seq)).over(w))
    in_run = F.col("_lw").isNull() | (seq > F.col("_lw"))
    last = F.struct(*order, "correct", F.col("confidence").alias("confidence"))
    return rows.groupBy(*keys, "_chunk").agg(
        F.bool_or(~F.col("correct")).alias("has_wrong"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("correct")).alias("wrongs"),
        F.count_if(in_run).alias("run_len"),
        F.count_if(in_run & ~F.col("_guess")).alias("run_sure"),
        F.min(F.when(in_run, F.struct(*order, F.col("_guess").alias("guess")))).alias("run_first"),
        F.max(last).alias("last"),
    )


def combine_runs(runs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The summaries of a key's chunks as one summary of the same form, chunks in the order of ``_chunk``."""
    across = Window.partitionBy(*keys)
    tail = runs.withColumn("_lwc", F.max(F.when(F.col("has_wrong"), F.col("_chunk"))).over(across))
    in_tail = F.col("_lwc").isNull() | (F.col("_chunk") >= F.col("_lwc"))
    has_run = in_tail & F.col("run_first").isNotNull()
    return tail.groupBy(*keys).agg(
        F.bool_or("has_wrong").alias("has_wrong"),
        F.sum("n").alias("n"),
        F.sum("wrongs").alias("wrongs"),
        F.sum(F.when(in_tail, F.col("run_len")).otherwise(0)).alias("run_len"),
        F.sum(F.when(in_tail, F.col("run_sure")).otherwise(0)).alias("run_sure"),
        F.min_by(F.when(has_run, F.col("run_first")), F.when(has_run, F.col("_chunk"))).alias("run_first"),
        F.max_by("last", "_chunk").alias("last"),
    )


def _named(runs: DataFrame) -> DataFrame:
    first = F.coalesce(F.col("run_first.guess"), F.lit(False))
    return runs.withColumnsRenamed({"n": "attempts", "wrongs": "times_wrong"}).withColumn("first_guess", first)


def state_of_runs(runs: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Review state from one summary per key, all its attempts being in that summary."""
    box = box_of_run(F.col("run_len"), F.col("run_sure"), F.col("first_guess"))
    return _finish(_named(runs).withColumn("box", box), keys, order)


def progress(attempts: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
             chunk: Column | None = None, seed: DataFrame | None = None) -> DataFrame:
    """State per key after folding all attempts: box, due_at, attempts, times_wrong, last verdict.

    ``seed`` (keys, box, due_at, attempts, times_wrong, last_correct, last_confidence, last_at) holds
    stored records; keys without new attempts are returned unchanged.
    """
    runs = combine_runs(chunk_runs(attempts, keys, order, chunk), keys)
    if seed is None:
        return state_of_runs(runs, keys, order)
    state = _named(runs)
    box = box_of_run(F.col("run_len"), F.col("run_sure"), F.col("first_guess"))
    old = seed.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in seed.columns if c not in keys])
    both = state.join(old, list(keys), "full_outer")
    old_guess = F.coalesce(F.col("_o_last_correct") & (F.col("_o_last_confidence") == "guessed"), F.lit(False))
    seeded = box_from_seed(F.coalesce("_o_box", F.lit(1)), old_guess, F.col("run_len"), F.col("run_sure"), F.col("first_guess"))
    new = _finish(
        both.filter(F.col("attempts").isNotNull())
        .withColumn("box", F.when(F.col("has_wrong"), box).otherwise(seeded))
        .withColumn("attempts", F.col("attempts") + F.coalesce("_o_attempts", F.lit(0)))
        .withColumn("times_wrong", F.col("times_wrong") + F.coalesce("_o_times_wrong", F.lit(0))), keys, order)
    kept = both.filter(F.col("attempts").isNull()).select(*keys, *[F.col(f"_o_{c}").alias(c) for c in new.columns if c not in keys])
    return new.unionByName(kept)


def _finish(state: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return state.select(
        *keys, "box", due_at(F.col(f"last.{order[0]}"), F.col("box")).alias("due_at"),
        F.col("attempts").cast("bigint").alias("attempts"), F.col("times_wrong").cast("bigint").alias("times_wrong"),
        F.col("last.correct").alias("last_correct"), F.col("last.confidence").alias("last_confidence"),
        F.col(f"last.{order[0]}").alias("last_at"))


def trajectory(attempts: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
               chunk: Column | None = None) -> DataFrame:
    """Every attempt with its box before and after."""
    chunk = by_time(order[0]) if chunk is None else chunk
    # State after each chunk: runs since the latest chunk with a wrong answer, added up.
    across = Window.partitionBy(*keys).orderBy("_chunk")
    upto = Window.partitionBy(*keys, "_seg").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    carry = (
        chunk_runs(attempts, keys, order, chunk)
        .withColumn("_seg", F.sum(F.col("has_wrong").cast("int")).over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_len", F.sum("run_len").over(upto))
        .withColumn("_sure", F.sum("run_sure").over(upto))
        .withColumn("_first", F.min("run_first").over(upto)["guess"])
        .select(*keys, "_chunk",
                F.coalesce(F.lag("_len").over(across), F.lit(0)).alias("_c_len"),
                F.coalesce(F.lag("_sure").over(across), F.lit(0)).alias("_c_sure"),
                F.lag("_first").over(across).alias("_c_first"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    run = Window.partitionBy(*keys, "_chunk", "_wc").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("correct")
    rows = (
        attempts.withColumn("_chunk", chunk)
        .withColumn("_guess", is_guess())
        .withColumn("_wc", F.sum((~ok).cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_len", F.sum(ok.cast("int")).over(run))
        .withColumn("_sure", F.sum((ok & ~F.col("_guess")).cast("int")).over(run))
        .withColumn("_first", F.first(F.when(ok, F.col("_guess")), ignorenulls=True).over(run))
        .join(carry, [*keys, "_chunk"])
    )
    open_run = F.col("_wc") == 0
    length = F.col("_len") + F.when(open_run, F.col("_c_len")).otherwise(0)
    sure = F.col("_sure") + F.when(open_run, F.col("_c_sure")).otherwise(0)
    first = F.coalesce(F.when(open_run, F.col("_c_first")), F.col("_first"), F.lit(False))
    entering = box_of_run(F.col("_c_len"), F.col("_c_sure"), F.coalesce("_c_first", F.lit(False)))
    return (
        rows.withColumn("box_after", box_of_run(length, sure, first))
        .withColumn("box_before", F.coalesce(F.lag("box_after").over(inside), entering))
        .select(*attempts.columns, "box_before", "box_after")
    )


def with_defaults(items: DataFrame, state: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Left-join stored state to items; an unseen item gets the empty record (box 1, no due date).

    Without any state all items are unseen and nothing is joined.
    """
    if state is None:
        return items.withColumns({"box": F.lit(1), "attempts": F.lit(0).cast("bigint"), "times_wrong": F.lit(0).cast("bigint"),
                                  "due_at": F.lit(None).cast("timestamp_ntz")})
    return items.join(state, list(keys), "left").withColumns({
        "box": F.coalesce("box", F.lit(1)),
        "attempts": F.coalesce("attempts", F.lit(0).cast("bigint")),
        "times_wrong": F.coalesce("times_wrong", F.lit(0).cast("bigint")),
    })


def is_due(as_of: Column) -> Column:
    """Unseen counts as due."""
    return F.col("due_at").isNull() | (F.col("due_at") <= as_of)


def has_been_attempted() -> Column:
    return F.coalesce(F.col("attempts") > 0, F.lit(False))


def due_list(items: DataFrame, state: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    return with_defaults(items, state, keys).filter(is_due(as_of))


def session_summary(moves: DataFrame, session: Sequence[str] = ("learner", "session_id")) -> DataFrame:
    """Promoted, reset, held, guessed, shaky and time per session from a trajectory."""
    ok = F.col("correct")
    promoted = F.count_if(ok & (F.col("box_after") > F.col("box_before")))
    reset = F.count_if(~ok)
    out = moves.groupBy(*session).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("n_correct"),
        promoted.alias("promoted"),
        reset.alias("reset"),
        (F.count(F.lit(1)) - promoted - reset).alias("held"),
        F.count_if(is_guess()).alias("guessed"),
        F.count_if(ok & (F.coalesce("confidence", F.lit("unsure")) != "confident")).alias("shaky"),
        F.sum("elapsed_ms").alias("elapsed_ms"),
        F.round(F.avg("elapsed_ms")).cast("bigint").alias("mean_ms"),
    )
    return out.join(medians(moves, list(session), "elapsed_ms", name="median_ms"), list(session), "left")
