import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from itemspark.operators import history as hist
from itemspark.operators import progress as prog
from itemspark.operators.scans import by_position

DAYS = {1: 0, 2: 1, 3: 3, 4: 7, 5: 14}
T0 = datetime(2024, 1, 1)
SCHEMA = "content_hash string, at timestamp_ntz, event_id bigint, correct boolean, confidence string"


def step(box, prev, correct, confidence):
    """One attempt applied to a box the slow way; ``prev`` says the previous attempt was a correct guess."""
    guess = confidence == "guessed"
    if not correct:
        return 1, False
    if guess:
        return (box if prev or box >= 2 else 2), True
    return min(5, box + 1), False


def feed(spark, rows):
    return spark.createDataFrame([(k, T0 + timedelta(hours=h), i, ok, conf) for i, (k, h, ok, conf) in enumerate(rows)], SCHEMA)


def boxes(df):
    return {r.content_hash: r.box for r in df.collect()}


def test_five_correct_answers_climb_one_box_each(spark):
    rows = [(f"n{n}", h, True, "confident") for n in range(1, 6) for h in range(n)]
    assert boxes(prog.progress(feed(spark, rows), ("content_hash",))) == {"n1": 2, "n2": 3, "n3": 4, "n4": 5, "n5": 5}


def test_wrong_resets_and_is_due_at_once(spark):
    rows = [("a", 0, True, "confident"), ("a", 1, True, "confident"), ("a", 2, False, "confident")]
    r = prog.progress(feed(spark, rows), ("content_hash",)).first()
    assert (r.box, r.times_wrong, r.due_at) == (1, 1, T0 + timedelta(hours=2))


@pytest.mark.parametrize("seed_box,seed_guess,confs,want", [
    (1, False, ["guessed"], 2), (2, False, ["guessed"], 2), (3, False, ["guessed"], 3), (4, False, ["guessed"], 4),
    (1, True, ["guessed"], 1), (1, True, ["guessed", "guessed"], 1), (1, True, ["guessed", "unsure"], 2), (4, False, ["unsure", "confident"], 5)])
def test_guesses_on_seeded_records(spark, seed_box, seed_guess, confs, want):
    seed = spark.createDataFrame(
        [("a", seed_box, T0, 1, 0, True, "guessed" if seed_guess else "unsure", T0)],
        "content_hash string, box int, due_at timestamp_ntz, attempts bigint, times_wrong bigint, last_correct boolean, last_confidence string, last_at timestamp_ntz")
    rows = feed(spark, [("a", 5 + i, True, c) for i, c in enumerate(confs)])
    r = prog.progress(rows, ("content_hash",), seed=seed).first()
    assert (r.box, r.attempts) == (want, 1 + len(confs))


def test_random_histories_match_the_loop_in_state_trajectory_and_resumed_fold(spark):
    rng = random.Random(7)
    rows, want, path = [], {}, {}
    for k in range(300):
        box, prev = 1, False
        for h in sorted(rng.sample(range(60), rng.randint(1, 14))):
            ok, conf = rng.random() < 0.75, rng.choice(["guessed", "unsure", "confident"])
            before = box
            box, prev = step(box, prev, ok, conf)
            path[len(rows)] = (before, box)
            rows.append((f"k{k}", h, ok, conf))
        want[f"k{k}"] = box
    df = feed(spark, rows).cache()
    keys = ("content_hash",)
    assert boxes(prog.progress(df, keys)) == want
    by_day = F.date_trunc("DAY", F.col("at"))
    assert boxes(prog.progress(df, keys, chunk=by_day)) == want
    got = {r.event_id: (r.box_before, r.box_after) for r in prog.trajectory(df, keys, chunk=by_day).collect()}
    assert got == path
    cut = F.lit(T0 + timedelta(hours=30)).cast("timestamp_ntz")
    half = prog.progress(df.filter(F.col("at") < cut), keys)
    assert boxes(prog.progress(df.filter(F.col("at") >= cut), keys, seed=half)) == want


def test_due_after_fourteen_days_and_unseen_is_due(spark):
    rows = [("five", h, True, "confident") for h in range(5)]
    state = prog.progress(feed(spark, rows), ("content_hash",))
    items = spark.createDataFrame([("five",), ("new",)], "content_hash string")
    at = lambda days: F.lit(T0 + timedelta(hours=4, days=days)).cast("timestamp_ntz")
    names = lambda d: {r.content_hash for r in prog.due_list(items, state, ["content_hash"], at(d)).collect()}
    assert names(13) == {"new"} and names(14) == {"five", "new"}


RECORD = "content_hash string, box int, due_at timestamp_ntz, last_at timestamp_ntz, attempts bigint, times_wrong bigint, correction string, notes string"


def test_merge_takes_later_schedule_keeps_own_notes_and_is_idempotent(spark):
    keys = ("content_hash",)
    a = feed(spark, [("a", 0, False, "unsure")])
    b = feed(spark, [("a", 0, True, "unsure"), ("a", 9, True, "confident")])
    l = spark.createDataFrame([("a", 1, T0, T0, 1, 1, None, None)], RECORD)
    i = spark.createDataFrame([("a", 4, T0 + timedelta(days=7), T0 + timedelta(hours=9), 2, 0, "mine", "note")], RECORD)
    merged_attempts = hist.merge_attempts(a, b, keys)
    merged = hist.merge_records(l, i, merged_attempts, keys)
    r = merged.first()
    assert (r.box, r.attempts, r.times_wrong, r.correction, r.notes) == (4, 2, 1, "mine", "note")
    assert hist.import_counts(hist.import_outcomes(l, i, merged, keys)).first()[:] == (1, 0)
    stored = merged.withColumn("last_at", F.lit(T0 + timedelta(hours=9)).cast("timestamp_ntz"))
    again = hist.merge_records(stored, i, hist.merge_attempts(merged_attempts, b, keys), keys)
    assert hist.import_counts(hist.import_outcomes(stored, i, again, keys), 2).first()[:] == (0, 3)
    assert sorted(hist.merge_attempts(a, a, keys).collect()) == sorted(a.collect())


def test_patch_sets_clears_and_creates(spark):
    base = spark.createDataFrame([("a", 3, "x"), ("b", 2, "y")], "k string, box int, notes string")
    change = spark.createDataFrame([("a", None, True), ("b", "z", False), ("c", "new", True)], "k string, notes string, notes_set boolean")
    got = {r.k: (r.box, r.notes) for r in hist.patch(base, change, ["k"], ["notes"], {"box": 1}).collect()}
    assert got == {"a": (3, None), "b": (2, "y"), "c": (1, "new")}


def test_upsert_last_write_wins(spark):
    a = spark.createDataFrame([("a", 1, "old"), ("b", 1, "b")], "k string, v int, x string")
    b = spark.createDataFrame([("a", 2, "new")], "k string, v int, x string")
    assert {r.k: r.x for r in hist.upsert(a, b, ["k"], ["v"]).collect()} == {"a": "new", "b": "b"}


def test_hot_key_in_one_chunk_per_position(spark):
    """One key holds every row and every row is its own chunk."""
    rows = feed(spark, [("hot", h, h % 5 != 0, "unsure") for h in range(200)])
    r = prog.progress(rows, ("content_hash",), chunk=by_position("event_id", 1)).first()
    assert (r.box, r.attempts, r.times_wrong) == (5, 200, 40)
