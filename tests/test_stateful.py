"""Stored tables by bucket, and streams whose state leaves: sittings, days, keyed folds, late keys."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from itemspark.operators import history as hist
from itemspark.operators import progress as prog
from itemspark.sources.stored import KeyedTable, written_counting
from itemspark.streaming import attempts as st
from itemspark.streaming import keyed
from itemspark.streaming import windows as win

SCHEMA = "learner int, content_hash string, event_id int, minute int, correct boolean, confidence string"
STATE = ("learner", "content_hash", "box", "due_at", "attempts", "times_wrong", "last_correct", "last_confidence", "last_at")


def feed(spark, rows):
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("minute"))
    return spark.createDataFrame(rows, SCHEMA).withColumn("at", at).drop("minute").coalesce(1)


def history(spark, n=300, step=31, seed=5):
    rng = random.Random(seed)
    return feed(spark, [(rng.choice([1, 1, 1, 2, None]), f"h{rng.randrange(3)}", i, i * step, rng.random() < 0.7,
                         rng.choice(["guessed", "unsure", "confident", None])) for i in range(n)])


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*STATE).collect()), key=str)


def run(spark, root, parts, build, sink, mode="append"):
    """Each part lands as a file and is a batch of its own, the stream stopping and resuming in between."""
    done = None
    for part in parts:
        part.write.mode("append").parquet(f"{root}/landing")
        done = st.run_to_end(build(spark.readStream.schema(part.schema).parquet(f"{root}/landing")), root, sink, mode)
    return done


def files(root):
    return {p.relative_to(root).as_posix() for p in Path(root).rglob("*.parquet")}


def test_an_upsert_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    base = spark.range(400).select("id", F.lit(0).alias("version"), F.lit("old").alias("note"))
    stored = KeyedTable(str(tmp_path / "t"), ["id"], base.schema, buckets=16)
    stored.create(base)
    before = files(stored.root)
    change = spark.createDataFrame([(7, 1, "new"), (1000, 1, "new"), (7, 0, "stale")], base.schema)
    for _ in range(2):  # a repeated change changes nothing more
        touched = stored.upsert(change, ["version"])
    assert 1 <= len(touched) <= 2
    changed = {f.split("/")[0] for f in before ^ files(stored.root)}
    assert changed == {f"_bucket={b}" for b in touched}
    want = hist.upsert(base, change, ["id"], ["version"])
    assert sorted(map(tuple, stored.read(spark).collect())) == sorted(map(tuple, want.collect()))


def test_a_patch_of_a_stored_table(spark, tmp_path):
    schema = "id long, k string, box int, note string"
    base = spark.createDataFrame([(1, "a", 3, "x"), (2, "b", 2, "y"), (3, "c", 5, None)], schema)
    stored = KeyedTable(str(tmp_path / "t"), ["id", "k"], base.schema, buckets=4)
    stored.create(base)
    change = spark.createDataFrame([(1, "a", None, True), (2, "b", "z", False), (9, "n", "w", True)], "id long, k string, note string, note_set boolean")
    stored.patch(change, ["note"], {"box": 1})
    assert sorted(map(tuple, stored.read(spark).collect())) == [(1, "a", 3, None), (2, "b", 2, "y"), (3, "c", 5, None), (9, "n", 1, "w")]
    assert stored.upsert(base.filter("false").withColumn("version", F.lit(1)), ["version"]) == []


def test_counters_of_the_pass_that_writes(spark, tmp_path):
    rows = spark.range(50).withColumn("odd", F.col("id") % 2 == 1)
    counters = [F.count(F.lit(1)).alias("n"), F.count_if("odd").alias("odd"), F.max("id").alias("last")]
    for k, (frame, want) in enumerate([(rows, (50, 25, 49)), (rows.filter("id < 0"), (0, 0, None)), (rows.filter("false"), (0, 0, None))]):
        got = written_counting(frame, str(tmp_path / str(k)), counters)
        assert [tuple(r) for r in got.collect()] == [want]
        assert spark.read.parquet(str(tmp_path / str(k))).count() == want[0]


def test_only_the_buckets_asked_for_are_scanned(spark, tmp_path):
    base = spark.range(100).select("id", F.lit(0).alias("version"))
    stored = KeyedTable(str(tmp_path / "t"), ["id"], base.schema, buckets=8)
    stored.create(base)
    plan = stored.read(spark, [3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "PushedFilters: []" in plan


def test_sittings_end_by_themselves_and_late_attempts_reopen_nothing(spark, tmp_path):
    minutes = [[0, 50, 60, 400], [2000, 2010], [55, 4000], [9000]]
    parts = [feed(spark, [(1, "h", 10 * k + i, m, i != 1, None) for i, m in enumerate(ms)]) for k, ms in enumerate(minutes)]
    query = run(spark, str(tmp_path), parts, lambda s: win.sittings_by_gap(s), lambda b, e: b.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={e}"))
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("started_at")
    first = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    minute = lambda c: ((F.unix_seconds(c) - F.unix_seconds(first)) / 60).cast("int")
    got = [tuple(r) for r in got.select("learner", minute("started_at"), minute("last_at"), "n", "n_correct").collect()]
    assert got == [(1, 0, 60, 3, 2), (1, 400, 400, 1, 1), (1, 2000, 2010, 2, 1), (1, 4000, 4000, 1, 0)]
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # the open one


def test_days_leave_the_state_and_stay_in_the_table(spark, tmp_path):
    parts = [feed(spark, [(x, "h", 100 * d + i, d * 1440 + 60 * i, i % 3 > 0, None) for i in range(9) for x in (1, None)]) for d in range(8)]
    held = []
    for part in parts:
        query = run(spark, str(tmp_path), [part], lambda s: win.open_days(s, ["learner"]), win.day_table(str(tmp_path)), "update")
        held.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert max(held) <= 2 * 2  # two learners, two open days
    got = sorted((tuple(r) for r in win.days(spark, str(tmp_path), ["learner"]).collect()), key=str)
    assert got == sorted(((f"2024-01-0{d + 1}", x, 9, 6) for d in range(8) for x in (1, None)), key=str)


@pytest.mark.parametrize("chunk", ["day", "hour"])
def test_keyed_state_equals_the_fold_and_is_dropped_when_over(spark, tmp_path, chunk):
    df = history(spark)
    parts = [df.filter((F.col("event_id") >= a) & (F.col("event_id") < a + 100)) for a in (0, 100, 200)]
    with keyed.state_store(spark):
        query = run(spark, str(tmp_path), parts, lambda s: keyed.keyed_runs(s, chunk=chunk, shards=2), keyed.keep_changes(str(tmp_path)), "update")
    assert rows_of(keyed.folded_changes(spark, str(tmp_path))) == rows_of(prog.progress(df))
    # 300 attempts span six and a half days; the state has what the last day and a half of them need.
    held = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    seen = spark.read.parquet(f"{tmp_path}/changes").select("learner", "content_hash", "_chunk").distinct().count()
    assert held < seen


def test_keyed_summary_of_one_key():
    rows = [(1, 1, True, True, "guessed"), (2, 2, False, False, None), (3, 3, True, False, "unsure"), (4, 4, True, True, "guessed")]
    whole = keyed.folded_summary(None, iter(rows))
    assert whole == keyed.folded_summary(keyed.folded_summary(None, iter(rows[:2])), iter(rows[2:]))
    assert whole == (True, 4, 1, 2, 1, 3, 3, False, 4, 4, True, "guessed")


def test_late_keys_are_replayed_and_batches_may_run_twice(spark, tmp_path):
    df = history(spark, 240)
    sink = win.LateReplay(str(tmp_path / "s"), df.schema, buckets=4)
    cut = lambda a, b: df.filter((F.col("event_id") >= a) & (F.col("event_id") < b))
    timeless = df.filter("event_id = 10").withColumn("event_id", F.lit(999)).withColumn("at", F.lit(None).cast("timestamp"))
    parts = [cut(0, 60), cut(120, 180), cut(60, 120).filter("content_hash = 'h1'"), cut(60, 120), cut(180, 240), df.filter("false"), timeless]
    for epoch, part in enumerate(parts):
        sink(part, epoch)
        if epoch % 2:
            sink(part, epoch)
        if epoch == 4:
            assert rows_of(sink.read(spark)) == rows_of(prog.progress(df))
    assert rows_of(sink.read(spark)) == rows_of(prog.progress(df.unionByName(timeless)))


def test_a_replay_scans_the_buckets_of_late_keys(spark, tmp_path):
    df = history(spark, 60)
    sink = win.LateReplay(str(tmp_path / "s"), df.schema, buckets=8)
    sink(df, 0)
    plan = sink.stored(spark, [2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "(_bucket" in plan


def test_trips_to_the_store_follow_the_shards_not_the_keys():
    import pandas as pd

    class Store:
        def __init__(self):
            self.rows, self.trips = [], 0

        def get(self):
            return iter(list(self.rows))

        def appendList(self, rows):
            self.rows += rows
            self.trips += 1

        def clear(self):
            self.rows, self.trips = [], self.trips + 1

    class Handle:
        def getListState(self, name, schema):
            return store

        def listTimers(self):
            return iter([1])

    store, runs = Store(), keyed.Runs(["learner"])
    runs.init(Handle())
    feed_of = lambda ids, at: iter([pd.DataFrame([(0, 7, 9, name, None, at, i, True, False, "unsure") for i, name in enumerate(ids)])])
    names = [None, *map(str, range(2_499))]
    newest = {}
    for batch, ids in enumerate([names, names[:3], names, names]):
        (out,) = runs.handleInputRows((0, 7, 9), feed_of(ids, batch), None)
        newest |= {row[0]: (row[1], row[3]) for row in out.itertuples(index=False)}
        assert len(out) == len(ids) and len(store.rows) <= 2 * len(names)
    assert store.trips <= 12
    assert newest == {name: (7, 4 if name in names[:3] else 3) for name in names}
