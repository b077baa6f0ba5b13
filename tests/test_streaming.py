"""Additive stream state: replays, bases and a stream that begins anew give what the batch fold gives."""

import random

from pyspark.sql import functions as F

from itemspark.operators import progress as prog
from itemspark.streaming import attempts as st

SCHEMA = "learner int, content_hash string, event_id int, at timestamp_ntz, correct boolean, confidence string"


def feed(spark, n=400):
    rng = random.Random(4)
    rows = [(rng.randrange(4), f"h{rng.randrange(5)}", i, rng.random() < 0.7, rng.choice(["guessed", "unsure", "confident"])) for i in range(n)]
    df = spark.createDataFrame([(a, b, i, None, c, d) for a, b, i, c, d in rows], SCHEMA)
    return df.withColumn("at", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("event_id") * 7))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("learner", "content_hash", "box", "due_at", "attempts", "times_wrong", "last_correct", "last_confidence", "last_at").collect())


def parts(df, n=7):
    return [df.filter((F.col("event_id") >= 60 * k) & (F.col("event_id") < 60 * (k + 1))) for k in range(n)]


def test_batches_bases_and_replays_add_up_to_the_fold(spark, tmp_path):
    df = feed(spark)
    sink = st.fold_batches(str(tmp_path), every=3)
    for epoch, part in enumerate(parts(df)):
        sink(part, epoch)
        if epoch in (1, 2, 5):
            sink(part, epoch)  # the same batch once more, after a failure
    assert [x for x in st._folders(spark, f"{tmp_path}/base")] == ["upto=2", "upto=5"]
    assert rows_of(st.folded(spark, str(tmp_path))) == rows_of(prog.progress(df))


def test_a_stream_with_another_checkpoint_goes_on(spark, tmp_path):
    df = feed(spark)
    pieces = parts(df)
    try:
        for query, batches in (("first", pieces[:4]), ("second", pieces[4:])):
            spark.sparkContext.setLocalProperty("sql.streaming.queryId", query)
            sink = st.fold_batches(str(tmp_path))
            for epoch, part in enumerate(batches):
                sink(part, epoch)
    finally:
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    assert rows_of(st.folded(spark, str(tmp_path))) == rows_of(prog.progress(df))


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    df = feed(spark)
    sink = st.fold_batches(str(tmp_path), every=100)
    pieces = parts(df)
    for epoch, part in enumerate([*pieces[:6], pieces[6].filter("learner = 0 and content_hash = 'h1'").limit(1)]):
        sink(part, epoch)
    last = spark.read.parquet(f"{tmp_path}/batches/{st._folders(spark, f'{tmp_path}/batches')[0]}/epoch=6")
    assert last.count() <= 1


def test_session_sums(spark, tmp_path):
    df = feed(spark).withColumn("session_id", F.concat_ws("-", "learner", F.to_date("at")))
    sink = st.sum_sessions(str(tmp_path), every=2)
    for epoch, part in enumerate(parts(df)):
        sink(part, epoch)
    got = sorted(tuple(r) for r in sink.read(spark).select("learner", "session_id", "n", "n_correct", "last_event").collect())
    want = df.groupBy("learner", "session_id").agg(F.count("*"), F.count_if("correct"), F.max("event_id")).collect()
    assert got == sorted(tuple(r) for r in want)
