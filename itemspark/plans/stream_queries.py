"""Streaming queries over the attempt feed, each compared with its batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspark.plans import adapters as ad
from itemspark.plans.progress_queries import ORACLES as PROGRESS_ORACLES
from itemspark.plans.progress_queries import ts
from itemspark.session import work_dir
from itemspark.sources.backup import NUMBER, _is, _reason
from itemspark.streaming import attempts as st
from itemspark.streaming import keyed
from itemspark.streaming import windows as win

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


CUTS = ["2024-01-10 08:00:00", "2024-01-21 20:00:00"]


def run_slices(spark, sf, build, sink, order=(0, 1, 2), mode="append", again=False):
    """Land the feed in three time slices; after each, the stream resumes from its checkpoint and catches up.

    ``again`` lands every slice a second time, in a batch of its own.
    """
    root = work_dir(spark, "feed")
    feed = ad.attempts(spark, sf).withColumn("at", F.col("at").cast("timestamp"))
    for i in order:
        part = feed if i == 0 else feed.filter(F.col("at") >= F.to_timestamp(F.lit(CUTS[i - 1])))
        part = part if i == len(CUTS) else part.filter(F.col("at") < F.to_timestamp(F.lit(CUTS[i])))
        for _ in range(1 + again):
            part.write.mode("append").parquet(f"{root}/landing")
            stream = spark.readStream.schema(feed.schema).parquet(f"{root}/landing")
            st.run_to_end(build(stream), root, sink(root), mode)
    return root


def keep_batches(root):
    return lambda batch, epoch: batch.write.mode("overwrite").parquet(st.version_path(root, epoch))


def state_columns(df):
    return df.select("learner", "content_hash", "box", "attempts", "times_wrong", "last_correct", ts("due_at"))


@register("stream_once_per_position", """SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, event_id, count(*) AS n FROM events GROUP BY ALL""")
def stream_once_per_position(spark, sf):
    """Every advance is posted four times, once more in the batch after its own; one attempt of each survives."""
    noisy = lambda s: s.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumnRenamed("event_id", "pos")
    root = run_slices(spark, sf, lambda s: st.once_per_position(noisy(s), delay="60 days"), keep_batches, again=True)
    return spark.read.parquet(f"{root}/state").groupBy("session_id", F.col("pos").alias("event_id")).agg(F.count(F.lit(1)).alias("n"))


@register("stream_review_state", PROGRESS_ORACLES["review_state"])
def stream_review_state(spark, sf):
    root = run_slices(spark, sf, lambda s: s, st.fold_batches)
    return state_columns(st.folded(spark, root))


@register("stream_review_state_keyed", PROGRESS_ORACLES["review_state"])
def stream_review_state_keyed(spark, sf):
    """The fold as keyed state of the engine, one summary per key and day, dropped when the day is over."""
    with keyed.state_store(spark):
        root = run_slices(spark, sf, keyed.keyed_runs, keyed.keep_changes, mode="update")
    return state_columns(keyed.folded_changes(spark, root))


@register("stream_sessions", """SELECT user_id AS learner, user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, count(*) AS n,
  count(*) FILTER (event_type <> 'error') AS n_correct, max(event_id) AS last_event FROM events GROUP BY ALL""")
def stream_sessions(spark, sf):
    root = run_slices(spark, sf, lambda s: s, st.sum_sessions)
    return st.sum_sessions(root).read(spark).select("learner", "session_id", "n", "n_correct", "last_event")


@register("stream_daily_activity", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS attempts, count(*) FILTER (event_type <> 'error') AS n_correct FROM events GROUP BY 1")
def stream_daily_activity(spark, sf):
    root = run_slices(spark, sf, st.daily_counts, keep_batches, mode="complete")
    return st.latest(spark, root).select("day", "attempts", "n_correct")


@register("stream_ended_sittings", """WITH gaps AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sitting FROM gaps)
SELECT user_id AS learner, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_at, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_correct
FROM numbered GROUP BY user_id, sitting HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def stream_ended_sittings(spark, sf):
    """Sittings that end by two hours without an attempt; those still open at the last watermark stay in the state."""
    root = run_slices(spark, sf, win.sittings_by_gap, keep_batches)
    return spark.read.parquet(f"{root}/state").select("learner", ts("started_at"), ts("last_at"), "n", "n_correct")


@register("stream_days_updated", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS learner, count(*) AS attempts, count(*) FILTER (event_type <> 'error') AS n_correct FROM events GROUP BY ALL")
def stream_days_updated(spark, sf):
    """Learners' days, emitted whenever they grow; the state holds the days still open, the table all of them."""
    root = run_slices(spark, sf, lambda s: win.open_days(s, ["learner"]), win.day_table, mode="update")
    return win.days(spark, root, ["learner"])


@register("stream_days_over", """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS attempts, count(*) FILTER (event_type <> 'error') AS n_correct FROM events
GROUP BY 1 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def stream_days_over(spark, sf):
    """Each day once, when it is over."""
    root = run_slices(spark, sf, win.open_days, keep_batches)
    return spark.read.parquet(f"{root}/state").select("day", "attempts", "n_correct")


@register("stream_late_keys_replayed", PROGRESS_ORACLES["review_state"])
def stream_late_keys_replayed(spark, sf):
    """The middle slice comes last: keys it brings late attempts for are replayed, all others take theirs on top."""
    schema = ad.attempts(spark, sf).withColumn("at", F.col("at").cast("timestamp")).schema
    sink = lambda root: win.LateReplay(root, schema, buckets=16)
    root = run_slices(spark, sf, lambda s: s, sink, (0, 2, 1))
    return state_columns(sink(root).read(spark))


@register("stream_late_attempts_replayed", PROGRESS_ORACLES["review_state"])
def stream_late_attempts_replayed(spark, sf):
    """Slices arrive last first; the stored attempts are replayed by event time."""
    root = run_slices(spark, sf, lambda s: s, st.store_attempts, (2, 0, 1))
    return state_columns(st.replay_store(spark, root))


@register("stream_quarantine", """SELECT reason, count(*) AS n FROM (SELECT CASE event_type WHEN 'signup' THEN 'not json' WHEN 'error' THEN 'no key' WHEN 'click' THEN 'bad time' ELSE 'good' END AS reason FROM events) GROUP BY 1""")
def stream_quarantine(spark, sf):
    """Events as raw JSON lines, three kinds of them damaged."""
    root = work_dir(spark, "raw")
    ev = ad.table(spark, sf, "events")
    kind = F.col("event_type")
    line = F.concat(F.lit("{"), F.when(kind == "error", F.lit('"key":')).otherwise(F.lit('"user":')), F.col("user_id").cast("string"), F.lit(',"at":'),
                    F.when(kind == "click", F.lit('"noon"')).otherwise(F.col("event_id").cast("string")), F.when(kind == "signup", F.lit("")).otherwise(F.lit("}")))
    ev.select(line.alias("value")).write.text(f"{root}/landing")
    reason = lambda v: _reason([("not json", v.isNotNull()), ("no key", _is(v, "$.user", NUMBER)), ("bad time", _is(v, "$.at", NUMBER))])
    sink = st.split_sinks(root, "value", reason, lambda df: df.select(F.from_json("value", "user bigint, at bigint").alias("r")).select("r.*"))
    st.run_to_end(spark.readStream.text(f"{root}/landing"), root, sink)
    good = spark.read.parquet(f"{root}/good").filter(F.col("user").isNotNull() & F.col("at").isNotNull()).select(F.lit("good").alias("reason"))
    bad = spark.read.parquet(f"{root}/quarantine").select("reason")
    return good.unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
