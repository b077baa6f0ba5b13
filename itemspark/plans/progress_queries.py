"""Queries over the attempt feed: review state, trajectories, history merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspark.operators import history as hist
from itemspark.operators import progress as prog
from itemspark.operators.scans import by_time
from itemspark.plans import adapters as ad
from itemspark.session import work_dir
from itemspark.sources.stored import KeyedTable

QUERIES: dict = {}
ORACLES: dict = {}
TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def ts(c: str):
    return F.date_format(c, TS).alias(c)


def ts_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}"


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


EVENT_STATE = f"WITH {ad.CTE_ATTEMPTS}, {ad.cte_progress('attempts', 'learner, content_hash')}"


@register("review_state", f"""{EVENT_STATE}
SELECT learner, content_hash, box, attempts, times_wrong, last_correct, {ts_sql('due_at')} FROM progress""")
def review_state(spark, sf):
    return prog.progress(ad.attempts(spark, sf)).select(
        "learner", "content_hash", "box", "attempts", "times_wrong", "last_correct", ts("due_at"))


@register("review_state_per_item", f"""WITH {ad.CTE_ATTEMPTS}, {ad.cte_progress('attempts', 'content_hash')}
SELECT content_hash, box, attempts, times_wrong, last_correct, {ts_sql('due_at')} FROM progress""")
def review_state_per_item(spark, sf):
    """Few keys, very long histories: every key is hot."""
    return prog.progress(ad.attempts(spark, sf), ("content_hash",)).select(
        "content_hash", "box", "attempts", "times_wrong", "last_correct", ts("due_at"))


@register("review_state_resumed", ORACLES["review_state"])
def review_state_resumed(spark, sf):
    """Fold up to mid-month, store, then fold the rest on top: must equal one fold over everything."""
    feed = ad.attempts(spark, sf)
    cut = F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))
    stored = prog.progress(feed.filter(F.col("at") < cut))
    return prog.progress(feed.filter(F.col("at") >= cut), seed=stored).select(
        "learner", "content_hash", "box", "attempts", "times_wrong", "last_correct", ts("due_at"))


@register("review_trajectory", f"""WITH {ad.CTE_ATTEMPTS}, numbered AS (
  SELECT *, list({{'box': 0, 'ok': correct, 'g': coalesce(confidence = 'guessed', false)}}) OVER (
    PARTITION BY learner, content_hash ORDER BY att, event_id ROWS UNBOUNDED PRECEDING) AS h FROM attempts),
boxed AS (SELECT *, list_reduce(h, lambda s, e: {{'box': CASE WHEN NOT e.ok THEN 1
    WHEN e.g AND ((s.ok AND s.g) OR s.box >= 2) THEN s.box WHEN e.g THEN 2 ELSE least(5, s.box + 1) END,
    'ok': e.ok, 'g': e.g}}, {{'box': 1, 'ok': false, 'g': false}}).box AS box_after FROM numbered)
SELECT learner, content_hash, event_id, CAST(box_after AS INTEGER) AS box_after,
       CAST(coalesce(lag(box_after) OVER (PARTITION BY learner, content_hash ORDER BY att, event_id), 1) AS INTEGER) AS box_before
FROM boxed""")
def review_trajectory(spark, sf):
    return prog.trajectory(ad.attempts(spark, sf)).select("learner", "content_hash", "event_id", "box_before", "box_after")


SITTING_STATE = f"""WITH {ad.CTE_BANK}, {ad.CTE_RESULTS}, {ad.CTE_SITTING_ATTEMPTS},
{ad.cte_progress('sitting_attempts', 'item_id')}"""
SITTING_AS_OF = "2001-07-25 00:00:00"


def sitting_state(spark, sf):
    return prog.progress(ad.sitting_attempts(spark, sf), ("item_id",), chunk=by_time("at", "MONTH"))


def sitting_as_of():
    return F.to_timestamp_ntz(F.lit(SITTING_AS_OF))


@register("records_with_defaults", f"""{SITTING_STATE}
SELECT item_id, coalesce(box, 1) AS box, coalesce(attempts, 0) AS attempts, coalesce(times_wrong, 0) AS times_wrong,
       due_at IS NULL OR due_at <= TIMESTAMP '{SITTING_AS_OF}' AS due FROM bank LEFT JOIN progress USING (item_id)""")
def records_with_defaults(spark, sf):
    return prog.with_defaults(ad.item_bank(spark, sf), sitting_state(spark, sf), ["item_id"]).select(
        "item_id", "box", "attempts", "times_wrong", prog.is_due(sitting_as_of()).alias("due"))


@register("due_items", f"""{SITTING_STATE}
SELECT item_id, coalesce(box, 1) AS box FROM bank LEFT JOIN progress USING (item_id)
WHERE (due_at IS NULL OR due_at <= TIMESTAMP '{SITTING_AS_OF}')
  AND item_id IN (SELECT min(item_id) FROM bank GROUP BY content_hash)""")
def due_items(spark, sf):
    from itemspark.operators.selection import keep_first
    bank = keep_first(ad.item_bank(spark, sf), "content_hash", "item_id")
    return prog.due_list(bank, sitting_state(spark, sf), ["item_id"], sitting_as_of()).select("item_id", "box")


@register("last_verdicts", f"""WITH {ad.CTE_ATTEMPTS}
SELECT learner, content_hash, arg_max(correct, event_id) AS last_correct, true AS attempted FROM attempts GROUP BY ALL""")
def last_verdicts(spark, sf):
    return prog.progress(ad.attempts(spark, sf)).select(
        "learner", "content_hash", "last_correct", prog.has_been_attempted().alias("attempted"))


@register("session_moves", f"""WITH moves AS ({ORACLES['review_trajectory']}), {ad.CTE_ATTEMPTS}
SELECT learner, session_id, count(*) AS total, count(*) FILTER (correct) AS n_correct,
  count(*) FILTER (correct AND box_after > box_before) AS promoted, count(*) FILTER (NOT correct) AS reset,
  count(*) FILTER (correct AND box_after <= box_before) AS held,
  count(*) FILTER (coalesce(confidence = 'guessed', false)) AS guessed,
  count(*) FILTER (correct AND coalesce(confidence, 'unsure') <> 'confident') AS shaky,
  CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms, CAST(round(sum(elapsed_ms) / count(*)) AS BIGINT) AS mean_ms,
  quantile_cont(elapsed_ms, 0.5) AS median_ms
FROM attempts JOIN moves USING (learner, content_hash, event_id) GROUP BY ALL""")
def session_moves(spark, sf):
    return prog.session_summary(prog.trajectory(ad.attempts(spark, sf)))


# Two backups of one history: each device missed one kind of event.
def two_copies(spark, sf):
    feed = ad.attempts(spark, sf, keep=("event_type",))
    local = feed.filter(F.col("event_type") != "purchase").drop("event_type")
    incoming = feed.filter(F.col("event_type") != "click").drop("event_type")
    return local, incoming


def with_notes(state, correction, notes):
    return state.withColumn("correction", correction).withColumn("notes", notes)


def two_records(spark, sf):
    local, incoming = two_copies(spark, sf)
    own = F.when(F.col("times_wrong") > 1, F.concat(F.lit("local "), F.col("times_wrong").cast("string")))
    other = F.when(F.col("times_wrong") > 0, F.concat(F.lit("other "), F.col("attempts").cast("string")))
    l = with_notes(prog.progress(local), own, F.lit(None).cast("string"))
    i = with_notes(prog.progress(incoming), other, other)
    return local, incoming, l, i


TWO_COPIES = f"""WITH {ad.CTE_ATTEMPTS},
tagged AS (SELECT a.*, event_type FROM attempts a JOIN events USING (event_id)),
loc AS (SELECT * FROM tagged WHERE event_type <> 'purchase'), inc AS (SELECT * FROM tagged WHERE event_type <> 'click'),
{ad.cte_progress('loc', 'learner, content_hash', name='lp')}, {ad.cte_progress('inc', 'learner, content_hash', name='ip')},
lr AS (SELECT *, CASE WHEN times_wrong > 1 THEN 'local ' || times_wrong END AS correction, NULL::VARCHAR AS notes FROM lp),
ir AS (SELECT *, CASE WHEN times_wrong > 0 THEN 'other ' || attempts END AS correction,
              CASE WHEN times_wrong > 0 THEN 'other ' || attempts END AS notes FROM ip),
merged_attempts AS (SELECT * FROM loc UNION ALL SELECT * FROM inc i WHERE NOT EXISTS (
   SELECT 1 FROM loc l WHERE l.learner = i.learner AND l.content_hash = i.content_hash AND l.att = i.att)),
counts AS (SELECT learner, content_hash, count(*) AS attempts, count(*) FILTER (NOT correct) AS times_wrong FROM merged_attempts GROUP BY ALL),
merged AS (SELECT learner, content_hash,
  CASE WHEN l.box IS NULL OR i.last_at > l.last_at THEN i.box ELSE l.box END AS box,
  CASE WHEN l.box IS NULL OR i.last_at > l.last_at THEN i.due_at ELSE l.due_at END AS due_at,
  c.attempts, c.times_wrong, coalesce(l.correction, i.correction) AS correction, coalesce(l.notes, i.notes) AS notes
  FROM lr l FULL JOIN ir i USING (learner, content_hash) JOIN counts c USING (learner, content_hash))"""


@register("history_merge", f"""{TWO_COPIES}
SELECT learner, content_hash, box, {ts_sql('due_at')}, attempts, times_wrong, correction, notes FROM merged""")
def history_merge(spark, sf):
    local, incoming, l, i = two_records(spark, sf)
    merged = hist.merge_records(l, i, hist.merge_attempts(local, incoming))
    return merged.withColumn("due_at", ts("due_at"))


@register("history_import_outcomes", f"""{TWO_COPIES}
SELECT count(*) FILTER (NOT same) AS imported, count(*) FILTER (same) AS skipped FROM (
  SELECT coalesce(l.box = m.box AND l.due_at = m.due_at AND l.attempts = m.attempts AND l.times_wrong = m.times_wrong
     AND l.correction IS NOT DISTINCT FROM m.correction AND l.notes IS NOT DISTINCT FROM m.notes, false) AS same
  FROM ir JOIN merged m USING (learner, content_hash) LEFT JOIN lr l USING (learner, content_hash))""")
def history_import_outcomes(spark, sf):
    local, incoming, l, i = two_records(spark, sf)
    merged = hist.merge_records(l, i, hist.merge_attempts(local, incoming))
    return hist.import_counts(hist.import_outcomes(l, i, merged))


@register("history_replay", ORACLES["review_state"])
def history_replay(spark, sf):
    """The two copies together hold every attempt, so the replay equals the full fold."""
    local, incoming = two_copies(spark, sf)
    return hist.replay(hist.merge_attempts(local, incoming)).select(
        "learner", "content_hash", "box", "attempts", "times_wrong", "last_correct", ts("due_at"))


@register("session_import_and_save", """WITH days AS (
  SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, event_type, count(*) AS n FROM events GROUP BY ALL),
known AS (SELECT session_id, sum(n) AS n FROM days WHERE event_type <> 'purchase' GROUP BY 1),
inc AS (SELECT session_id, sum(n) AS n FROM days WHERE event_type <> 'click' GROUP BY 1)
SELECT 'import' AS rule, session_id, CAST(coalesce(k.n, i.n) AS BIGINT) AS n FROM known k FULL JOIN inc i USING (session_id)
UNION ALL SELECT 'save', session_id, CAST(coalesce(i.n, k.n) AS BIGINT) FROM known k FULL JOIN inc i USING (session_id)""")
def session_import_and_save(spark, sf):
    local, incoming = two_copies(spark, sf)
    known, inc = [d.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")) for d in (local, incoming)]
    return (hist.import_sessions(known, inc).withColumn("rule", F.lit("import"))
            .unionByName(hist.save_sessions(known, inc).withColumn("rule", F.lit("save"))))


@register("keyed_upsert", """SELECT user_id, CAST(k AS VARCHAR) AS k, event_id, event_type FROM (
  SELECT user_id, json_extract_string(props, '$.k') AS k, event_id, event_type,
         row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def keyed_upsert(spark, sf):
    ev = ad.table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"), "event_id", "event_type", "ts")
    cut = F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))
    out = hist.upsert(ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut), ["user_id", "k"], ["event_id"])
    return out.select("user_id", "k", "event_id", "event_type")


@register("stored_upsert", """SELECT user_id, CAST(k AS VARCHAR) AS k, event_id, event_type FROM (
  SELECT user_id, json_extract_string(props, '$.k') AS k, event_id, event_type,
         row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stored_upsert(spark, sf):
    """The same through a stored table: empty at first, then one upsert for each half."""
    ev = ad.table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"), "event_id", "event_type", "ts")
    cut = F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))
    keys = ["user_id", "k"]
    stored = KeyedTable(work_dir(spark, "keyed"), keys, ev.schema, buckets=16)
    stored.create(spark.createDataFrame([], ev.schema))
    stored.upsert(ev.filter(F.col("ts") < cut), ["event_id"])
    stored.upsert(ev.filter(F.col("ts") >= cut), ["event_id"])
    return stored.read(spark).select("user_id", "k", "event_id", "event_type")


@register("partial_patch", f"""{EVENT_STATE},
marks AS (SELECT user_id AS learner, json_extract_string(props, '$.k') AS content_hash, arg_max(event_type, event_id) AS t,
                 max(event_id) AS e FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL),
base AS (SELECT learner, content_hash, box, 'old ' || attempts AS notes FROM progress WHERE times_wrong > 0)
SELECT learner, content_hash, coalesce(b.box, 1) AS box, CASE m.t WHEN 'view' THEN 'seen ' || m.e WHEN 'click' THEN NULL ELSE b.notes END AS notes
FROM base b FULL JOIN marks m USING (learner, content_hash)""")
def partial_patch(spark, sf):
    """A last view writes a note, a last click clears it; pairs without a record get the default one."""
    feed = ad.attempts(spark, sf)
    base = prog.progress(feed).filter(F.col("times_wrong") > 0).select(
        "learner", "content_hash", "box", F.concat(F.lit("old "), F.col("attempts").cast("string")).alias("notes"))
    kind = ad.table(spark, sf, "events").filter(F.col("event_type").isin("view", "click"))
    marks = kind.groupBy(F.col("user_id").alias("learner"), F.get_json_object("props", "$.k").alias("content_hash")).agg(
        F.max(F.struct("event_id", "event_type")).alias("m")).select(
        "learner", "content_hash",
        F.when(F.col("m.event_type") == "view", F.concat(F.lit("seen "), F.col("m.event_id").cast("string"))).alias("notes"),
        F.lit(True).alias("notes_set"))
    return hist.patch(base, marks, ["learner", "content_hash"], ["notes"], {"box": 1})
