"""Sources and sinks: scans, guarded reads, dumps, restores, snapshots, media."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspark.operators import extract as ex
from itemspark.operators import progress as prog
from itemspark.plans import adapters as ad
from itemspark.plans.classify_queries import ORACLES as CLASSIFY_ORACLES
from itemspark.plans.classify_queries import review_queue
from itemspark.plans.progress_queries import EVENT_STATE, ts, ts_sql
from itemspark.plans.reconcile_queries import CTE_PARSES, reconciled
from itemspark.session import work_dir
from itemspark.sources import backup, readers

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


@register("document_scan", "SELECT doc_id, length(text) AS n, md5(text) AS text_md5 FROM documents")
def document_scan(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"), F.md5("text").alias("text_md5"))


@register("media_scan", """SELECT CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, true AS digests_hold, true AS sizes_hold FROM documents""")
def media_scan(spark, sf):
    """Documents written as files and scanned as binary media: all bytes, and what the scan says of them."""
    path = work_dir(spark, "media")
    ad.table(spark, sf, "documents").select("text").write.text(path)
    media = readers.read_media(spark, path, "part-*")
    return media.agg(F.sum("length").alias("n_bytes"), F.bool_and(F.col("digest") == F.substring(F.sha2("content", 256), 1, 12)).alias("digests_hold"),
                     F.bool_and(F.col("length") == F.octet_length("content")).alias("sizes_hold"))


@register("item_json_records", f"""WITH {CTE_PARSES} SELECT id, source, type, options, correct, images FROM items""")
def item_json_records(spark, sf):
    """The reconciled bank written as nested JSON and read back with the declared schema."""
    path = work_dir(spark, "items")
    reconciled(spark, sf).drop("disagreement").write.json(path)
    rows = readers.read_items(spark, path, multi_line=False)
    keys = F.array_join(F.transform("options", lambda o: o["key"]), "").alias("options")
    return rows.select("id", "source", "type", keys, F.array_join("correct", "").alias("correct"), F.array_join("images", "").alias("images"))


ROW_BITS = "CAST('0x' || left(md5(concat_ws(chr(31), o_custkey, strftime(o_orderdate, '%Y-%m-%d'), o_orderkey, o_orderpriority, o_orderstatus)), 15) AS BIGINT)"
DIGEST_SQL = f"SELECT count(*) AS n_rows, CAST(sum({ROW_BITS}) % 1152921504606846976 AS BIGINT) AS digest FROM orders"


@register("snapshot_changes", """SELECT CAST(o_orderkey // 100 AS BIGINT) AS range_id, count(*) AS rows_before, CAST(count_if(o_orderpriority <> '5-LOW' OR o_orderstatus <> 'P') AS BIGINT) AS rows_after
FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'P')""")
def snapshot_changes(spark, sf):
    """Ranges that differ after pending orders were closed, and those of low priority dropped."""
    o = ad.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    pending = F.col("o_orderstatus") == "P"
    after = o.where(~(pending & (F.col("o_orderpriority") == "5-LOW"))).withColumn("o_orderstatus", F.when(pending, "F").otherwise(F.col("o_orderstatus")))
    return backup.changed_ranges(o, after, "o_orderkey", 100)


@register("snapshot_digest", DIGEST_SQL)
def snapshot_digest(spark, sf):
    """Write a sorted snapshot, read it back and digest its rows."""
    o = ad.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    path = work_dir(spark, "snapshot")
    backup.write_snapshot(o, path, ["o_orderkey"])
    return backup.rows_digest(spark.read.schema("o_custkey bigint, o_orderdate string, o_orderkey bigint, o_orderpriority string, o_orderstatus string").json(path))


# Progress records as JSON text, one per order; price and status decide what is wrong with a record.
DEFECTS = [(10_000, "not json"), (30_000, "no key"), (60_000, "bad box"), (90_000, "bad due time"), (120_000, "bad wrong count"),
           (150_000, "no attempts"), (180_000, "bad attempt"), (210_000, "bad correction"), (240_000, "bad notes")]


def record_texts(spark, sf):
    o = ad.table(spark, sf, "orders")
    price = F.col("o_totalprice")
    hit = {name: (price < hi) & (price >= lo) for (hi, name), lo in zip(DEFECTS, [0, *[h for h, _ in DEFECTS]])}
    val = lambda name, bad, good: F.when(hit[name], F.lit(bad)).otherwise(F.lit(good) if isinstance(good, str) else good)
    raw = F.concat(
        F.lit('{'), val("no key", '"key":', '"contentHash":'), F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('","box":'),
        val("bad box", "99", "3"), F.lit(',"dueAt":'), val("bad due time", '"soon"', "1700000000000"), F.lit(',"timesWrong":'), val("bad wrong count", "null", "1"),
        F.lit(',"attempts":'), val("no attempts", '"none"', F.concat(F.lit('[{"at":1,"correct":true,"confidence":"unsure","selfGraded":false,"elapsedMs":5},{"at":2,"correct":false,"confidence":'),
                                                                     val("bad attempt", '"sure"', '"guessed"'), F.lit(',"selfGraded":false,"elapsedMs":7}]'))),
        F.lit(',"correction":'), val("bad correction", "5", "null"), val("bad notes", "", ',"notes":"n"'), val("not json", "", "}"))
    return o.select("o_orderkey", raw.alias("raw"))


@register("quarantined_records", f"""SELECT reason, count(*) AS n FROM (SELECT CASE {' '.join(f"WHEN o_totalprice < {hi} THEN '{name}'" for hi, name in DEFECTS)} ELSE 'good' END AS reason FROM orders) GROUP BY 1""")
def quarantined_records(spark, sf):
    good, bad = backup.split_records(record_texts(spark, sf), "raw", backup.progress_reason, backup.PROGRESS)
    sound = good.filter((F.col("record.box") == 3) & (F.size("record.attempts") == 2)).select(F.lit("good").alias("reason"))
    return sound.unionByName(bad.select("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


STATE_SCHEMA = "learner bigint, content_hash string, box int, due_at timestamp_ntz, attempts bigint, times_wrong bigint, last_correct boolean, last_confidence string, last_at timestamp_ntz"


@register("dumped_state", f"{EVENT_STATE} SELECT learner, content_hash, box, {ts_sql('due_at')}, attempts, times_wrong, last_correct FROM progress")
def dumped_state(spark, sf):
    path = work_dir(spark, "dump")
    backup.write_dump({"progress": prog.progress(ad.attempts(spark, sf))}, path)
    rows = backup.read_dump(spark, path, {"progress": STATE_SCHEMA})["progress"]
    return rows.select("learner", "content_hash", "box", ts("due_at"), "attempts", "times_wrong", "last_correct")


@register("restored_state", ORACLES["dumped_state"])
def restored_state(spark, sf):
    """Restore an older state, then the full one over it; readers follow the pointer to the second."""
    feed, root = ad.attempts(spark, sf), work_dir(spark, "restore")
    backup.restore(prog.progress(feed.filter(F.col("correct"))), root, 1)
    backup.restore(prog.progress(feed), root, 2)
    return backup.current(spark, root).select("learner", "content_hash", "box", ts("due_at"), "attempts", "times_wrong", "last_correct")


# A whole backup: review state, sittings and their results.
BACKUP_SCHEMAS = {
    "progress": STATE_SCHEMA, "sessions": "session_id bigint, learner bigint, started_at timestamp_ntz, mode string",
    "results": "session_id bigint, item_id bigint, area string, correct boolean, confidence string, elapsed_ms bigint"}


def backup_frames(spark, sf):
    return {"progress": prog.progress(ad.attempts(spark, sf)), "sessions": ad.sittings(spark, sf), "results": ad.sitting_results(spark, sf)}


def session_sums(frames):
    results = frames["results"].groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("n_correct"), F.sum("elapsed_ms").alias("elapsed_ms"))
    rows = frames["sessions"].join(results, "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.select("session_id", "learner", "mode", ts("started_at"), zero("n"), zero("n_correct"), zero("elapsed_ms"))


@register("dumped_sessions", f"""WITH {ad.CTE_RESULTS}, r AS (SELECT session_id, count(*) AS n, count(*) FILTER (correct) AS n_correct, CAST(sum(elapsed_ms) AS BIGINT) AS elapsed_ms FROM results GROUP BY 1)
SELECT o_orderkey AS session_id, o_custkey AS learner, o_orderpriority AS mode, {ts_sql('o_orderdate').replace('AS o_orderdate', 'AS started_at')},
  coalesce(n, 0) AS n, coalesce(n_correct, 0) AS n_correct, coalesce(elapsed_ms, 0) AS elapsed_ms FROM orders LEFT JOIN r ON session_id = o_orderkey""")
def dumped_sessions(spark, sf):
    """The whole state to JSON lines and back; every sitting with its results."""
    path = work_dir(spark, "dump")
    backup.write_dump(backup_frames(spark, sf), path)
    return session_sums(backup.read_dump(spark, path, BACKUP_SCHEMAS))


@register("restored_sessions", ORACLES["dumped_sessions"])
def restored_sessions(spark, sf):
    """A state without results, then the full one over it, all tables in one step."""
    frames, root = backup_frames(spark, sf), work_dir(spark, "restore")
    backup.restore_all({**frames, "results": frames["results"].filter(F.col("correct"))}, root, 1)
    backup.restore_all(frames, root, 2)
    return session_sums(backup.current_all(spark, root, list(frames)))


@register("written_review_queue", CLASSIFY_ORACLES["review_queue"])
def written_review_queue(spark, sf):
    path = work_dir(spark, "queue")
    backup.write_review_queue(review_queue(spark, sf), path)
    return spark.read.schema("doc_id bigint, opening string, top_scores string").json(path)


# Every document is a PNG-like medium: header with a size taken from its length, then its text.
def media_tables(spark, sf):
    d = ad.documents(spark, sf)
    big = F.when(F.col("lang") == "de", 100).otherwise(10)
    word = lambda n: F.lpad(F.hex(n.cast("bigint")), 8, "0")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(F.length("text")), word(big)))
    media = d.select(F.concat(F.lit("media/"), F.col("doc_id").cast("string"), F.lit(".PNG")).alias("path"), F.concat(head, F.encode("text", "UTF-8")).alias("content"))
    gone = F.col("n_chars") % 9 == 0
    refs = d.select(F.substring("source", 4, 9).cast("bigint").alias("owner"), F.col("doc_id").alias("pos"),
                    F.concat(F.lit("media/"), F.col("doc_id").cast("string"), F.when(gone, ".gone").otherwise(".PNG")).alias("path"))
    return refs, media


CTE_MEDIA = """refs AS (SELECT CAST(substr(source, 4) AS BIGINT) AS owner, doc_id AS pos, text, strlen(text) + 24 AS bytes,
  CASE WHEN n_chars % 9 = 0 THEN 'missing' WHEN strlen(text) + 24 < 600 THEN 'too_small' WHEN (strlen(text) + 24) / (length(text) * CASE WHEN lang = 'de' THEN 100 ELSE 10 END) < 0.02 THEN 'blank' END AS bad, lang = 'de' AS wide FROM documents),
firsts AS (SELECT *, row_number() OVER (PARTITION BY text, wide ORDER BY owner, pos) AS rn, first(owner) OVER (PARTITION BY text, wide ORDER BY owner, pos) AS fo, first(pos) OVER (PARTITION BY text, wide ORDER BY owner, pos) AS fp FROM refs WHERE bad IS NULL),
manifest AS (SELECT owner, pos, bad AS outcome, NULL::BIGINT AS fo, NULL::BIGINT AS fp, NULL AS text FROM refs WHERE bad IS NOT NULL
  UNION ALL SELECT owner, pos, CASE WHEN rn = 1 THEN 'kept' ELSE 'deduped' END, fo, fp, text FROM firsts)"""


def manifest(spark, sf):
    return ex.media_manifest(*media_tables(spark, sf), min_bytes=600)


@register("media_outcomes", f"WITH {CTE_MEDIA} SELECT owner, pos, outcome, fo AS first_owner, fp AS first_pos FROM manifest")
def media_outcomes(spark, sf):
    return manifest(spark, sf).select("owner", "pos", "outcome", "first_owner", "first_pos")


@register("media_counts", f"WITH {CTE_MEDIA} SELECT outcome, count(*) AS n FROM manifest GROUP BY 1")
def media_counts(spark, sf):
    return ex.media_counts(manifest(spark, sf))


@register("owner_media", f"""WITH {CTE_MEDIA}, own AS (SELECT owner, fo, fp, min(pos) AS pos FROM manifest WHERE fo IS NOT NULL GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY pos) AS place FROM own)
SELECT p.owner, p.pos, p.place, 'q' || f.owner || '-' || f.place || '.png' AS name FROM placed p JOIN placed f ON f.owner = p.fo AND f.pos = p.fp""")
def owner_media(spark, sf):
    return ex.owner_media(manifest(spark, sf)).select("owner", "pos", "place", "name")
