import json

import pytest
from pyspark.sql import functions as F

from itemspark.sources import backup, readers

GOOD = dict(contentHash="h", box=4, dueAt=1700000000000, timesWrong=0, correction=None, notes="n",
            attempts=[dict(at=1, correct=True, confidence="unsure", selfGraded=False, elapsedMs=3)])
SESSION = dict(id="s", mode="drill", startedAt=5, finishedAt=None, results=[dict(contentHash="h", questionId=1, correct=True, confidence="unsure", skillArea="x", elapsedMs=2)])


def without(d, key):
    return {k: v for k, v in d.items() if k != key}


def test_envelope_guards(spark, tmp_path):
    progress = [GOOD, without(GOOD, "attempts"), {**GOOD, "box": 99}, without(GOOD, "contentHash"), {**GOOD, "box": 2.5}, {**GOOD, "correction": 5}, {**GOOD, "dueAt": "x"}, without(GOOD, "notes"), 7]
    sessions = [SESSION, without(SESSION, "results"), {**SESSION, "results": [{"contentHash": "h"}]}]
    (tmp_path / "ok.json").write_text(json.dumps(dict(version=1, exportedAt="t", progress=progress, sessions=sessions)))
    (tmp_path / "old.json").write_text(json.dumps(dict(version=2, progress=[], sessions=[])))
    (tmp_path / "broken.json").write_text("{")
    out = backup.read_envelope(spark, str(tmp_path))
    assert [(r.content_hash, r.box, r.notes) for r in out["progress"].collect()] == [("h", 4, "n")]
    assert out["attempts"].count() == 1 and [r.id for r in out["sessions"].collect()] == ["s"] and out["results"].count() == 1
    reasons = sorted(r.reason for r in out["quarantine"].collect())
    assert reasons == sorted(["no attempts", "bad box", "no key", "bad box", "bad correction", "bad due time", "bad notes", "not json",
                              "no results", "bad result", "not a version 1 backup", "not a version 1 backup"])
    lenient = backup.read_envelope(spark, str(tmp_path), strict=False)
    assert sorted(r.box for r in lenient["progress"].collect()) == [3, 4]


def test_documents_with_bad_bytes_and_media(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff end\nline")
    rows = readers.read_documents(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and "�" in rows[0].text and rows[0].text.endswith("line")
    m = readers.read_media(spark, str(tmp_path), "*.txt").first()
    assert m.length == 13 and len(m.digest) == 12 and m.too_small


def test_items_from_nested_json(spark, tmp_path):
    (tmp_path / "raw.json").write_text(json.dumps([dict(id=1, source="a", type="mcq-single", stem="s", options=[dict(key="A", text="x")], correct=["A"]), dict(id=2)]))
    rows = readers.read_items(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.id for r in rows] == [1, 2] and rows[0].options[0].text == "x"


def test_restore_follows_pointer_and_snapshot_repeats(spark, tmp_path):
    root = str(tmp_path / "r")
    for v in (1, 2):
        backup.restore(spark.range(v * 10).withColumn("v", F.lit(v)), root, v)
    assert backup.current(spark, root).count() == 20
    with pytest.raises(Exception):
        backup.restore(spark.range(1), root, 2)
    df = spark.range(100).withColumn("b", F.lit("x"))
    lines = []
    for n in ("a", "b"):
        backup.write_snapshot(df.repartition(3 if n == "a" else 5), str(tmp_path / n), ["id"])
        lines.append([x.value for x in spark.read.text(str(tmp_path / n)).orderBy("value").collect()])
    assert lines[0] == lines[1] and lines[0][0].startswith('{"b":"x","id":')
    assert backup.rows_digest(df).first() == backup.rows_digest(df.repartition(7)).first() != backup.rows_digest(df.limit(99)).first()


def test_scans_are_dealt_out_only_where_the_session_asks(spark):
    df, asked = spark.range(0, 100, 1, 1), spark.conf.get("spark.itemspark.scan.tasks")
    try:
        spark.conf.unset("spark.itemspark.scan.tasks")
        assert readers.dealt(df, "id") is df
        spark.conf.set("spark.itemspark.scan.tasks", "5")
        assert readers.dealt(df, "id").rdd.getNumPartitions() == 5
    finally:
        spark.conf.set("spark.itemspark.scan.tasks", asked)


def test_digest_sees_pairs_and_names_changed_ranges(spark):
    frame = lambda *x: spark.createDataFrame(list(x), "k bigint, v string")
    digest = lambda *x: tuple(backup.rows_digest(frame(*x)).first())
    assert digest((1, "a"), (1, "a")) != digest((1, "b"), (1, "b")) and digest((1, "a"), (2, "b")) == digest((2, "b"), (1, "a"))
    assert tuple(backup.rows_digest(frame((1, "a")).where("false")).first()) == (0, 0)
    old = frame((1, "a"), (2, "b"), (15, "c"), (25, "d"), (None, "n"))
    new = frame((2, "b"), (1, "a"), (15, "x"), (36, "e"), (None, "m"))
    got = sorted(tuple(r) for r in backup.changed_ranges(old, new, "k", 10).fillna(-9, ["range_id"]).collect())
    assert got == [(-9, 1, 1), (1, 1, 1), (2, 1, 0), (3, 0, 1)]
    assert backup.changed_ranges(old, old.repartition(3), "k", 10).isEmpty()
