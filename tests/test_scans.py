import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from itemspark.operators import extract as ex
from itemspark.operators import scans


def data(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}", i, rng.randint(0, 9), rng.choice([None, f"v{i}"])) for i in range(500)]
    return spark.createDataFrame(rows, "k string, pos int, n int, v string").cache()


def test_chunked_scans_equal_plain_windows(spark):
    df = data(spark)
    w = Window.partitionBy("k").orderBy("pos")
    chunk = scans.by_position("pos", 7)
    plain = df.withColumns({"total": F.sum("n").over(w), "seen": F.last("v", True).over(w), "nxt": F.lead("n").over(w)})
    key = lambda r: r.pos
    want = sorted(plain.collect(), key=key)
    total = {r.pos: r.total for r in scans.running_totals(df, ["k"], ["pos"], chunk, {"total": F.col("n")}).collect()}
    seen = {r.pos: r.seen for r in scans.fill_forward(df, ["k"], ["pos"], chunk, F.col("v"), "seen").collect()}
    nxt = {r.pos: r.nxt for r in scans.next_value(df, ["k"], ["pos"], chunk, F.col("n"), "nxt").collect()}
    assert total == {r.pos: r.total for r in want}
    assert seen == {r.pos: r.seen for r in want}
    assert nxt == {r.pos: r.nxt for r in want}


def test_salted_lookup_equals_join(spark):
    df = data(spark)
    dim = df.groupBy("k").agg(F.count("*").alias("c")).filter(F.col("k") != "k3")
    for how in ("inner", "left"):
        a = sorted((r.pos, r.c) for r in scans.salted_lookup(df, dim, ["k"], how).collect())
        b = sorted((r.pos, r.c) for r in df.join(dim, "k", how).collect())
        assert a == b


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(5)
    segs = [(d, i, s, s + rng.randint(0, 90)) for d in range(3) for i, s in enumerate(rng.sample(range(900), 20))]
    spans = [(d, p, lo, lo + rng.randint(0, 300)) for d in range(3) for p, lo in enumerate(rng.sample(range(900), 10))]
    got = ex.overlap_join(spark.createDataFrame(segs, "doc_id int, id int, start int, end int"),
                          spark.createDataFrame(spans, "doc_id int, page int, lo int, hi int"), width=64)
    want = sorted((d, i, p) for d, i, s, e in segs for d2, p, lo, hi in spans if d == d2 and lo < e and hi >= s)
    assert sorted((r.doc_id, r.id, r.page) for r in got.collect()) == want


def test_block_lines_are_numbered_whatever_the_length(spark):
    lines = spark.createDataFrame([(1, i, f"l{i}") for i in range(25)] + [(2, 0, " "), (1, 25, " "), (1, 26, "last")], "owner int, para int, line string")
    got = sorted((r.owner, r.nth, r.line) for r in ex.block_lines(lines, ["owner"], "para", width=4).collect())
    assert got == [(1, i + 1, f"l{i}") for i in range(25)] + [(1, 26, "last")]


def test_next_value_keeps_a_null_that_follows(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, None), ("a", 2, 5), ("a", 3, None), ("a", 4, 7)], "k string, pos int, n int")
    got = {r.pos: r.nxt for r in scans.next_value(df, ["k"], ["pos"], scans.by_position("pos", 2), F.col("n"), "nxt").collect()}
    assert got == {0: None, 1: 5, 2: None, 3: 7, 4: None}


def test_medians_equal_percentile(spark):
    df = data(spark)
    want = {r.k: r.m for r in df.groupBy("k").agg(F.percentile("n", F.lit(0.5)).alias("m")).collect()}
    assert {r.k: r.m for r in scans.medians(df, ["k"], "n", width=3, name="m").collect()} == want


def test_offsets_of_many_pieces_cross_block_borders(spark):
    lengths = [(i * 7) % 13 for i in range(2503)]
    got = spark.createDataFrame([(lengths,), ([],)], "n array<int>").select(ex.starts_of(F.col("n"), gap=1).alias("x")).collect()
    want, at = [], 0
    for n in lengths:
        want.append(at)
        at += n + 1
    assert got[0].x == want and got[1].x == []


def test_document_with_many_markers(spark):
    text = "".join(f"Question: {i % 4000}\nbody {i}\n" for i in range(6000))
    rows = ex.segments(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert len(rows) == 4000 and all(r.body == text[r.start:r.end] == f"Question: {r.id}\nbody {r.id}\n" for r in rows)
