import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from itemspark.functions import text as t
from itemspark.functions.identity import content_hash
from itemspark.operators import extract as ex


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize("block,want", [
    ("Answer: AD", ["A", "D"]), ("Answer: A, D", ["A", "D"]), ("Answer:\nExplanation:\n", []), ("Answer:\n B\n", ["B"]), ("Answer: H", ["H"])])
def test_answer_key(spark, block, want):
    assert one(spark, block, t.answer_key) == want


def test_options_without_blank_and_duplicate_label(spark):
    got = one(spark, "Stem\nA.Text\nmore\nB. Other\nA.again\nC.last", lambda c: t.options_of(t.option_pieces(c)))
    assert [(o.key, o.text) for o in got] == [("A", "Text\nmore"), ("B", "Other"), ("C", "last")]


def test_slots_two_on_a_line_and_restated(spark):
    got = one(spark, "Box 2: two - Box 1: one\nBox 1: again", lambda c: t.numbered_slots(t.slot_statements(c)))
    assert [(b.box, b.answer) for b in got] == [(1, "one"), (2, "two")]


def test_wrapped_links(spark):
    assert one(spark, "see https://a.b/c\nd/e\nend", t.harvest_urls) == ["https://a.b/cd/eend"]
    assert one(spark, "https://a.b/c\nhttps://d.e/f", t.harvest_urls) == ["https://a.b/chttps://d.e/f"]
    apart = one(spark, "https://a.b/c\nhttps://d.e/f", lambda c: t.stitch_wrapped_urls(c, glue_adjacent=False))
    assert apart == "https://a.b/c\nhttps://d.e/f"


@pytest.mark.parametrize("glue", [True, False])
def test_stitching_equals_a_line_loop(spark, glue):
    rnd = random.Random(8)
    parts = ["https://a.b/c", " tail", "x/y", "two words", "", "http://d.e", "see https://f.g/h ", "-", "t\tu"]
    texts = ["\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(300)]

    def loop(text):
        out = []
        for line in (x.strip() for x in text.split("\n")):
            joins = out and line and " " not in line and re.search(r"https?://\S+$", out[-1])
            if joins and (glue or not re.match("https?://", line)):
                out[-1] += line
            else:
                out.append(line)
        return "\n".join(out)

    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", t.stitch_wrapped_urls(F.col("x"), glue)).collect()
    assert [r[1] for r in got] == [loop(r[0]) for r in got]


def block(spark, body, source="a"):
    return ex.extract_fields(spark.createDataFrame([(7, body)], "id bigint, body string"), source).first()


def test_page_break_before_heading_and_reference_before_explanation(spark):
    r = block(spark, "Question: 7\nStem?\nA.x\nB.y\nAnswer: A\n\fExplanation:\nBecause.\nReference:\nhttps://r.s/t\n")
    assert (r.stem, r.correct, r.explanation, r.refs, r.type) == ("Stem?", ["A"], "Because.", ["https://r.s/t"], "mcq-single")
    r = block(spark, "Question: 7\nStem\nAnswer: A\nReference:\nhttps://r.s/t\n\nExplanation:\nLong text")
    assert r.explanation == "Long text" and r.refs == ["https://r.s/t"]
    r = block(spark, "Question: 7\nStem\nAnswer: A\nSee https://only.tail/x")
    assert (r.explanation, r.refs) == ("", ["https://only.tail/x"])


def test_notes_and_confidence(spark):
    r = block(spark, "Question: 7\nStem\nA.x\nAnswer: H\n")
    assert r.parse_notes == ["answer key ['H'] has no matching option"] and r.parse_confidence == "low"
    r = block(spark, "Question: 7\nOld CDS and Common Data Service, CDS\nA.x\nAnswer: A\n")
    assert r.parse_confidence == "high" and len(r.parse_notes) == 1 and r.parse_notes[0].count("CDS") == 1
    r = block(spark, "Question: 7\nHOTSPOT -\nPick\nAnswer:\n")
    assert r.type == "hotspot" and r.parse_notes == ["no Box N: structure; will need self-grading against the image"]


def test_case_study(spark):
    r = block(spark, "Question: 7\nCase study -\nThis is a case study. Blah\n\nWorld.\n\nMore.\n\nWhat now?\nA.x\nAnswer: A")
    assert (r.background, r.stem) == ("World.\n\nMore.", "What now?")
    r = block(spark, "Question: 7\nThis is a case study. Blah\n\nOnly.\nA.x\nAnswer: A")
    assert r.background == "Only." and r.stem.startswith("This is a case study.")


def test_segments_first_wins_indented_and_offsets(spark):
    text = "front\n  Question: 1\na\nQuestion: 2\nb\nQuestion: 1\nlost\n"
    rows = ex.segments(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("start").collect()
    assert [(r.id, text[r.start:r.end]) for r in rows] == [(1, "  Question: 1\na\n"), (2, "Question: 2\nb\n")]
    assert all(r.body == text[r.start:r.end] for r in rows)


def test_segment_starting_at_a_page_end_counts_both_pages(spark):
    docs = spark.createDataFrame([(1, "ab\fcd")], "doc_id int, text string")
    spans = ex.page_spans(docs)
    assert [(r.lo, r.hi) for r in spans.orderBy("lo").collect()] == [(0, 2), (3, 5)]
    segs = spark.createDataFrame([(1, 9, 2, 5)], "doc_id int, id int, start int, end int")
    assert sorted(r.page for r in ex.overlap_join(segs, spans).collect()) == [1, 2]


def test_marker_over_runs(spark):
    runs = spark.createDataFrame([(1, 0, 0, "TXT", "Question:"), (1, 0, 1, "IMG", "rId1"), (1, 0, 2, "TXT", " 2"), (1, 1, 0, "TXT", "body")],
                                 "doc_id int, para int, run int, kind string, payload string")
    paras = ex.paragraphs_of_runs(runs)
    owned = ex.own_by_marker(paras).orderBy("para").collect()
    assert [(r.para, r.line, r.owner) for r in owned] == [(0, "Question: 2", 2), (1, "body", 2)]


def test_the_number_is_what_the_first_run_with_a_digit_shows(spark):
    texts = {0: ["Question: 1", "2"], 1: ["Quest", "ion:", " ", "34 x", "5"], 2: ["no marker", " here"], 3: ["Question: 7 Question: 8"]}
    runs = spark.createDataFrame([(1, p, i, "TXT", x) for p, parts in texts.items() for i, x in enumerate(parts)], "doc_id int, para int, run int, kind string, payload string")
    got = {r.para: (r.line, r.marker) for r in ex.paragraphs_of_runs(runs).collect()}
    assert got == {p: ("".join(parts), m) for (p, parts), m in zip(texts.items(), [1, 34, None, 7])}


def png(w, h, size):
    head = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", w, h)
    return head + bytes(size - len(head))


def test_media_outcomes_and_names(spark):
    media = spark.createDataFrame([("s", bytes(4096)), ("blank", png(1200, 900, 9216)), ("good.PNG", png(200, 150, 6000)), ("pic.jpeg", b"\xff\xd8" + bytes(7000)), ("copy", png(200, 150, 6000)), ("zero", png(0, 9, 6001))],
                                  "path string, content binary")
    refs = spark.createDataFrame([(1, 0, "s"), (1, 1, "blank"), (1, 2, "good.PNG"), (1, 3, "pic.jpeg"), (2, 0, "copy"), (2, 1, "gone"), (2, 2, "zero"), (2, 3, "good.PNG")], "owner int, pos int, path string")
    manifest = ex.media_manifest(refs, media).cache()
    got = {(r.owner, r.pos): r.outcome for r in manifest.collect()}
    assert got == {(1, 0): "too_small", (1, 1): "blank", (1, 2): "kept", (1, 3): "kept", (2, 0): "deduped", (2, 1): "missing", (2, 2): "kept", (2, 3): "deduped"}
    names = [(r.owner, r.place, r.name) for r in ex.owner_media(manifest).orderBy("owner", "place").collect()]
    assert names == [(1, 1, "q1-1.png"), (1, 2, "q1-2.jpeg"), (2, 1, "q1-1.png"), (2, 2, "q2-2.png")]


def test_hash_identity(spark):
    schema = "type string, stem string, options array<struct<key:string,text:string>>"
    rows = [("m", "What  Is\xa0it", [("A", "x")]), ("m", "what\nis it", [("A", "X")]), ("m", "what is it", [("A", "y")])]
    got = [r.h for r in spark.createDataFrame(rows, schema).select(content_hash(F.col("type"), F.col("stem"), F.col("options")).alias("h")).collect()]
    assert got[0] == got[1] != got[2] and len(got[0]) == 16


def test_hosts_and_languages(spark):
    assert one(spark, "https://www.Ex.com/a", t.host_of) == "ex.com" and one(spark, "not a url", t.host_of) == "not a url"
    assert one(spark, " <a></a>", t.code_language) == "xml"
    assert one(spark, "public sealed class A", t.code_language) == "csharp" and one(spark, "let x", t.code_language) == "javascript"


def test_an_option_body_is_cleaned_once(spark):
    assert str(t.options_of(F.col("p"))).count("{3,}") == 1
    text = "Stem\n" + "".join(f"{'ABCDEF'[i % 6]}.body {i}\n\n\n\nmore\n" for i in range(12))
    assert [(o["key"], o["text"]) for o in one(spark, text, lambda c: t.options_of(t.option_pieces(c)))] == [("ABCDEF"[i], f"body {i}\n\nmore") for i in range(6)]


def test_a_text_is_evaluated_once_however_often_a_rewrite_mentions_it(spark):
    df = spark.createDataFrame([(" a \n-\n\n\n\fb-\t",), (None,), ("",)], "text string")
    out = df.select(t.clean_block(F.upper("text")).alias("x"), t.legacy_notes(F.lower("text")).alias("y"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1 and plan.count("lower(") == 1
    assert [tuple(r) for r in out.collect()] == [("A\n\nB-", None), (None, None), ("", None)]


def test_second_source_notes_extract_no_more_than_they_tell(spark):
    from itemspark.plans.extract_queries import parse_notes_second_source
    plan = parse_notes_second_source(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "no answer key in DOCX text" in plan and "Reference[s]" not in plan


def test_two_parses_dealt_by_their_key_share_their_common_part(spark):
    body = "Question: {}\n-- HOTSPOT\nStem {}? Answer: inline\nA.x\nB.y\nAnswer:\nno key\nAnswer: C, A\n\fExplanation:\nCDS is old. Box 1: p - Box 2: q\n"
    blocks = spark.createDataFrame([(d, i, body.format(i, d)) for d in range(3) for i in range(20)], "doc_id int, id bigint, body string")
    on = ["doc_id", "id"]
    a, b = (ex.extract_fields(blocks, s, spread=on) for s in "ab")
    for got, source in ((a, "a"), (b, "b")):
        want = ex.extract_fields(blocks, source)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert a.first().correct == ["A", "C"]
    side = lambda df, tag: df.select(*on, F.struct(*[x for x in df.columns if x not in on]).alias(tag))
    joined = side(a, "a").join(side(b, "b").hint("merge"), on, "full_outer")
    joined.collect()
    final = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 1 and final.count("+- Exchange hashpartitioning") == 1
