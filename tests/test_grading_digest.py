import pytest
from pyspark.sql import functions as F

from itemspark.functions import digest as d
from itemspark.operators import digest as dg
from itemspark.operators import grading as g

ITEM = ("id int, type string, self_graded boolean, options array<struct<key:string,text:string>>, correct array<string>, boxes array<struct<box:int,answer:string>>, "
        "images array<string>, explanation string, kind string, keys array<string>, box_values array<string>, verdict string")
OPTS = [("A", "a"), ("B", "b"), ("C", "c")]


def graded(spark, **kw):
    base = dict(id=1, type="mcq-multi", self_graded=False, options=OPTS, correct=["A", "B"], boxes=[], images=[], explanation="e", kind="choice", keys=[], box_values=None, verdict=None)
    return g.with_grade(spark.createDataFrame([tuple({**base, **kw}.values())], ITEM), "g").first().g


@pytest.mark.parametrize("keys,want", [(["A", "B"], True), (["A"], False), (["B", "A"], True), (["a", "b"], True), (["A", "A"], False), ([], False)])
def test_choice(spark, keys, want):
    assert graded(spark, keys=keys).correct is want


BOXES = dict(type="hotspot", options=[], correct=[], kind="boxes", boxes=[(1, "Server-side synchronization"), (2, "Form")])


@pytest.mark.parametrize("values,per_box", [
    (["server side syncrhonization", "form"], [True, True]), (["Server-side synchronization", "Farm"], [True, False]), (["", " "], [False, False]), (["Server-side synchronization"], [True, False])])
def test_slots(spark, values, per_box):
    r = graded(spark, **BOXES, box_values=values)
    assert r.per_box == per_box and r.correct is all(per_box) and not r.self_graded


def test_self_mismatch_and_dead_end(spark):
    assert graded(spark, kind="self", verdict="correct")[:] == (True, None, True, False)
    assert graded(spark, **{**BOXES, "kind": "choice"}, keys=["A"])[:] == (False, None, True, False)
    assert graded(spark, options=[], correct=[], explanation=" ", kind="self", verdict="correct")[:] == (False, None, True, True)


def test_exact_normalisation(spark):
    df = spark.createDataFrame([("Ａ Crème-brûlée’s ﬁne",)], "t string")
    assert df.select(g.normalise(F.col("t"), exact=True)).first()[0] == "a creme brulees fine"


@pytest.mark.parametrize("text,lines", [("", 1), ("x" * 48, 1), ("x" * 49, 2), ("x" * 96 + "\n\n", 4)])
def test_density(spark, text, lines):
    assert spark.createDataFrame([(text,)], "t string").select(d.density_lines(F.col("t"))).first()[0] == lines


def test_clip(spark):
    c = lambda s, n: spark.createDataFrame([(s,)], "t string").select(d.clip(F.col("t"), n).alias("c")).first().c
    assert c("short  text", 20)[:] == ("short text", False)
    assert c("one two three, four", 15)[:] == ("one two three […]", True)
    assert c("a " + "b" * 30, 10)[:] == ("a " + "b" * 8 + " […]", True)


@pytest.mark.parametrize("stem,want", [
    ("Some text. Which authentication mechanism should you use?", "Which authentication mechanism should you use?"),
    ("Solution checker fails.\nYou need to fix it.", "Solution checker fails."),
    ("Context.\nYou need to configure the environment for all of the users.", "You need to configure the environment for all of the users."),
    ("First.\nWhy?\nNOTE: each one", "Why?"), ("", "sub")])
def test_cue(spark, stem, want):
    assert dg.with_cue(spark.createDataFrame([(stem, "sub")], "stem string, subtopic string")).first().cue.text == want


def test_sheets_have_budget_head_and_empty_text(spark):
    items = spark.createDataFrame(
        [(u, i, "mcq-multi", i == 1, "Which of the two options would you choose in this case?", "sub", OPTS, ["A", "Z"], [], [], "Because of this. And more follows here.", "current", i, "own view" if i == 2 else None) for u in (1, 2) for i in range(1, 31)],
        "learner int, id int, type string, self_graded boolean, stem string, subtopic string, options array<struct<key:string,text:string>>, correct array<string>, boxes array<struct<box:int,answer:string>>, images array<string>, explanation string, currency string, times_wrong int, correction string")
    groups = spark.createDataFrame([(1,), (2,), (3,)], "learner int")
    out = {r.learner: r for r in dg.sheets(items, ["learner"], [F.desc("times_wrong"), F.col("id")], "2024-03-09", "Wrong answers", 10, groups=groups).collect()}
    assert out[1].n_entries == 10 and out[1].fits and out[1].n_truncated == 10
    assert out[1].markdown.startswith("# Wrong answers, 9 March 2024\n10 questions · all areas · wrong at least once\n10 entries are cut")
    assert "- Ans: A. a · Z — no such option in the bank" in out[1].markdown and "×30" in out[1].markdown
    assert "Nothing to revise" in out[3].markdown and "0 questions" in out[3].markdown
    long = {r.learner: r for r in dg.sheets(items, ["learner"], [F.desc("times_wrong"), F.col("id")], "2024-03-09", "Wrong answers", 30).collect()}
    assert long[2].n_entries == 30 and long[2].chars / 30 < 300 and "- Yours: own view" in long[2].markdown and "~ self-graded" in long[2].markdown
