import pytest
from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.operators import classify as cl
from itemspark.operators import identity as idn
from itemspark.operators import quality as q
from itemspark.operators import reconcile as rec
from itemspark.operators.selection import strata_frame

RAW = "id bigint, " + ", ".join(f"{n} {t}" for n, t in rec.RAW_FIELDS.items())


def raw(spark, *rows):
    base = dict(type="mcq-single", stem="s", options=[("A", "a"), ("B", "b")], correct=["A"], explanation="e", refs=[], boxes=[], images=[],
                pages=[], background=None, parse_confidence="high", parse_notes=[])
    return spark.createDataFrame([tuple({**base, **r}[c] for c in ["id", *rec.RAW_FIELDS]) for r in rows], RAW)


def test_reconcile_keys_sources_and_flags(spark):
    a = raw(spark, dict(id=1), dict(id=2), dict(id=3, correct=[]), dict(id=5, correct=["A", "B"]), dict(id=6, type="hotspot", options=[], correct=[]), dict(id=7, stem="", options=[]))
    b = raw(spark, dict(id=1), dict(id=2, correct=["B"]), dict(id=3, correct=["B"], images=["i"]), dict(id=4, correct=[], options=[]), dict(id=7, stem="from b", options=[]))
    got = {r.id: r for r in rec.reconcile(a, b).collect()}
    assert [got[i].source for i in range(1, 8)] == ["merged", "merged", "merged", "b", "a", "a", "merged"]
    assert got[2].correct == ["A"] and got[2].disagreement == (["A"], ["B"]) and got[2].parse_confidence == "low"
    assert got[3].correct == ["B"] and got[3].images == ["i"] and got[3].disagreement is None and got[3].parse_confidence == "high"
    assert got[4].self_graded and got[4].parse_confidence == "low"
    assert got[5].type == "mcq-multi" and got[6].self_graded
    assert got[7].stem == "from b" and got[7].parse_confidence == "low" and got[7].parse_notes == []
    assert "without any option" in {r.id: r for r in rec.reconcile(a, b, note_bare_keys=True).collect()}[7].parse_notes[0]
    r = rec.agreement(a, b).first()
    assert (r.present_in_both, r.keyed_in_both, r.disputed) == (4, 3, 1) and r.alarm_keyed


def test_a_null_differs_from_a_value(spark):
    df = spark.createDataFrame([("h", 1, "a", None), ("h", 2, None, None), ("i", 3, "b", "x"), ("i", 4, "b", "x")], "h string, id int, f string, g string")
    got = {r.h: (r.differs_f, r.differs_g) for r in idn.duplicate_groups(df, "h", "id", ["f", "g"]).collect()}
    assert got == {"h": (True, False), "i": (False, False)}


def test_white_space_does_not_make_a_background_long_enough(spark):
    df = spark.createDataFrame([(1, "x" * 199 + "\n\n\n"), (2, "\t" + "y" * 200 + "\n")], "id int, background string")
    parents = idn.parent_groups(df, "id").collect()
    assert [(r.first_id, r.background) for r in parents] == [(2, "y" * 200)]


def test_parents_group_on_opening_and_dissolve_short_ones(spark):
    long = "x" * 250
    rows = spark.createDataFrame([(1, long + " one"), (2, long.upper() + " two"), (3, "short"), (4, "")], "id int, background string")
    parents = idn.parent_groups(rows, "id")
    p = parents.collect()
    assert [(r.first_id, r.n_items) for r in p] == [(1, 2)] and p[0].background.endswith("one")
    linked = {r.id: r.group_id for r in idn.link_parents(rows, parents).collect()}
    assert linked[1] == linked[2] == p[0].group_id and linked[3] is None and linked[4] is None


RULES = [cl.Rule("x", "x1", 2, ("alpha", "beta")), cl.Rule("x", "x2", 4, ("gamma",)), cl.Rule("y", "y1", 3, (r"\\bdelta\\b",))]


@pytest.mark.parametrize("text,area,subtopic", [
    ("nothing", None, ""), ("alpha", None, "x1"), ("alpha delta", None, "y1"), ("ALPHA beta", "x", "x1"), ("alpha beta gamma", "x", "x1"),
    ("gamma delta", None, "x2"), ("delta alpha alpha", None, "y1"), ("deltas", None, "")])
def test_rule_margins_and_ties(spark, text, area, subtopic):
    rules = [cl.Rule(r.area, r.subtopic, r.weight, tuple(p.replace("\\\\", "\\") for p in r.patterns)) for r in RULES]
    r = cl.classify(spark.createDataFrame([(text,)], "t string"), F.col("t"), rules).first()
    assert (r.rule_area, r.rule_subtopic) == (area, subtopic)


def test_assign_override_default(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "none"), (3, "none")], "id int, t string")
    over = spark.createDataFrame([(2, "z", None)], "id int, area string, subtopic string")
    rows = cl.assign(cl.classify(docs, F.col("t"), [cl.Rule("x", "x1", 3, ("alpha",))]), over, "dflt").orderBy("id").collect()
    assert [(r.area, r.origin, r.subtopic) for r in rows] == [("x", "rules", "x1"), ("z", "override", "general"), ("dflt", "default", "unclassified")]


def test_ten_problem_kinds(spark):
    base = dict(id=1, type="mcq-single", stem="s", options=[("A", "a")], correct=["A"], boxes=[], images=["i"], explanation="e", self_graded=False, area="ok")
    rows = [dict(id=1), dict(id=1), dict(id=1), dict(id=2, options=[], correct=[]), dict(id=3, correct=["Z"]), dict(id=4, correct=["A", "A"]),
            dict(id=5, self_graded=True, images=[], explanation=" "), dict(id=6, type="hotspot"), dict(id=8, area="bad"), dict(id=9, stem=" ")]
    schema = "id bigint, type string, stem string, options array<struct<key:string,text:string>>, correct array<string>, boxes array<struct<box:int,answer:string>>, images array<string>, explanation string, self_graded boolean, area string"
    items = spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], schema)
    found = q.problems(items, ["ok"], spark.createDataFrame([(9,)], "n bigint"))
    got = sorted((r.id, r.rule) for r in found.collect())
    assert got == sorted([(1, "duplicate id"), (1, "duplicate id"), (2, "empty options"), (2, "no answer key"), (3, "key without option"), (4, "single with several keys"),
                          (5, "nothing to reveal"), (6, "visual without boxes"), (7, "missing id"), (8, "unknown area"), (9, "empty stem")])
    with pytest.raises(ValueError):
        q.require_clean(found)
    q.require_clean(found.filter("false"))


def test_published_weights_hold_together(spark):
    r = q.weight_checks(strata_frame(spark.range(1), k.AREAS)).first()
    assert r.weight_sum == 1.0 and r.all_in_band and r.scale_error == 0.0 and r.heaviest == "extend-platform"
    got = {x.area: x.weight for x in q.weights_from_bands(strata_frame(spark.range(1), k.AREAS)).collect()}
    assert all(abs(got[a[0]] - a[4]) < 1e-12 for a in k.AREAS)


def test_pool_need_rounds_half_even(spark):
    strata = strata_frame(spark.range(1), [("a", "A", 10, 15, 0.5), ("b", "B", 1, 5, 0.5), ("c", "C", 1, 2, 0.0)])
    need = {r.area: r.need for r in q.pool_adequacy(spark.createDataFrame([("a",)], "area string"), strata, paper=50).collect()}
    assert need == {"a": round(7.5) * 3, "b": round(2.5) * 3, "c": 3}


def test_plain_words_match_as_their_patterns_do_and_are_looked_for_as_substrings(spark):
    texts = ["of the", "The end", "other", "x_the the_x", "thé x", "éthe", "(THE)", "often off", "profit of.", "EAUX ſous SOUS", "Keit k", "İx ix", "ıx",
             "xİ", "gli̇ x", "glİ x", "gli", "ÉO", "éo", "ßchü SCHÜ", "straße", "", None, "a the-b", "1the2", "the", "\n the\t", "und​die", "a.b a+b"]
    patterns = [r"\bthe\b", r"\bof\b", r"\boff", r"off\b", "eaux", "sous", "keit", "ix", r"\bx", r"\bgli\b", "gli", "éo", "schü", "ss", r"a\.b", "of the", r"\bund\b", r"\bdie\b", "a.b"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, x string")
    low = F.lower("x")
    got = df.select(*[cl.found(p, F.col("x"), low, cl.latin_fold(low)).alias(f"p{i}") for i, p in enumerate(patterns)], "id").orderBy("id").collect()
    want = df.select(*[F.col("x").rlike(f"(?iU){p}").alias(f"p{i}") for i, p in enumerate(patterns)], "id").orderBy("id").collect()
    assert got == want
    plan = cl.score(df, F.col("x"), [cl.Rule("a", "s", 1, (r"\bthe\b", "eaux", "a.b"))])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 4 and plan.count("Contains(") == 4
