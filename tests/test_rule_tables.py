"""Rules held in a table against the rules expanded into the plan."""

import re

import pytest
from pyspark.sql import functions as F

from itemspark.operators import classify as cl
from itemspark.operators import rule_tables as rt
from tools.plans import plan_of

TEXTS = ["Canvas app with a Gallery", "the CANVAS apps and model-driven app", "ſtraße STRASSE straẞe", "İstanbul istanbul ISTANBUL", "K9 k9 Kelvin", "a.b aXb", "colour color colouur",
         "x" * 500 + " needle " + "y" * 500, "", None, "plug-in plugin plug in", "日本語テキスト 日本語", "tab\there\nnew line", "aaa aaaa aaaaa", "price (USD) 5$", "[x] {y} | z", "\\d+ 12"]
PATTERNS = [r"canvas apps?", r"\bgallery\b", r"model[- ]driven", r"straße", r"istanbul", r"k9", r"a\.b", r"colou?r", r"needle", r"plug-?in", r"日本語", r"here\s+new", r"a{4,}", r"\(usd\)",
            r"price|cost", r"(needle|pin)", r"x*y{3}", r"^canvas", r"line$", r"App", r"\x41pps", r"[[:alpha:]]x", r"zz+", r"\Qa.b\E", r"ne+dle", r"\p{Lu}stanbul", r".", r"\d+", r"[^]x]needle", "İstanbul", "ſtra"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 1, "m", 2) for i, t in enumerate(texts)], "id int, body string, rule_id int, matched string, _buckets int").drop("_buckets")


@pytest.mark.parametrize("flags", [rt.IGNORE_CASE, rt.CASE])
def test_every_pattern_finds_what_it_finds_alone(spark, flags):
    usable = [p for p in PATTERNS if p != r"[[:alpha:]]x"]
    df = docs(spark)
    want = {r["id"]: {p for p, hit in zip(usable, r["hits"], strict=True) if hit} for r in df.select("id", F.array(*[F.coalesce(F.col("body").rlike(flags + p), F.lit(False)) for p in usable]).alias("hits")).collect()}
    rules = spark.createDataFrame([(p, i) for i, p in enumerate(usable)] + [(None, -1), (usable[0], 0)], "pattern string, place int")
    for shard in (1000, 4):
        got = rt.matches(df, ["id"], F.col("body"), rules, flags=flags, shard=shard).collect()
        assert sorted((r["id"], r["pattern"]) for r in got if r["place"] or r["pattern"] != usable[0]) == sorted((i, p) for i, own in want.items() for p in own if p != usable[0])
        assert {r["id"] for r in got if r["pattern"] == usable[0]} == {i for i, own in want.items() if usable[0] in own}


@pytest.mark.parametrize("pattern, literal", [
    ("canvas apps?", "canvas app"), (r"\bCDS\b", "cds"), (r"docs\.microsoft\.com", "microsoft"), ("(a|b)", ""), ("x|y", ""), (r"Abc", "abc"), (r"\x{41}bcd", "bcd"),
    ("colou?r", "colo"), ("ab{2,3}cde", "cde"), ("needle+s", "needle"), ("[abc]def", "def"), (r"\p{L}xyz", "xyz"), ("", ""), ("Straße", "strasse")])
def test_mandatory_literals(spark, pattern, literal):
    assert spark.range(1).select(rt.mandatory_literal(F.lit(pattern))).first()[0] == literal


def rules():
    return [cl.Rule("apps", "canvas", 2, ("canvas apps?", "gallery")), cl.Rule("apps", "model", 2, ("model[- ]driven", "plug-?in")), cl.Rule("text", "", 1, ("needle", "日本語", "istanbul", "line$")),
            cl.Rule("text", "other", 3, ("colou?r",)), cl.Rule("money", "usd", 1, (r"\(usd\)", "price"))]


def listed(df, rules_):
    return sorted((r["id"], r["area"], r["score"], r["subtopic"]) for r in cl.score(df, F.col("body"), rules_).select("id", F.inline("ranked")).collect())


def tabled(df, rules_):
    return sorted((r["id"], r["area"], r["score"], r["subtopic"]) for r in rt.score(df, ["id"], F.col("body"), rules_).collect())


def test_scores_and_classes_equal_those_of_a_rule_list(spark):
    df, table = docs(spark), rt.rule_rows(spark, rules())
    assert tabled(df, table) == listed(df, rules())
    names = ["id", "rule_area", "rule_subtopic", "top_score", "runner_up"]
    assert rt.classify(df, ["id"], F.col("body"), table).select(*names).orderBy("id").collect() == cl.classify(df, F.col("body"), rules()).select(*names).orderBy("id").collect()


def test_five_thousand_rules_make_no_larger_plan_and_no_shuffle_of_texts(spark):
    df = docs(spark, [*TEXTS, "w00017x and WORD 4999 then word 49991", "word 7"])
    more = [cl.Rule(f"a{i % 9}", f"s{i % 40}", 1 + i % 3, (f"w{i:05d}x", f"word {i}\\b")) for i in range(5000)]
    few, many = (rt.rule_rows(spark, r) for r in (rules(), rules() + more))
    small, large = (plan_of(rt.matches(df, ["id"], F.col("body"), r)) for r in (few, many))
    main = re.split(r"Subquer", large)[0]
    assert "Exchange" not in main and "Join" not in main and len(large) < 1.2 * len(small)
    got = set(tabled(df, many))
    assert set(listed(df, rules())) <= got
    assert {x for x in got if x[1].startswith("a") and x[1] != "apps"} == {(17, "a8", 3, "s17"), (17, "a4", 2, "s39"), (18, "a7", 2, "s7")}


def test_empty_tables_and_notes(spark):
    df, none = docs(spark), rt.rule_rows(spark, rules()).where("false")
    assert rt.score(df, ["id"], F.col("body"), none).count() == 0
    assert rt.classify(df, ["id"], F.col("body"), none).where("rule_area IS NULL").count() == len(TEXTS)
    assert rt.score(df.where("false"), ["id"], F.col("body"), rt.rule_rows(spark, rules())).count() == 0
    terms = spark.createDataFrame([(2, "needle", "n"), (1, "xx", "first"), (3, "yy", "n"), (4, "Needle", "case")], "place int, pattern string, note string")
    got = {r["id"]: r["notes"] for r in rt.notes(df, ["id"], F.col("body"), terms).collect()}
    assert got[7] == ["first", "n"] and got[9] == [] and len(got) == len(TEXTS)


def test_no_row_per_candidate_carries_the_text(spark):
    plan = rt.matches(docs(spark), ["id"], F.col("body"), rt.rule_rows(spark, rules()))._jdf.queryExecution().optimizedPlan().toString()
    generators = [line for line in plan.split("\n") if "Generate explode(" in line]
    assert generators and not any("_buckets" in line or "[_bucket" in line for line in generators)


def test_literals_in_and_across_words(spark):
    df = spark.createDataFrame([(1, "one  two\nthree threefold"), (2, "one two"), (3, "xthreefoldy"), (4, None), (5, "Straße STRASSE"), (6, "Kelvin's")], "id int, body string")
    rules_ = spark.createDataFrame([(0, "one two"), (1, "threefold"), (2, r"two\s+three"), (3, "e t"), (4, "strasse"), (5, "kelvin"), (6, "ab")], "rule_id int, pattern string")
    got = {(r["id"], r["rule_id"]) for r in rt.matches(df, ["id"], F.col("body"), rules_).collect()}
    assert got == {(1, 1), (1, 2), (2, 0), (2, 3), (3, 1), (5, 4), (6, 5)}
