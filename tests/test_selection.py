from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.operators import analytics as an
from itemspark.operators import selection as sel

T0 = datetime(2024, 1, 1)
STATE = "item_id bigint, box int, attempts bigint, times_wrong bigint, due_at timestamp_ntz, last_correct boolean, last_confidence string, last_at timestamp_ntz"


def bank(spark, per_area=40):
    rows = [(a * 1000 + i, s[0], f"sub{i % 3}", "mcq-single", i % 10 == 0) for a, s in enumerate(k.AREAS) for i in range(per_area)]
    return spark.createDataFrame(rows, "item_id bigint, area string, subtopic string, type string, self_graded boolean")


def state(spark, rows=()):
    return spark.createDataFrame([(i, 1, n, w, T0 + timedelta(days=d), ok, conf, T0 + timedelta(hours=i)) for i, n, w, d, ok, conf in rows], STATE)


def now():
    return F.lit(T0 + timedelta(days=1)).cast("timestamp_ntz")


@pytest.mark.parametrize("n", [40, 47, 60])
def test_quotas_sum_and_stay_within_one_of_exact(spark, n):
    got = {r.area: r.quota for r in sel.allocate(sel.strata_frame(spark.range(1), k.AREAS), n).collect()}
    assert sum(got.values()) == n
    assert all(abs(got[a[0]] - a[4] * n) < 1 for a in k.AREAS)


def test_capacity_is_redistributed_heaviest_first_and_short_pools_stay_short(spark):
    strata = sel.strata_frame(spark.range(1), k.AREAS)
    cap = spark.createDataFrame([(a[0], 1 if a[0] == "extend-ux" else 50) for a in k.AREAS], "area string, capacity int")
    got = {r.area: r.quota for r in sel.allocate(strata, 60, cap).collect()}
    assert sum(got.values()) == 60 and got["extend-ux"] == 1 and got["extend-platform"] >= 22
    tiny = spark.createDataFrame([(a[0], 2) for a in k.AREAS], "area string, capacity int")
    assert sum(r.quota for r in sel.allocate(strata, 60, tiny).collect()) == 12


def test_paper_prefers_unseen_graded_and_repeats_per_seed(spark):
    items = bank(spark)
    seen = state(spark, [(4000 + i, 1, 0, 30, True, "confident") for i in range(20)])
    draw = lambda s: [r.item_id for r in sel.sample_paper(items, seen, k.AREAS, 50, s, now()).collect()]
    a = draw(1)
    assert a == draw(1) and a != draw(2) and len(a) == len(set(a)) == 50
    rows = sel.sample_paper(items, seen, k.AREAS, 50, 1, now()).collect()
    assert all(not r.self_graded and r.tier == 0 for r in rows if r.area == "extend-platform")


def test_sampling_share_within_three_points(spark):
    gaps = an.sampling_fidelity(bank(spark), k.AREAS, 50, 1000).collect()
    assert len(gaps) == 6 and all(r.gap_pp < 3 for r in gaps) and sum(r.drawn for r in gaps) == 50_000


def test_weak_list_order_shaky_and_limits(spark):
    st = state(spark, [(1, 3, 2, 0, True, "confident"), (2, 3, 2, 0, False, "unsure"), (3, 1, 0, 0, True, "guessed"), (4, 5, 4, 0, True, "confident"), (1000, 1, 1, 0, True, "unsure")])
    ids = lambda **kw: [r.item_id for r in sel.weak_list(bank(spark), st, **kw).collect()]
    assert ids() == [4, 2, 1] and ids(include_shaky=True) == [4, 2, 1, 1000, 3] and ids(limit=1) == [4] and ids(limit=-1) == []
    assert [r.item_id for r in sel.export_list(bank(spark), st).collect()] == [4, 2, 1, 1000]
    assert [r.item_id for r in sel.export_list(bank(spark), st, include_self_graded=False).collect()] == [4, 2, 1]


def test_filters(spark):
    items, st = bank(spark, 10), state(spark, [(1, 2, 2, 30, False, "unsure"), (2, 1, 0, 0, True, "unsure")])
    n = lambda **kw: sel.select_items(items, st, sel.ItemFilter(**kw), now()).count()
    assert n() == 59 and n(due_only=False) == 60 and n(area="extend-ux") == 10 and n(wrong_twice=True) == 0
    assert n(wrong_twice=True, due_only=False) == 1 and n(limit=0) == 0 and n(limit=5) == 5 and n(graded_only=True, due_only=False) == 54
    assert sel.ItemFilter(area="typo").known_to(["a"]).area is None
    r = sel.filter_counts(items, st, sel.ItemFilter(wrong_twice=True), now()).first()
    assert (r.matching, r.due) == (1, 0)


def test_keep_first_keeps_the_first(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 5)], "h string, pos int")
    assert sorted(sel.keep_first(df, "h", "pos").collect()) == [("a", 1), ("b", 2)] or {r.h: r.pos for r in sel.keep_first(df, "h", "pos").collect()} == {"a": 1, "b": 2}


def test_readiness_extremes(spark):
    items = bank(spark, 10)
    none = an.readiness(items, state(spark), k.AREAS)
    assert {r.rag for r in none.collect()} == {"red"}
    assert an.next_action(none).first().action == "start"
    far = F.lit(T0).cast("timestamp_ntz")
    assert an.projection(none, far, far).first()[:2] == (0, False)
    full = an.readiness(items, state(spark, [(a * 1000 + i, 1, 0, 0, True, "confident") for a in range(6) for i in range(10)]), k.AREAS)
    p = an.projection(full, far, far).first()
    assert (p.projected_score, p.on_track, p.days_to_exam) == (1000, True, 0)
    assert an.next_action(full).first().action == "full paper"
    thin = an.readiness(items, state(spark, [(1, 1, 0, 0, True, "confident")]), k.AREAS).filter("attempted > 0").first()
    assert thin.rag != "green" and thin.coverage == 0.1


def test_next_action_and_priority_order_are_different_quantities(spark):
    rows = [("heavy", "Heavy", 13 / 38, 10, 10, 0.7, 1.0, 0.7), ("light", "Light", 5 / 38, 10, 10, 0.3, 1.0, 0.3)]
    areas = spark.createDataFrame(rows, "area string, label string, weight double, total bigint, attempted bigint, accuracy double, coverage double, score double")
    assert an.next_action(areas).first().area == "light"
    assert an.priority_table(areas).orderBy("place").first().area == "heavy"


def test_session_scores(spark):
    def score(rows):
        df = spark.createDataFrame([("s", i, a, ok, 1000) for i, (a, ok) in enumerate(rows)], "session_id string, item_id int, area string, correct boolean, elapsed_ms bigint")
        return an.session_scores(df, k.AREAS).first().score
    names = [a[0] for a in k.AREAS]
    assert score([(n, True) for n in names]) == 1000 and score([(n, False) for n in names]) == 0
    assert score([(n, n != "extend-ux") for n in names]) == round(1000 * (1 - 5 / 38))
    assert score([("extend-ux", True), ("extend-platform", False)]) == round(1000 * 5 / 18)
    assert score([("unknown", True)]) == 0


def sessions(spark):
    days = [("s1", T0, 10, 6), ("s2", T0 + timedelta(days=1), 20, 18), ("s3", T0 + timedelta(days=2), 0, 0)]
    s = spark.createDataFrame([(1, sid, at) for sid, at, _, _ in days], "learner int, session_id string, started_at timestamp_ntz")
    r = spark.createDataFrame([(sid, i, i < ok) for sid, _, n, ok in days for i in range(n)], "session_id string, item_id int, correct boolean")
    return s, r


def test_daily_stats(spark):
    s, r = sessions(spark)
    t = an.activity_totals(s, r, ["learner"])
    x = t.first()
    assert (x.sessions, x.total_attempts, x.total_correct, x.accuracy, x.active_days, x.distinct_seen) == (3, 30, 24, 0.8, 2, 20)
    assert x.last_studied_at == T0 + timedelta(days=1)
    p = an.pace(t, spark.createDataFrame([(50,)], "n bigint"), F.lit(T0 + timedelta(days=5)).cast("timestamp_ntz"), F.lit(T0 + timedelta(days=2)).cast("timestamp_ntz")).first()
    assert (p.remaining, p.days_to_exam, p.attempts_per_day, p.required_per_day, p.on_pace) == (30, 3, 15.0, 10, True)
    d = {r.day: (r.attempts, r.n_correct, r.active) for r in an.daily_activity(s, r, ["learner"]).collect()}
    assert d == {"2024-01-01": (10, 6, True), "2024-01-02": (20, 18, True), "2024-01-03": (0, 0, False)}
    bars = {r.day: r.height for r in an.recent_bars(an.daily_activity(s, r, ["learner"]), ["learner"]).collect()}
    assert bars == {"2024-01-01": 50, "2024-01-02": 100, "2024-01-03": 0}


def test_rolling_window_forgets(spark):
    rows = spark.createDataFrame([(1, i, i >= 10) for i in range(60)], "learner int, pos int, correct boolean")
    assert an.rolling_accuracy(rows, ["learner"], ["pos"]).first().rolling_accuracy == 1.0
    from itemspark.operators.scans import by_position
    trace = {r.pos: r.rolling_accuracy for r in an.rolling_accuracy_trace(rows, ["learner"], ["pos"], by_position("pos", 7)).collect()}
    assert trace[59] == 1.0 and trace[9] == 0.0 and trace[19] == 0.5 and trace[54] == 45 / 50


def test_flatten_sessions(spark):
    df = spark.createDataFrame([("b", 2, [("y", True), ("z", False)]), ("a", 1, [("x", True)]), ("c", 3, [])], "id string, started_at int, results array<struct<content_hash:string,correct:boolean>>")
    assert [(r.session_id, r.pos, r.content_hash) for r in an.flatten_sessions(df).collect()] == [("a", 0, "x"), ("b", 0, "y"), ("b", 1, "z")]


@pytest.mark.parametrize("spare", [6.0, 0.0, -4.0])
def test_papers_drawn_together_are_those_drawn_alone(spark, spare):
    """A spare of 0 or less leaves strata short, which are then drawn again."""
    items = bank(spark)
    at = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    got = sel.sample_papers(items, None, k.AREAS, 50, 5, at, spare=spare).groupBy("seed").agg(F.sort_array(F.collect_list("item_id")).alias("ids")).collect()
    assert len(got) == 5
    for r in got:
        assert r["ids"] == sorted(x["item_id"] for x in sel.sample_paper(items, None, k.AREAS, 50, r["seed"], at).collect())
