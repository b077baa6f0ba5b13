"""Revision sheets: condensed entries per item, one sheet per group, with truncation accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.functions import digest as d
from itemspark.functions import items as it
from itemspark.functions.identity import collapse
from itemspark.operators.stages import stage


def with_cue(rows: DataFrame, stem: str = "stem", subtopic: str = "subtopic", name: str = "cue") -> DataFrame:
    """Add struct(text, cut): what the stem asked, in one line."""
    c, keep = F.col, rows.columns
    out = stage(rows, {"_plain": d.strip_boilerplate(c(stem))})
    out = stage(out, {"_lines": d.cue_lines(c("_plain")), "_ask": d.last_question(collapse(c("_plain")))}, keep=keep)
    out = stage(out, {"_goal": d.goal_position(c("_lines"))})
    out = stage(out, {"_cue": collapse(d.choose_cue(c("_lines"), c("_ask"), c("_goal"), c(subtopic)))}, keep=keep)
    return out.select(*keep, d.clip_flat(c("_cue"), k.CUE_MAX).alias(name))


def with_reason(rows: DataFrame, explanation: str = "explanation", name: str = "why") -> DataFrame:
    """Add struct(text, cut): the first sentence of the explanation. Leaving out the rest counts as a cut."""
    c, keep = F.col, rows.columns
    out = stage(rows, {"_body": d.reason_body(c(explanation))})
    out = stage(out, {"_first": d.first_sentence(c("_body"))})
    cut = (F.length("_first") > k.WHY_MAX) | (F.length("_body") > F.length("_first") + 4)
    return out.select(*keep, F.struct(d.clip_flat(c("_first"), k.WHY_MAX)["text"].alias("text"), F.coalesce((c("_first") != "") & cut, F.lit(False)).alias("cut")).alias(name))


def entries(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Add entry text and its cut flag to item rows joined with their record (times_wrong, correction)."""
    staged = with_reason(with_cue(rows, name="_cue"), name="_why")
    staged = stage(staged, {"_ans": d.answer_line(it.response_kind(), F.col("correct"), F.col("options"), F.col("boxes"))})
    flags = F.concat(F.when(F.col("self_graded"), "~").otherwise(""), F.when(F.col("currency") != "current", "?").otherwise(""))
    header = F.concat(
        F.lit("**q"), F.col(id_col).cast("string"), F.lit("** "), F.when(F.col("subtopic") != "", F.col("subtopic")).otherwise("general"), F.lit(" ·"),
        F.when(flags != "", F.concat(F.lit(" "), flags)).otherwise(""), F.lit(" ×"), F.coalesce("times_wrong", F.lit(0)).cast("string"))
    why = F.when(F.col("_why.text") == "", "no explanation in the bank").otherwise(F.col("_why.text"))
    own = F.when(F.length("correction") > 0, F.concat(F.lit("- Yours: "), d.clip(F.col("correction"), k.WHY_MAX)["text"]))
    return staged.withColumns({
        "entry": F.concat_ws("\n", header, F.concat(F.lit("- Cue: "), F.col("_cue.text")), F.concat(F.lit("- Ans: "), F.col("_ans.text")),
                             F.concat(F.lit("- Why: "), why), own),
        "truncated": F.col("_cue.cut") | F.col("_ans.cut") | F.col("_why.cut"),
    }).drop("_cue", "_ans", "_why")


def filter_words(count: Column, area: str | None, min_wrong: int, include_self_graded: bool) -> Column:
    bits = [F.concat(count.cast("string"), F.when(count == 1, F.lit(" question")).otherwise(F.lit(" questions"))),
            F.lit(area or "all areas"),
            F.lit(f"wrong at least {min_wrong} times" if min_wrong >= 2 else "wrong at least once")]
    if not include_self_graded:
        bits.append(F.lit("machine-graded only"))
    return F.concat_ws(" · ", *bits)


def sheets(rows: DataFrame, by: Sequence[str], order: Sequence[Column], day: str, title: str, limit: int,
           area: str | None = None, min_wrong: int = 1, include_self_graded: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """One sheet per group with its worst ``limit`` entries, plus density and cut counts.

    The limit is the sheet's own parameter and bounds what a group gathers; without a limit use
    :func:`entries`, one row per entry. ``groups`` lists groups that get a sheet even when empty.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    kept = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    kept = entries(kept)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "entry"))), lambda x: x["entry"]), "\n\n")
    out = kept.groupBy(*by).agg(
        body.alias("_body"), F.count(F.lit(1)).alias("n_entries"), F.count_if(F.col("truncated")).alias("n_truncated"),
        F.bool_or(F.col("self_graded") | (F.col("currency") != "current")).alias("_flagged"))
    if groups is not None:
        out = groups.select(*by).distinct().join(out, list(by), "left")
    n, cut = F.coalesce("n_entries", F.lit(0).cast("bigint")), F.coalesce("n_truncated", F.lit(0).cast("bigint"))
    head = F.concat_ws(
        "\n", F.concat(F.lit(f"# {title}, "), F.date_format(F.to_date(F.lit(day)), "d MMMM yyyy")),
        filter_words(n, area, min_wrong, include_self_graded),
        F.when(F.col("_flagged"), "~ self-graded · ? currency unverified · ×n times wrong"),
        F.when(cut > 0, F.concat(cut.cast("string"), F.when(cut == 1, F.lit(" entry is")).otherwise(F.lit(" entries are")),
                                 F.lit(f" cut, marked {k.TRUNCATION_MARK}. Full text stays in the app."))))
    empty = F.lit("Nothing to revise: no question in this filter has been answered wrongly.")
    markdown = F.concat(head, F.lit("\n\n"), F.coalesce("_body", empty), F.lit("\n"))
    return with_density(out.select(*by, markdown.alias("markdown"), n.alias("n_entries"), cut.alias("n_truncated")), "markdown")


def with_density(rows: DataFrame, text: str) -> DataFrame:
    rows = rows.withColumns({"chars": F.length(text), "lines": d.density_lines(F.col(text))})
    return rows.withColumns({"sides": d.sides(F.col("lines")), "fits": d.sides(F.col("lines")) <= k.SIDES_BUDGET})
