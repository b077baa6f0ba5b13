"""Declarative checks and counters over a bank. Row rules cost one scan; set rules one aggregate each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.functions import items as it
from itemspark.functions.scalars import percent_one_place
from itemspark.functions.text import key_list
from itemspark.operators.identity import missing_ids


def row_problems(items: DataFrame, areas: Sequence[str], id_cols: Sequence[str] = ("id",)) -> DataFrame:
    """Row rules to problem rows (id, rule, detail)."""
    machine = it.is_choice() & ~F.col("self_graded")
    none = F.lit("")
    orphans = it.missing_letters()
    rules = [
        (machine & it.empty(F.col("options")), "empty options", F.col("type")),
        (machine & it.empty(F.col("correct")), "no answer key", none),
        (machine & (F.size(orphans) > 0), "key without option", key_list(orphans)),
        (machine & (F.col("type") == "mcq-single") & (F.size("correct") > 1), "single with several keys", F.size("correct").cast("string")),
        (F.col("self_graded") & it.empty(F.col("images")) & it.blank(F.col("explanation")), "nothing to reveal", none),
        (it.is_visual() & it.empty(F.col("boxes")) & ~F.col("self_graded"), "visual without boxes", F.col("type")),
        (~F.coalesce(F.col("area").isin(*areas), F.lit(False)), "unknown area", F.coalesce("area", F.lit("null"))),
        (it.blank(F.col("stem")), "empty stem", none),
    ]
    found = F.array(*[F.when(c, F.struct(F.lit(name).alias("rule"), detail.alias("detail"))) for c, name, detail in rules])
    return items.select(*id_cols, F.inline(F.filter(found, lambda x: x.isNotNull())))


def duplicate_ids(items: DataFrame, id_cols: Sequence[str] = ("id",)) -> DataFrame:
    """One problem row per surplus holder of an id: the holders are counted, not gathered."""
    counts = items.groupBy(*id_cols).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    surplus = F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_n")))
    return counts.withColumn("_nth", surplus).select(*id_cols, F.lit("duplicate id").alias("rule"), F.lit("").alias("detail"))


def problems(items: DataFrame, areas: Sequence[str], expected: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """All ten rules; ``expected`` is a one-row frame with the highest id the bank should reach."""
    out = row_problems(items, areas, [id_col]).unionByName(duplicate_ids(items, [id_col]))
    if expected is not None:
        gaps = missing_ids(items.select(F.col(id_col).cast("bigint").alias(id_col)), id_col, expected)
        out = out.unionByName(gaps.select(id_col, F.lit("missing id").alias("rule"), F.lit("").alias("detail")))
    return out


def require_clean(found: DataFrame) -> None:
    """Strict mode: raise when there is any problem row."""
    if not found.isEmpty():
        raise ValueError("the bank has problems; see the problem table")


def split_and_shares(rows: DataFrame, column: str) -> DataFrame:
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)))
    return counts.withColumn("percent", percent_one_place(F.col("n"), total.scalar()))


def type_breakdown(items: DataFrame, column: str = "type") -> DataFrame:
    return items.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("self_graded")).alias("machine_graded"))


def pool_adequacy(items: DataFrame, strata: DataFrame, paper: int = 60, papers: int = 3) -> DataFrame:
    """Is each pool deep enough for several full papers at the top of its band (half-even rounding)?"""
    counts = items.groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    out = strata.join(counts, "area", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    out = out.withColumn("need", (F.bround(F.lit(float(paper)) * F.col("hi") / 100) * papers).cast("int"))
    return out.withColumn("verdict", F.when(F.col("n") >= F.col("need"), "ok").otherwise("thin"))


def bank_counters() -> list[Column]:
    """Counters of a bank's rows as plain aggregates; a write can take them in its own pass (``written_counting``)."""
    return [
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("parse_confidence") == "low").alias("low_confidence"),
        F.count_if(F.col("currency") == "suspect").alias("suspect"), F.count_if(F.col("currency") == "superseded").alias("superseded"),
        F.count_if(it.blank(F.col("explanation"))).alias("no_explanation"), F.count_if(it.empty(F.col("refs"))).alias("no_reference")]


def quality_counters(items: DataFrame, parents: DataFrame) -> DataFrame:
    base = items.agg(*bank_counters())
    cover = parents.agg(F.struct(F.count(F.lit(1)).alias("parents"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("children")).alias("c"))
    return base.withColumn("_c", cover.scalar()).select(*base.columns, "_c.*")


def usability(items: DataFrame) -> DataFrame:
    """Interactive, boxed, self-graded, dead; drillable is the first two."""
    interactive = F.count_if(it.is_choice() & ~it.empty(F.col("options")) & ~it.empty(F.col("correct")))
    boxed = F.count_if(~it.empty(F.col("boxes")) & ~F.col("self_graded"))
    return items.agg(F.count(F.lit(1)).alias("total"), interactive.alias("interactive"), boxed.alias("boxed"),
                     F.count_if(F.col("self_graded")).alias("self_graded"), F.count_if(it.is_dead_end()).alias("dead"),
                     (interactive + boxed).alias("drillable"))


def currency_statement(items: DataFrame, strata: DataFrame | None = None) -> DataFrame:
    """Currency totals; with strata, per stratum and every stratum listed."""
    flags = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("currency") != "current").alias("suspect"),
             F.count_if(F.col("parse_confidence") == "low").alias("low_confidence")]
    if strata is not None:
        out = strata.select("area", "label").join(items.groupBy("area").agg(*flags), "area", "left")
        return out.select("area", "label", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("total", "suspect", "low_confidence")])
    return items.agg(*flags, F.count_if(F.col("currency") == "superseded").alias("superseded"),
                     F.count_if(it.is_flagged()).alias("flagged"), F.count_if(~it.empty(F.col("refs"))).alias("with_references"))


def weight_checks(strata: DataFrame) -> DataFrame:
    """Sum, band membership, common scale over band midpoints, heaviest key."""
    mid = (F.col("lo") + F.col("hi")) / 200
    rows = strata.withColumns({"_mid": mid, "_in": (F.col("weight") * 100).between(F.col("lo"), F.col("hi"))})
    return rows.agg(F.round(F.sum("weight"), 12).alias("weight_sum"), F.bool_and("_in").alias("all_in_band"),
                    F.round(F.max(F.abs(F.col("weight") / F.col("_mid") - F.lit(1) / F.lit(0.95))), 12).alias("scale_error"),
                    F.max_by("area", "weight").alias("heaviest"))


def weights_from_bands(strata: DataFrame) -> DataFrame:
    """Weights as band midpoints normalised to one."""
    mid = (F.col("lo") + F.col("hi")) / 2
    return strata.withColumn("weight", mid / F.sum(mid).over(Window.partitionBy()))


def note_frequency(items: DataFrame, n: int = 8, where: Column | None = None) -> DataFrame:
    rows = items if where is None else items.filter(where)
    return rows.select(F.explode("parse_notes").alias("note")).groupBy("note").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "note").limit(n)


def content_counters(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("parsed"), F.count_if(~it.empty(F.col("options"))).alias("with_options"),
        F.count_if(~it.empty(F.col("correct"))).alias("with_key"), F.count_if(~it.empty(F.col("boxes"))).alias("with_boxes"),
        F.count_if(F.col("explanation") != "").alias("with_explanation"), F.count_if(~it.empty(F.col("refs"))).alias("with_references"),
        F.count_if(F.col("background").isNotNull()).alias("with_background"))


def spot_check(rows: DataFrame, where: Column, order: Sequence[str], n: int = 5) -> DataFrame:
    return rows.filter(where).orderBy(*order).limit(n)
