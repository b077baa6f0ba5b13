"""Choosing items: filters, seeded order, exact quotas, stratified papers, weak lists.

Strata are a short literal table ``(key, label, lo, hi, weight)``; they are inlined into the plan, so
nothing is broadcast whose size depends on data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemspark.operators.progress import has_been_attempted, is_due, with_defaults
from itemspark.session import stored

Strata = Sequence[tuple[str, str, int, int, float]]


def strata_array(strata: Strata) -> Column:
    return F.array(*[
        F.struct(F.lit(k).alias("area"), F.lit(label).alias("label"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"),
                 F.lit(float(w)).alias("weight"), F.lit(i).alias("ord"))
        for i, (k, label, lo, hi, w) in enumerate(strata)])


def strata_frame(df: DataFrame, strata: Strata) -> DataFrame:
    """The strata as a frame of the session of ``df``."""
    return df.sparkSession.range(1).select(F.inline(strata_array(strata)))


@dataclass(frozen=True)
class ItemFilter:
    """Selection parameters; every one set narrows. ``due_only`` defaults to true."""

    area: str | None = None
    subtopic: str | None = None
    type: str | None = None
    wrong_twice: bool = False
    graded_only: bool = False
    due_only: bool | None = None
    limit: int | None = None
    seed: int = 1

    def known_to(self, areas: Sequence[str]) -> "ItemFilter":
        """Drop an unknown area instead of selecting an empty pool."""
        return self if self.area in areas else replace(self, area=None)

    def predicate(self, as_of: Column, due: bool | None = None) -> Column:
        cond = F.lit(True)
        if self.area:
            cond = cond & (F.col("area") == self.area)
        if self.subtopic:
            cond = cond & (F.col("subtopic") == self.subtopic)
        if self.type:
            cond = cond & (F.col("type") == self.type)
        if self.graded_only:
            cond = cond & ~F.col("self_graded")
        if self.wrong_twice:
            cond = cond & (F.col("times_wrong") >= 2)
        due_only = due if due is not None else (self.due_only is None or self.due_only)
        return cond & is_due(as_of) if due_only else cond


def keep_first(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key, the one with the least unique ``position``.

    The cut at rank 1 is applied in each task before the only shuffle, so a key with very many copies costs
    one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(position))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def select_items(items: DataFrame, state: DataFrame, flt: ItemFilter, as_of: Column, key: str = "item_id") -> DataFrame:
    """Filtered pool in seeded order, cut to the limit when one is set."""
    pool = with_defaults(items, state, [key]).filter(flt.predicate(as_of))
    return seeded_order(pool, key, flt.seed, flt.limit)


def filter_counts(items: DataFrame, state: DataFrame, flt: ItemFilter, as_of: Column, key: str = "item_id") -> DataFrame:
    """How many items match the filter and how many of those are due, in one pass."""
    pool = with_defaults(items, state, [key])
    return pool.agg(F.count_if(flt.predicate(as_of, due=False)).alias("matching"),
                    F.count_if(flt.predicate(as_of, due=True)).alias("due"))


def session_mode(area: Column, subtopic: Column, item_type: Column, wrong_twice: Column, graded_only: Column) -> Column:
    narrowed = (
        F.coalesce(F.length(area) > 0, F.lit(False)) | F.coalesce(F.length(subtopic) > 0, F.lit(False))
        | F.coalesce(F.length(item_type) > 0, F.lit(False))
        | F.coalesce(wrong_twice, F.lit(False)) | F.coalesce(graded_only, F.lit(False))
    )
    return F.when(narrowed, "weak-area").otherwise("drill")


def subtopics(items: DataFrame, area: str | None = None) -> DataFrame:
    pool = items if area is None else items.filter(F.col("area") == area)
    return pool.filter(F.col("subtopic") != "").select("area", "subtopic").distinct().orderBy("area", "subtopic")


def ticket(seed: int | Column, key: str | Column, tag: str = "") -> Column:
    """Repeatable pseudo-random sort key of one row."""
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(s, F.lit(f"{tag}:"), k.cast("string")))


def seeded_order(df: DataFrame, key: str, seed: int, limit: int | None = None) -> DataFrame:
    ordered = df.withColumn("ticket", ticket(seed, key)).orderBy("ticket", key)
    return ordered if limit is None else ordered.limit(max(0, limit))


def allocate(strata: DataFrame, n: int, capacity: DataFrame | None = None) -> DataFrame:
    """Largest-remainder quotas summing to n, optionally capped with round-robin redistribution.

    Works on the strata table alone: one row per stratum, at most n redistribution slots.
    """
    exact = F.round(F.col("weight") * F.lit(n), 12)
    base = strata.withColumn("quota", F.floor(exact).cast("int")).withColumn("_rest", F.round(exact - F.floor(exact), 12))
    order = Window.orderBy(F.desc("_rest"), F.desc("weight"), "area")
    base = base.withColumn("_rank", F.row_number().over(order)).withColumn("_given", F.sum("quota").over(Window.partitionBy()))
    base = base.withColumn("quota", F.col("quota") + (F.col("_rank") <= F.lit(n) - F.col("_given")).cast("int"))
    base = base.drop("_rest", "_rank", "_given")
    if capacity is None:
        return base
    capped = (
        base.join(capacity.select("area", "capacity"), "area", "left")
        .withColumn("capacity", F.coalesce("capacity", F.lit(0)))
        .withColumn("_over", F.greatest(F.col("quota") - F.col("capacity"), F.lit(0)))
        .withColumn("quota", F.least("quota", "capacity").cast("int"))
        .withColumn("_overflow", F.sum("_over").over(Window.partitionBy()))
        .withColumn("_spare", F.least(F.col("capacity") - F.col("quota"), F.col("_overflow")).cast("int"))
    )
    turn = Window.orderBy("_slot", F.desc("weight"), "area")
    extra = (
        capped.filter(F.col("_spare") > 0)
        .withColumn("_slot", F.explode(F.sequence(F.lit(1), F.col("_spare"))))
        .withColumn("_turn", F.row_number().over(turn))
        .filter(F.col("_turn") <= F.col("_overflow"))
        .groupBy("area").agg(F.count(F.lit(1)).cast("int").alias("_extra"))
    )
    return (
        capped.join(extra, "area", "left")
        .withColumn("quota", F.col("quota") + F.coalesce("_extra", F.lit(0)))
        .drop("_over", "_overflow", "_spare", "_extra")
    )


def pool_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("area").agg(F.count(F.lit(1)).alias("capacity"))


def paper_shape(items: DataFrame, strata: Strata, n: int) -> DataFrame:
    """Quotas of a paper of n items, never above what each pool holds."""
    return allocate(strata_frame(items, strata), max(0, n), pool_sizes(items))


def preference_tier(as_of: Column) -> Column:
    """Machine-graded before self-graded; unseen, then due, then not due."""
    fresh = F.when(~has_been_attempted(), 0).when(is_due(as_of), 1).otherwise(2)
    return (F.col("self_graded").cast("int") * 3 + fresh).cast("int")


def sample_paper(items: DataFrame, state: DataFrame, strata: Strata, n: int, seed: int | Column, as_of: Column,
                 key: str = "item_id", seeds: Sequence[str] = (), pool: DataFrame | None = None) -> DataFrame:
    """Exact-quota stratified sample in a repeatable random order.

    Ranking is first cut at the paper length, a literal the optimizer turns into a per-task group limit
    ahead of the shuffle, so no stratum is ever sorted whole; quotas then apply to at most n rows each.
    ``seeds`` names columns that number several papers drawn at once from ``pool``, the items without them.
    """
    shape = paper_shape(items if pool is None else pool, strata, n)
    ranked = (
        with_defaults(items, state, [key])
        .withColumn("tier", preference_tier(as_of))
        .withColumn("ticket", ticket(seed, key))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*seeds, "area").orderBy("tier", "ticket", key)))
        .filter(F.col("_rank") <= F.lit(n))
    )
    picked = ranked.join(F.broadcast(shape.select("area", "weight", "quota")), "area").filter(F.col("_rank") <= F.col("quota"))
    return picked.withColumn("place", ticket(seed, key, "/place")).orderBy(*seeds, "place", key).drop("_rank")


def sample_papers(items: DataFrame, state: DataFrame | None, strata: Strata, n: int, n_seeds: int, as_of: Column,
                  key: str = "item_id", spare: float = 6.0) -> DataFrame:
    """The papers of seeds 1 to ``n_seeds``, each as ``sample_paper`` draws it: (seed, area, weight, key, tier, ticket).

    Tickets are uniform, so the lowest q of a tier's c tickets lie below about q / c. Each seed keeps only the tickets
    below that share and a spare of ``spare`` standard deviations; the tiers before it are kept whole, those after
    it are out. What is ranked is about the papers themselves, not items x seeds. A (seed, stratum) that still falls
    short of its quota is drawn again from all its items.
    """
    rows = with_defaults(items, state, [key]).withColumn("tier", preference_tier(as_of))
    shape = paper_shape(items, strata, n).select("area", "weight", "quota").where("quota > 0")
    held = rows.groupBy("area", "tier").agg(F.count(F.lit(1)).alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("area").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = F.col("quota") - F.col("before")
    share = (need + F.lit(spare) * (F.sqrt(need) + 1)) / F.col("held")
    below = F.when(share >= 1, F.lit("g")).otherwise(F.lpad(F.lower(F.hex(F.floor(share * float(1 << 32)).cast("bigint"))), 8, "0"))
    # One row per stratum and tier, which the caller's list bounds.
    cut = shape.join(held.withColumn("before", before), "area").where(need > 0).select("area", "tier", "weight", "quota", below.alias("below"))
    # Few items become many tickets: they are spread before, by a number that adaptive execution leaves alone.
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.select(key, "area", "tier").join(F.broadcast(cut), ["area", "tier"]).repartition(tasks, key)
    drawn = spread.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(n_seeds))))
    drawn = drawn.withColumn("ticket", ticket(F.col("seed"), key)).where(F.col("ticket") < F.col("below"))
    order = Window.partitionBy("seed", "area").orderBy("tier", "ticket", key)
    found = drawn.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("quota")).drop("_rank", "below")
    found = stored(found, "papers")  # as many rows as the papers have
    have = found.groupBy("seed", "area").agg(F.count(F.lit(1)).alias("have"))
    grid = F.broadcast(shape).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(n_seeds))))
    short = grid.join(have, ["seed", "area"], "left").where(F.coalesce("have", F.lit(0)) < F.col("quota")).select("seed", "area", "weight", "quota")
    again = rows.select(key, "area", "tier").join(short, "area").withColumn("ticket", ticket(F.col("seed"), key))
    again = again.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("quota")).drop("_rank")
    return found.join(short.select("seed", "area"), ["seed", "area"], "left_anti").unionByName(again).select("seed", "area", "weight", key, "tier", "ticket")


def shaky() -> Column:
    """Answered correctly last time, but not confidently."""
    return F.coalesce(F.col("last_correct") & (F.coalesce("last_confidence", F.lit("unsure")) != "confident"), F.lit(False))


def weak_list(items: DataFrame, state: DataFrame, min_wrong: int = 2, area: str | None = None,
              subtopic: str | None = None, include_shaky: bool = False, include_self_graded: bool = True,
              limit: int | None = None, key: str = "item_id") -> DataFrame:
    """Attempted items answered wrongly often enough (or shakily), worst first."""
    pool = items
    if area:
        pool = pool.filter(F.col("area") == area)
    if subtopic:
        pool = pool.filter(F.col("subtopic") == subtopic)
    if not include_self_graded:
        pool = pool.filter(~F.col("self_graded"))
    wanted = F.col("times_wrong") >= min_wrong
    if include_shaky:
        wanted = wanted | shaky()
    rows = pool.join(state.filter(has_been_attempted()), key).filter(wanted)
    rows = rows.orderBy(F.desc("times_wrong"), F.col("last_correct").cast("int"), F.desc("last_at"), key)
    return rows if limit is None else rows.limit(max(0, limit))


def export_list(items: DataFrame, state: DataFrame, area: str | None = None, min_wrong: int = 1,
                include_self_graded: bool = True, limit: int | None = 10, key: str = "item_id") -> DataFrame:
    """The weak list with the export's defaults; self-graded items go before the cut."""
    return weak_list(items, state, min_wrong, area, include_self_graded=include_self_graded, limit=limit, key=key)


def slowest(results: DataFrame, session: str = "session_id", pos: str = "item_id", k: int = 3) -> DataFrame:
    w = Window.partitionBy(session).orderBy(F.desc("elapsed_ms"), pos)
    return results.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def missed(results: DataFrame, items: DataFrame, session: str = "session_id", pos: str = "item_id",
           key: str = "item_id") -> DataFrame:
    """Wrong results joined back to their items, in paper order."""
    extra = [c for c in items.columns if c not in results.columns or c == key]
    return results.filter(~F.col("correct")).join(items.select(*extra), key).orderBy(session, pos)


def most_recent_first(sessions: DataFrame, at: str = "started_at", key: str = "session_id") -> DataFrame:
    return sessions.orderBy(F.desc(at), key)


def id_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))
