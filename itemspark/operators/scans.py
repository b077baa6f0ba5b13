"""Ordered per-key scans that never put one key's whole history into one task.

A plain ``Window.partitionBy(key)`` sorts each key in a single task, so one key holding a third of
all rows is one straggler. Here the caller also names a *chunk*: a column that grows with the
order (an hour, a block of paragraph numbers). Rows are windowed per ``(key, chunk)``, each chunk is
reduced to one summary row, only the summaries are windowed per key, and the carry is joined back on
``(key, chunk)``, which the row side is already partitioned by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_time(at: str, unit: str = "HOUR") -> Column:
    """Chunk column for time-ordered rows; use a shorter unit where a key is hotter."""
    return F.date_trunc(unit, F.col(at))


def by_position(pos: str, width: int = 1000) -> Column:
    """Chunk column for densely numbered rows."""
    return F.floor(F.col(pos) / F.lit(width))


def _windows(keys: Sequence[str], order: Sequence[str]):
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_chunk")
    return inside, across


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                   measures: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums per key; ``measures`` maps new column to a summed expression."""
    inside, across = _windows(keys, order)
    prior = across.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_chunk", chunk)
    for name, expr in measures.items():
        rows = rows.withColumn(f"_m_{name}", expr.cast("bigint"))
    carry = (
        rows.groupBy(*keys, "_chunk")
        .agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in measures])
        .select(*keys, "_chunk", *[F.coalesce(F.sum(f"_s_{n}").over(prior), F.lit(0)).alias(f"_c_{n}") for n in measures])
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name in measures:
        rows = rows.withColumn(f"_r_{name}", F.sum(f"_m_{name}").over(upto))
    out = rows.join(carry, [*keys, "_chunk"])
    return out.select(*df.columns, *[(F.col(f"_r_{n}") + F.col(f"_c_{n}")).alias(n) for n in measures])


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                 value: Column, name: str) -> DataFrame:
    """Add the latest non-null ``value`` at or before each row of its key."""
    inside, across = _windows(keys, order)
    rows = df.withColumn("_chunk", chunk).withColumn("_v", value)
    carry = (
        rows.filter(F.col("_v").isNotNull())
        .groupBy(*keys, "_chunk")
        .agg(F.max_by("_v", F.struct(*order)).alias("_last"))
    )
    chunks = rows.select(*keys, "_chunk").distinct().join(carry, [*keys, "_chunk"], "left")
    prior = across.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(prior).alias("_carry"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_here", F.last("_v", ignorenulls=True).over(upto))
    return rows.join(chunks, [*keys, "_chunk"]).select(
        *df.columns, F.coalesce("_here", "_carry").alias(name))


def next_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
               value: Column, name: str) -> DataFrame:
    """Add the ``value`` of the following row of the key (null on the last)."""
    inside, across = _windows(keys, order)
    rows = df.withColumn("_chunk", chunk).withColumn("_v", value)
    firsts = rows.groupBy(*keys, "_chunk").agg(F.min_by("_v", F.struct(*order)).alias("_first"))
    firsts = firsts.select(*keys, "_chunk", F.lead("_first").over(across).alias("_carry"))
    # Only a chunk's last row looks into the next chunk; a null that follows inside the chunk stays null.
    rows = rows.withColumn("_here", F.lead("_v").over(inside)).withColumn("_more", F.lead(F.lit(True)).over(inside))
    return rows.join(firsts, [*keys, "_chunk"]).select(
        *df.columns, F.when(F.col("_more"), F.col("_here")).otherwise(F.col("_carry")).alias(name))


def salted_lookup(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join to a table holding one row per key when the row side may have hot keys.

    The row side is spread over as many buckets per key as the session shuffles into, so a key of any size
    reaches every task; the lookup side is repeated only for the buckets a key has, once for a cold key's row.
    """
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.lit(salts)).cast("int"))
    right = left.select(*on, "_salt").distinct().join(lookup, list(on))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def medians(df: DataFrame, keys: Sequence[str], value: str, width: int = 60_000, name: str = "median") -> DataFrame:
    """Exact median per key from running counts over the distinct values; no group's values are held at once."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, keys, [value], by_position(value, width), {"_upto": F.col("_n")})
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    at_least = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col(value)))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    rows = salted_lookup(ranked, totals, keys)
    return rows.groupBy(*keys).agg(((at_least(low) + at_least(high)) / 2).alias(name))
