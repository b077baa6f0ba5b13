"""Merging two copies of a history, keyed upserts and patches, idempotent import counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemspark.operators.progress import KEYS, ORDER, progress


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Last write wins per key; ``version`` columns order the writes of both frames."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    both = base.unionByName(changes, allowMissingColumns=True)
    return both.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") == 1).drop("_rn")


def patch(base: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str],
          defaults: dict[str, object]) -> DataFrame:
    """Partial-column update. ``<column>_set`` in ``changes`` says a column is present, so an explicit
    null clears; a key without a record starts from ``defaults``."""
    c = changes.select(*keys, *[F.col(x).alias(f"_n_{x}") for x in columns],
                       *[F.col(f"{x}_set").alias(f"_p_{x}") for x in columns])
    both = base.withColumn("_known", F.lit(True)).join(c, list(keys), "full_outer")
    out = []
    for name in base.columns:
        if name in keys:
            out.append(F.col(name))
            continue
        value = F.col(name)
        if name in defaults and defaults[name] is not None:
            value = F.when(F.col("_known").isNull(), F.lit(defaults[name]).cast(base.schema[name].dataType)).otherwise(value)
        if name in columns:
            value = F.when(F.coalesce(F.col(f"_p_{name}"), F.lit(False)), F.col(f"_n_{name}")).otherwise(value)
        out.append(value.alias(name))
    return both.select(*out)


def merge_attempts(local: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEYS, at: str = "at") -> DataFrame:
    """Union of two attempt histories on (key, time); the local copy wins a collision."""
    both = local.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys, at).orderBy("_side")
    return both.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", "_side")


def merge_records(local: DataFrame, incoming: DataFrame, merged_attempts: DataFrame,
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Merge stored records: schedule from the side answered last (tie: local), counts from the merged
    attempts, own notes and corrections local first."""
    names = ["box", "due_at", "last_at", "correction", "notes"]
    l = local.select(*keys, *[F.col(n).alias(f"l_{n}") for n in names], F.lit(True).alias("in_local"))
    i = incoming.select(*keys, *[F.col(n).alias(f"i_{n}") for n in names], F.lit(True).alias("in_incoming"))
    counts = merged_attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"),
                                                F.count_if(~F.col("correct")).alias("times_wrong"))
    both = l.join(i, list(keys), "full_outer").join(counts, list(keys), "left")
    take_incoming = F.col("in_local").isNull() | F.coalesce(
        F.col("i_last_at").isNotNull() & (F.col("l_last_at").isNull() | (F.col("i_last_at") > F.col("l_last_at"))), F.lit(False))
    pick = lambda n: F.when(take_incoming, F.col(f"i_{n}")).otherwise(F.col(f"l_{n}")).alias(n)
    return both.select(
        *keys, pick("box"), pick("due_at"),
        F.coalesce("attempts", F.lit(0).cast("bigint")).alias("attempts"),
        F.coalesce("times_wrong", F.lit(0).cast("bigint")).alias("times_wrong"),
        F.coalesce("l_correction", "i_correction").alias("correction"),
        F.coalesce("l_notes", "i_notes").alias("notes"))


def import_outcomes(local: DataFrame, incoming: DataFrame, merged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per incoming record: ``skipped`` when merging changes nothing, else ``imported``."""
    fields = ["box", "due_at", "attempts", "times_wrong", "correction", "notes"]
    old = local.select(*keys, F.struct(*fields).alias("_old"))
    new = merged.select(*keys, F.struct(*fields).alias("_new"))
    rows = incoming.select(*keys).join(new, list(keys)).join(old, list(keys), "left")
    return rows.select(*keys, F.when(F.col("_old").isNotNull() & F.col("_old").eqNullSafe(F.col("_new")), "skipped")
                       .otherwise("imported").alias("outcome"))


def import_counts(outcomes: DataFrame, n_malformed: int = 0) -> DataFrame:
    return outcomes.agg(F.count_if(F.col("outcome") == "imported").alias("imported"),
                        (F.count_if(F.col("outcome") == "skipped") + F.lit(n_malformed)).alias("skipped"))


def import_sessions(known: DataFrame, incoming: DataFrame, key: str = "session_id") -> DataFrame:
    """Keep every known session; add only unknown ids."""
    return known.unionByName(incoming.join(known.select(key), key, "left_anti"), allowMissingColumns=True)


def save_sessions(known: DataFrame, saved: DataFrame, key: str = "session_id") -> DataFrame:
    """Replace on id: a saved session supersedes the stored one."""
    return known.join(saved.select(key), key, "left_anti").unionByName(saved, allowMissingColumns=True)


def replay(merged_attempts: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """State recomputed from the merged history, instead of taken from the fresher side."""
    return progress(merged_attempts, keys, order)
