"""Duplicates, parent groups and lookups keyed by content hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.functions.identity import background_key
from itemspark.functions.text import strip
from itemspark.operators.scans import salted_lookup


def duplicate_groups(items: DataFrame, key: str, id_col: str, fields: Sequence[str] = ()) -> DataFrame:
    """One row per hash held by more than one item: size, first and last id, fields that differ.

    A null is a value like any other: it differs from every value and equals another null.
    """
    some_null = lambda f: F.count(f).between(1, F.count(F.lit(1)) - 1)
    differs = [(F.coalesce(F.min(f) != F.max(f), F.lit(False)) | some_null(f)).alias(f"differs_{f}") for f in fields]
    return items.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_members"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"), *differs
    ).filter(F.col("n_members") > 1)


def duplicate_members(items: DataFrame, key: str, id_col: str) -> DataFrame:
    """Every member of a duplicate group, one row each, with its group's first id.

    Groups are never gathered. A key's rows are spread over as many buckets as the session shuffles into, and
    its summary row is repeated for the buckets that were counted for it.
    """
    buckets = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = items.select(key, id_col, F.pmod(F.xxhash64(id_col), F.lit(buckets)).cast("int").alias("_bucket"))
    some = rows.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_first"))
    groups = some.groupBy(key).agg(F.sum("_n").alias("n_members"), F.min("_first").alias("first_id"), F.collect_list("_bucket").alias("_buckets"))
    groups = groups.filter(F.col("n_members") > 1).withColumn("_bucket", F.explode("_buckets")).drop("_buckets")
    return rows.join(groups, [key, "_bucket"]).drop("_bucket")


def parent_groups(items: DataFrame, id_col: str, background: str = "background",
                  min_chars: int = k.MIN_BACKGROUND_CHARS, key_chars: int = k.BACKGROUND_KEY_CHARS) -> DataFrame:
    """Parents sharing the opening of a background: id, text of the first member, member count.

    Parents whose text is shorter than ``min_chars`` are dissolved. Only ids are reduced; the text is
    fetched for the first member alone.
    """
    keyed = items.filter(F.length(background) > 0).select(id_col, background, background_key(F.col(background), key_chars).alias("_k"))
    firsts = keyed.groupBy("_k").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n_items"))
    text = strip(F.col(background))
    parents = firsts.join(keyed.select(id_col, text.alias("background")), id_col)
    return parents.filter(F.length("background") >= min_chars).select(
        F.concat(F.lit("cs-"), F.col("_k")).alias("group_id"), F.col(id_col).alias("first_id"), "background", "n_items")


def link_parents(items: DataFrame, parents: DataFrame, background: str = "background",
                 key_chars: int = k.BACKGROUND_KEY_CHARS) -> DataFrame:
    """Add ``group_id`` to each item; null without a background or when its parent was dissolved.

    Items without a background, most of a bank, take no part in the join.
    """
    has_one = F.coalesce(F.length(background) > 0, F.lit(False))
    rows = items.filter(has_one).withColumn("_g", F.concat(F.lit("cs-"), background_key(F.col(background), key_chars)))
    known = parents.select(F.col("group_id").alias("_g"), F.lit(True).alias("_known"))
    out = salted_lookup(rows, known, ["_g"], "left")
    out = out.withColumn("group_id", F.when(F.col("_known"), F.col("_g"))).drop("_g", "_known")
    return out.unionByName(items.filter(~has_one).withColumn("group_id", F.lit(None).cast("string")))


def lookup_parent(children: DataFrame, parents: DataFrame, on: Column | str, how: str = "left") -> DataFrame:
    """Child to parent lookup; the optimizer broadcasts the parents when their size allows."""
    return children.join(parents, on, how)


def bound_history(history: DataFrame, items: DataFrame, key: str = "content_hash") -> DataFrame:
    return history.join(items, key)


def orphan_history(history: DataFrame, items: DataFrame, key: str = "content_hash") -> DataFrame:
    return history.join(items.select(key), key, "left_anti")


def corrections(records: DataFrame, items: DataFrame, key: str = "content_hash", id_col: str = "item_id") -> DataFrame:
    """Records with the user's own correction, newest answer first, then id."""
    rows = records.filter(F.length("correction") > 0).join(items, key)
    return rows.orderBy(F.col("last_at").desc_nulls_last(), id_col)


def unresolved_refs(refs: DataFrame, files: DataFrame, on: str) -> DataFrame:
    return refs.join(files.select(on), on, "left_anti")


def undersized_refs(refs: DataFrame, files: DataFrame, on: str, size: str, floor: Column) -> DataFrame:
    return refs.join(files.select(on, size), on).filter(F.col(size) < floor)


ID_BLOCK = 1_000_000


def missing_ids(ids: DataFrame, column: str, upto: DataFrame) -> DataFrame:
    """Expected 1..N minus present; ``upto`` is a one-row frame holding N.

    The range is made in blocks of a million ids that are spread before they are expanded.
    """
    n = F.col(upto.columns[0]).cast("bigint")
    blocks = upto.select(n.alias("_n"), F.explode(F.sequence(F.lit(0), F.floor(n / ID_BLOCK).cast("bigint"))).alias("_b")).repartition("_b")
    low = F.greatest(F.lit(1).cast("bigint"), F.col("_b") * ID_BLOCK)
    high = F.least(F.col("_n"), F.col("_b") * ID_BLOCK + (ID_BLOCK - 1))
    expected = blocks.filter(low <= high).select(F.explode(F.sequence(low, high)).alias(column))
    return expected.join(ids.select(column), column, "left_anti")
