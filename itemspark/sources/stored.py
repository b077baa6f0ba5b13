"""A keyed table in storage that takes small changes: a change rewrites the buckets of its keys, nothing else.

Rows lie in ``buckets`` folders by the hash of their keys. A change finds its buckets (at most ``buckets`` numbers),
reads only those, and replaces them by dynamic partition overwrite, which moves finished files into place at the
commit. A write that failed is repeated as it was: last write wins, so a bucket that took a change twice is the same.
One writer at a time.

Null keys have a bucket like any other. ``_bucket`` is the one name that rows must not have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from itemspark.operators.history import patch, upsert


def written_counting(rows: DataFrame, path: str, counters: Sequence[Column], mode: str = "errorifexists") -> DataFrame:
    """Write the rows as Parquet and return one row of counters, taken in the pass that writes.

    The counters are plain aggregates with names, computed where the rows are written, so nothing is scanned after it.
    Of rows that the optimizer knows to be none nothing passes; their counters are taken from the empty frame.
    """
    spark, seen = rows.sparkSession, Observation()
    none = rows.filter(F.lit(False)).agg(*counters)
    rows.observe(seen, *counters).write.mode(mode).parquet(path)
    found = seen.get
    return spark.createDataFrame([tuple(found[c] for c in none.columns)], none.schema) if found else none


class KeyedTable:
    def __init__(self, root: str, keys: Sequence[str], schema: StructType, buckets: int = 64):
        self.root, self.keys, self.schema, self.buckets = root, list(keys), schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, changes: DataFrame) -> list[int]:
        """The buckets that hold the keys of ``changes``."""
        return sorted(r[0] for r in changes.select(self.bucket()).distinct().collect())

    def read(self, spark: SparkSession, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets; other folders are pruned, not scanned."""
        rows = spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(self.root)
        return (rows if buckets is None else rows.filter(F.col("_bucket").isin(list(buckets)))).drop("_bucket")

    def create(self, rows: DataFrame) -> None:
        """The table anew, from these rows."""
        self._write(rows, "static")

    def replace(self, rows: DataFrame) -> None:
        """The buckets that ``rows`` fill, written anew; others stay."""
        self._write(rows, "dynamic")

    def upsert(self, changes: DataFrame, version: Sequence[str]) -> list[int]:
        """Last write wins per key, by the ``version`` columns; returns the buckets rewritten."""
        buckets = self.touched(changes)
        if buckets:
            self.replace(upsert(self.read(changes.sparkSession, buckets), changes, self.keys, version))
        return buckets

    def patch(self, changes: DataFrame, columns: Sequence[str], defaults: dict[str, object]) -> list[int]:
        """Some columns of some records, as :func:`itemspark.operators.history.patch`; returns the buckets rewritten."""
        buckets = self.touched(changes)
        if buckets:
            self.replace(patch(self.read(changes.sparkSession, buckets), changes, self.keys, columns, defaults))
        return buckets

    def _write(self, rows: DataFrame, how: str) -> None:
        placed = rows.select(*self.schema.names).withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket")
        placed.write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy("_bucket").parquet(self.root)
