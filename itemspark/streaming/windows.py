"""Sittings and days whose state leaves the engine, and late attempts that touch only their own keys.

``sittings_by_gap`` closes a sitting when the watermark has passed its last attempt by the gap; ``open_days`` emits a
day each time it grows and forgets it when the watermark has passed it. Both keep what is open and nothing else. A hot
learner's attempts are merged into sittings before the shuffle if ``LOCAL_MERGE`` is set on the session.

``LateReplay`` folds attempts that come in order onto the stored state and replays the keys of those that come late.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from itemspark.operators.progress import KEYS, ORDER, progress
from itemspark.session import work_dir
from itemspark.sources.stored import KeyedTable

LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def sittings_by_gap(stream: DataFrame, keys: Sequence[str] = ("learner",), at: str = "at", gap: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """One row per ended sitting: keys, started_at, last_at, n, n_correct. For append mode.

    A sitting ends with the attempt that none follows within the gap; nobody has to say so. An attempt later than the
    delay reopens nothing: the engine drops it and counts it, and :class:`LateReplay` is the path for it. A row
    without a time belongs to no sitting.
    """
    window = F.session_window(at, gap)
    return stream.withWatermark(at, delay).groupBy(window, *keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("n_correct"), F.max(at).alias("last_at"),
    ).select(*keys, F.col("session_window.start").alias("started_at"), "last_at", "n", "n_correct")


def open_days(stream: DataFrame, keys: Sequence[str] = (), at: str = "at", delay: str = "1 day") -> DataFrame:
    """Attempts and correct per tumbling day and keys. Update mode gives every day that grew; append mode a day when it is over."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, "1 day"), *keys).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("correct")).alias("n_correct")
    ).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), *keys, "attempts", "n_correct")


def day_table(root: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``open_days`` in update mode: a table by day and, within it, by batch; read it with :func:`days`.

    A batch writes the totals that it changed. Replayed, it writes the same files anew. The table belongs to one
    checkpoint, as the totals do.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        placed = batch.withColumn("epoch", F.lit(epoch).cast("bigint")).hint("rebalance", "day")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "epoch").parquet(f"{root}/days")
    return write


def days(spark: SparkSession, root: str, keys: Sequence[str] = ()) -> DataFrame:
    """The newest totals of every day (and keys)."""
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(f"{root}/days")
    newest = rows.withColumn("day", F.date_format("day", "yyyy-MM-dd")).groupBy("day", *keys).agg(F.max_by(F.struct("attempts", "n_correct"), F.col("epoch").cast("bigint")).alias("t"))
    return newest.select("day", *keys, "t.attempts", "t.n_correct")


class LateReplay:
    """Review state per key by event time, whatever the order of arrival; a sink for an append-mode stream.

    ``attempts`` and state lie in buckets by the hash of their keys. A batch first adds its attempts to the store.
    A key none of whose new attempts is older than its state takes them on top of that state. A key with a late one
    (as old as its last attempt, or without a time) or with a null in the key is replayed from the store: only the buckets of such keys are read.
    The state of the batch's keys is replaced in its buckets. A batch run again after a failure finds its attempts
    as old as the state, so it replays them, each once; the result is the same.
    """

    def __init__(self, root: str, schema: StructType, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, buckets: int = 64):
        self.root, self.schema, self.keys, self.order = root, schema, list(keys), list(order)
        self.store = KeyedTable(f"{root}/store", keys, schema, buckets)
        self.buckets = buckets

    def _state(self, spark: SparkSession) -> KeyedTable:
        empty = spark.createDataFrame([], self.schema)
        return KeyedTable(f"{self.root}/now", self.keys, progress(empty, self.keys, self.order).schema, self.buckets)

    def _attempts(self, spark: SparkSession) -> DataFrame:
        layout = [StructField("_run", StringType()), StructField("_bucket", IntegerType())]
        return spark.read.schema(StructType([*self.schema.fields, *layout])).parquet(f"{self.root}/store")

    def stored(self, spark: SparkSession, buckets: Sequence[int]) -> DataFrame:
        """The attempts of some buckets, each once."""
        rows = self._attempts(spark).filter(F.col("_bucket").isin(list(buckets)))
        return rows.select(*self.schema.names).dropDuplicates([*self.keys, self.order[-1]])

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        run = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or 'batch'}_{epoch}"
        placed = batch.select(*self.schema.names).withColumn("_bucket", self.store.bucket()).withColumn("_run", F.lit(run))
        placed.hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run", "_bucket").parquet(f"{self.root}/store")
        fresh = self._attempts(spark).filter(F.col("_run") == run).select(*self.schema.names).dropDuplicates([*self.keys, self.order[-1]])
        state, touched = self._state(spark), self.store.touched(fresh)
        if not touched:
            return
        if not self._begun(spark):
            state.create(progress(fresh, self.keys, self.order))
            return
        old = state.read(spark, touched)
        same = [F.col(f"_n_{k}").eqNullSafe(F.col(k)) for k in self.keys]
        first = fresh.groupBy(*[F.col(k).alias(f"_n_{k}") for k in self.keys]).agg(
            F.min(self.order[0]).alias("_first"), F.bool_or(F.col(self.order[0]).isNull()).alias("_timeless"))
        nameless = reduce(or_, [F.col(f"_n_{k}").isNull() for k in self.keys])
        behind = F.col("_timeless") | (F.col("_first") <= F.col("last_at")) | F.col("last_at").isNull() | nameless
        late_path = work_dir(spark, "late")
        first.join(old, same).filter(behind).select(*[f"_n_{k}" for k in self.keys]).write.parquet(late_path)
        late = spark.read.parquet(late_path)
        named = late.select(*[F.col(f"_n_{k}").alias(k) for k in self.keys])
        seed = old.join(late, same, "left_anti")
        new = progress(fresh.join(late, same, "left_anti"), self.keys, self.order, seed=seed)
        again = self.store.touched(named)
        if again:
            new = new.unionByName(progress(self.stored(spark, again).join(late, same, "left_semi"), self.keys, self.order))
        state.replace(new)

    def _begun(self, spark: SparkSession) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/now/_SUCCESS")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._state(spark).read(spark)
