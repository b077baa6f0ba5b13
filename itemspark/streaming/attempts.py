"""The attempt feed as Structured Streaming.

State lives in tables below a shared root: each micro-batch appends summaries of its own keys, which add up to
the state when read (``Summaries``). Replaying a batch after a failure overwrites its own rows, so every update
is applied exactly once. Reducing a batch is an ordinary DataFrame job: a hot key is chunked and pre-aggregated
there as in the batch operators, instead of passing through one stateful task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from itemspark.operators.progress import KEYS, ORDER, chunk_runs, combine_runs, progress, state_of_runs
from itemspark.sources.backup import judge

def keep_advanced(rows: DataFrame) -> DataFrame:
    """A sitting ended early keeps its answered rows and drops the one never advanced."""
    return rows.filter(F.col("advanced_at").isNotNull())


def with_default_confidence(rows: DataFrame) -> DataFrame:
    """Sittings collect no confidence; such answers count as unsure."""
    return rows.withColumn("confidence", F.coalesce("confidence", F.lit("unsure")))


def once_per_position(stream: DataFrame, keys: Sequence[str] = ("session_id", "pos"), at: str = "at", delay: str = "1 hour") -> DataFrame:
    """One attempt per session and position: repeats arriving within the delay are dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def daily_counts(stream: DataFrame, at: str = "at", delay: str = "1 day") -> DataFrame:
    """Attempts and correct per tumbling day. Use complete or update mode: append holds the last days back."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, "1 day")).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("correct")).alias("n_correct")
    ).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "attempts", "n_correct")


def run_to_end(stream: DataFrame, root: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process everything available through ``sink`` and stop; the checkpoint lives below ``root``."""
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
             .foreachBatch(sink).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def version_path(root: str, epoch: int) -> str:
    return f"{root}/state/epoch={epoch}"


def _folders(spark: SparkSession, parent: str) -> list[str]:
    """Names of the folders below ``parent``, by the file system's own listing; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in files.listStatus(path) if x.isDirectory()) if files.exists(path) else []


def _written(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _newest(spark: SparkSession, parent: str, name: str) -> int | None:
    """The highest committed ``name=number`` below a folder; no data are read."""
    numbers = sorted((int(x.split("=")[1]) for x in _folders(spark, parent) if x.startswith(f"{name}=")), reverse=True)
    return next((n for n in numbers if _written(spark, f"{parent}/{name}={n}")), None)


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version of a table that is written whole for every batch."""
    return spark.read.parquet(version_path(root, _newest(spark, f"{root}/state", "epoch")))


class Summaries:
    """State as additive summaries: every micro-batch appends one row for each key it holds.

    ``reduce`` makes a batch's rows, ``combine`` adds rows of one key up in the order of ``_chunk``. What a batch
    writes follows the batch; every ``every`` batches the rows so far are combined into a base, and a reader
    takes the newest base and the batches after it. A replayed batch overwrites its own rows. A stream that
    begins anew (another checkpoint) goes on behind what is stored.
    """

    def __init__(self, root: str, reduce: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame], DataFrame], every: int = 16):
        self.root, self.reduce, self.combine, self.every = root, reduce, combine, every

    def _first_chunk(self, spark: SparkSession) -> tuple[int, str]:
        """Where this query's batches begin, and their folder; the folder keeps the number."""
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        runs = [x for x in _folders(spark, f"{self.root}/batches")]
        for name in runs:
            if name.endswith(f"_{query}"):
                return int(name.split("_")[1]), f"{self.root}/batches/{name}"
        used = [int(n.split("_")[1]) + int(e.split("=")[1]) for n in runs for e in _folders(spark, f"{self.root}/batches/{n}")]
        start = max(used, default=-1) + 1
        return start, f"{self.root}/batches/run_{start}_{query}"

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        start, folder = self._first_chunk(spark)
        chunk = start + epoch
        self.reduce(batch).withColumn("_chunk", F.lit(chunk).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        if (chunk + 1) % self.every == 0:
            self.read(spark).withColumn("_chunk", F.lit(chunk).cast("bigint")).write.mode("overwrite").parquet(f"{self.root}/base/upto={chunk}")

    def read(self, spark: SparkSession) -> DataFrame:
        """One combined row per key."""
        base = _newest(spark, f"{self.root}/base", "upto")
        later = [f"{self.root}/batches/{run}/{epoch}" for run in _folders(spark, f"{self.root}/batches") for epoch in _folders(spark, f"{self.root}/batches/{run}")
                 if base is None or int(run.split("_")[1]) + int(epoch.split("=")[1]) > base]
        return self.combine(spark.read.parquet(*([f"{self.root}/base/upto={base}"] if base is not None else []), *later))


def fold_batches(root: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, chunk: Column | None = None, every: int = 16) -> Summaries:
    """Review state per key in arrival order of the micro-batches; read it with :func:`folded`."""
    return Summaries(root, lambda batch: combine_runs(chunk_runs(batch, keys, order, chunk), keys), lambda rows: combine_runs(rows, keys), every)


def folded(spark: SparkSession, root: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    return state_of_runs(fold_batches(root, keys, order).read(spark), keys, order)


def sum_sessions(root: str, every: int = 16) -> Summaries:
    """Growing sessions, saved with every micro-batch, so one abandoned halfway still counts."""
    keys = ("learner", "session_id")
    return Summaries(
        root,
        lambda batch: batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct")).alias("n_correct"), F.max("event_id").alias("last_event")),
        lambda rows: rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_correct").alias("n_correct"), F.max("last_event").alias("last_event")), every)


def store_attempts(root: str, keys: Sequence[str] = ("learner", "content_hash", "event_id")) -> Callable[[DataFrame, int], None]:
    """Append-only attempt store for the late path: out-of-order rows are kept and replayed by time."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.dropDuplicates(list(keys)).write.mode("overwrite").parquet(version_path(root, epoch))
    return write


def replay_store(spark: SparkSession, root: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """State of the stored attempts in event-time order, whatever order they arrived in."""
    rows = spark.read.parquet(f"{root}/state").drop("epoch").dropDuplicates([*keys, order[-1]])
    return progress(rows, keys, order)


def split_sinks(root: str, raw: str, reason: Callable[[Column], Column], parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Sound events to one table, malformed ones with a reason to another; the query itself never fails on them."""
    def write(batch: DataFrame, epoch: int) -> None:
        judged = judge(batch, raw, reason)
        parse(judged.filter(F.col("reason").isNull()).drop("reason")).write.mode("overwrite").parquet(f"{root}/good/epoch={epoch}")
        judged.filter(F.col("reason").isNotNull()).write.mode("overwrite").parquet(f"{root}/quarantine/epoch={epoch}")
    return write
