"""Review state as keyed state of the engine.

The state of a key is one run summary per chunk of time (a day, say), the same summaries that the batch fold adds up.
Chunks of a key lie in different shards, so a hot key is worked on by as many tasks as it has open chunks, and what a
shard holds is one list of summaries per chunk, of which the last of a key counts. It is read and appended to in pieces,
so that the trips between Python and the store follow the shards and not the keys. An event-time timer drops the list when
the watermark passes the chunk's end: the state holds open chunks only. Every change of a summary is emitted; a table of the changes takes the newest
per key and chunk, so nothing is written anew.

Attempts of one chunk are folded batch after batch, within a batch by time. Those later than the watermark are counted
and left out by the engine; ``windows.LateReplay`` is the path for them. Attempts without a time have no chunk and are
left out too. Keys may be null; they are cast to text and back, so they have types that this keeps. An attempt without
a verdict is not a wrong one; one without a number comes first of its moment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from itemspark.operators.progress import KEYS, ORDER, combine_runs, is_guess, state_of_runs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Summaries that go to the store in one message.
PIECE = 1_000
SUMMARY = ("has_wrong boolean, n bigint, wrongs bigint, run_len bigint, run_sure bigint, first_at bigint, first_id bigint, first_guess boolean, "
           "last_at bigint, last_id bigint, last_correct boolean, last_confidence string")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started within use the state store that keyed state needs."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def folded_summary(held: tuple | None, attempts: Iterator[tuple]) -> tuple:
    """A summary after more attempts (at, id, correct, guess, confidence)."""
    wrong, n, wrongs, run, sure, first_at, first_id, first_guess, *last = held or (False, 0, 0, 0, 0, None, None, None, None, None, None, None)
    for at, number, correct, guess, confidence in attempts:
        n += 1
        if correct is False:
            wrong, wrongs, run, sure, first_at, first_id, first_guess = True, wrongs + 1, 0, 0, None, None, None
        else:
            if not run:
                first_at, first_id, first_guess = at, number, guess
            run, sure = run + 1, sure + (not guess)
        last = [at, number, correct, confidence]
    return wrong, n, wrongs, run, sure, first_at, first_id, first_guess, *last


class Runs(StatefulProcessor):
    """Summaries of the keys of one shard and chunk."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", ", ".join([*[f"`{k}` string" for k in self.keys], SUMMARY]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: dict[tuple, list[tuple]] = {}
        for part in rows:
            # By position, since computed columns arrive without their names: shard, chunk, end, keys, time, then the attempt.
            places = [*range(3, 3 + len(self.keys)), *range(4 + len(self.keys), part.shape[1])]
            columns = [part.iloc[:, k].astype(object).where(part.iloc[:, k].notna(), None).tolist() for k in places]
            for row in zip(*columns, strict=True):
                found.setdefault(row[:len(self.keys)], []).append(row[len(self.keys):])
        held, listed = {}, 0
        for row in self.runs.get():
            held[tuple(row[:len(self.keys)])] = tuple(row[len(self.keys):])
            listed += 1
        out = []
        for name, attempts in found.items():
            attempts.sort(key=lambda r: (r[0], r[1]))
            held[name] = now = folded_summary(held.get(name), attempts)
            out.append((*name, key[1], *now))
        written = [(*name, *held[name]) for name in found]
        if listed + len(written) > 2 * len(held):  # more than half would be outdated
            self.runs.clear()
            written = [(*name, *now) for name, now in held.items()]
        for k in range(0, len(written), PIECE):
            self.runs.appendList(written[k:k + PIECE])
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(key[2])
        names = [*self.keys, "_chunk", *[c.split()[0] for c in SUMMARY.split(", ")]]
        # Objects, so that a column with nulls stays whole numbers.
        yield pd.DataFrame(out, columns=names, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.runs.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_runs(stream: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, chunk: str = "day", delay: str = "1 day", shards: int = 8) -> DataFrame:
    """Changed summaries per key and chunk, for update mode. ``chunk`` is a unit of ``date_trunc``; a hot feed takes a finer one."""
    start = F.date_trunc(chunk, order[0])
    end = F.unix_millis(start + F.expr(f"INTERVAL 1 {chunk}"))
    rows = stream.withWatermark(order[0], delay).select(
        F.pmod(F.xxhash64(*keys, start), F.lit(shards)).alias("_shard"), F.unix_micros(start).alias("_chunk"), end.alias("_end"),
        *[F.col(k).cast("string").alias(k) for k in keys], order[0],
        F.unix_micros(order[0]).alias("_at"), F.coalesce(F.col(order[1]).cast("bigint"), F.lit(-1 << 63)).alias("_id"), F.col("correct").alias("_correct"),
        is_guess().alias("_guess"), F.col("confidence").alias("_confidence")).filter("_chunk IS NOT NULL")
    # Keys are text on the way: whole numbers with a null among them would come to Python as floats.
    fields = ", ".join(f"`{k}` string" for k in keys)
    changed = rows.groupBy("_shard", "_chunk", "_end").transformWithStateInPandas(Runs(keys), f"{fields}, _chunk bigint, {SUMMARY}", "Update", "EventTime")
    return changed.select(*[F.col(k).cast(stream.schema[k].dataType).alias(k) for k in keys], *changed.columns[len(keys):])


def keep_changes(root: str) -> Callable[[DataFrame, int], None]:
    """A sink: the changed summaries of every batch; a replayed batch writes its own again."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/epoch={epoch}")
    return write


def folded_changes(spark: SparkSession, root: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Review state from the newest summary of every key and chunk."""
    rows = spark.read.parquet(f"{root}/changes")
    held = [c for c in rows.columns if c not in (*keys, "_chunk", "epoch")]
    runs = rows.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*held), "epoch").alias("r")).select(*keys, "_chunk", "r.*")
    at, number = order[0], order[1]
    first = F.struct(F.timestamp_micros("first_at").alias(at), F.col("first_id").alias(number), F.col("first_guess").alias("guess"))
    last = F.struct(F.timestamp_micros("last_at").alias(at), F.col("last_id").alias(number), F.col("last_correct").alias("correct"), F.col("last_confidence").alias("confidence"))
    runs = runs.withColumn("run_first", F.when(F.col("run_len") > 0, first)).withColumn("last", last)
    return state_of_runs(combine_runs(runs, keys), keys, order)
