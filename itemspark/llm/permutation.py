"""Nearest neighbours by largest inner product through a permutation index.

Pivots are chosen, far from each other, from a bounded sample of the vectors. A vector is represented by its ``PREFIX`` nearest pivots in order
and posted in their inverted files with its place there. Candidates are ranked by the footrule distance of the
two orders, a missing pivot counting as one place past the end; the distance falls by twice
``PREFIX - max(place, place)`` for every shared pivot, which is what the postings add up. The best
``CANDIDATES`` of a block are ranked again by inner product in double precision.

For the orders only, vectors get one more component that makes all of them as long as the longest (queries
get 0), so that the nearest in distance are those of the largest inner product.

Equal vectors are one entry with its smallest ids, as many as a result can need, and how often each stands there.
A query's own id is no result, whatever rows hold it: hits are kept until ``k`` are left without any one id. Index
and queries are dealt into blocks; every query block meets every index block in a group of bounded size, and only the best of each
group are shuffled on. Pivots are sampled by hash, all vectors are indexed.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do ids that are
null or lengths other than the most frequent (ties: the longest). Equal scores go by the smaller id. Rows that
repeat an id are candidates once each, queries once. Other columns play no part; an empty table, or one without
a query, gives an empty result; fewer candidates than asked for give all.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from itemspark.llm.common import ship
from itemspark.session import work_dir

PIVOTS, PREFIX = 256, 64
#: Vectors, the first by hash, that pivots are chosen from.
SAMPLE = 4_096
#: Share of a block's vectors that are ranked again, and the least number.
CANDIDATES, LEAST = 0.15, 512
INDEX_BLOCK, QUERY_BLOCK = 4_096, 2_048
SCHEMA = "query_id bigint, rank int, vec_id bigint, score double"


def _usable(vector: Column) -> Column:
    """Not null, of finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def orders(vectors: np.ndarray, extra: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first, equal ones by number."""
    full = np.c_[vectors, extra]
    away = (pivots * pivots).sum(1)[None, :] - 2 * full @ pivots.T
    return np.argsort(away, axis=1, kind="stable")[:, :prefix].astype(np.int32)


def spread(sample: np.ndarray, many: int) -> np.ndarray:
    """``many`` of the sample, each the farthest from those before it: pivots of one cluster tell little apart."""
    chosen, away = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(many, len(sample)):
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(away.argmax()))
    return sample[chosen]


class Block:
    """The inverted files of some vectors."""

    def __init__(self, order: np.ndarray):
        self.n, self.prefix = order.shape
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.member, self.place = (by_pivot // self.prefix).astype(np.int64), (by_pivot % self.prefix).astype(np.int32)
        pivots, first = np.unique(flat[by_pivot], return_index=True)
        ends = np.r_[first[1:], len(flat)]
        self.files = {p: (a, b) for p, a, b in zip(pivots.tolist(), first.tolist(), ends.tolist(), strict=True)}

    def candidates(self, order: np.ndarray, many: int) -> np.ndarray:
        """The members nearest by footrule to one query's order."""
        if many >= self.n:
            return np.arange(self.n)
        near = np.zeros(self.n, np.int32)
        for k, pivot in enumerate(order.tolist()):
            if pivot in self.files:
                a, b = self.files[pivot]
                near[self.member[a:b]] += self.prefix - np.maximum(self.place[a:b], k)
        cut = np.partition(near, self.n - many)[self.n - many]
        return np.flatnonzero(near >= cut)  # all of those at the cut, so that ties do not depend on order


def _enough(ids: list[int], counts: list[int], k: int) -> int:
    """How many of the ranked hits to keep so that ``k`` rows stay without those of any one id, if there are so many."""
    held: dict[int, int] = {}
    total = most = 0
    for n, (x, many) in enumerate(zip(ids, counts, strict=True)):
        if total - most >= k:
            return n
        more = min(many, k - held.get(x, 0))
        held[x] = held.get(x, 0) + more
        total, most = total + more, max(most, held[x])
    return len(ids)


def neighbours(df: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Of every row whose id is divisible by ``every``, its ``k`` nearest other rows: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    ship(spark)
    folder = work_dir(spark, "permutation")
    rows = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], SCHEMA)
    # Equal vectors have the same 128 bits of key; k + 1 of their distinct ids are the most that a result can hold,
    # one of which may be the query's own. An id that is repeated with its vector stands once, with its count.
    rows = rows.where(F.size("v") == sizes[0][0]).select("vec_id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    distinct = rows.groupBy("a", "b", "vec_id").agg(F.first("v").alias("v"), F.count("*").alias("times"))
    smallest = distinct.withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    ids = F.sort_array(F.collect_list(F.struct("vec_id", F.least("times", F.lit(k)).alias("times"))))
    entries = _kept(smallest.groupBy("a", "b").agg(F.first("v").alias("v"), ids.alias("ids")), f"{folder}/entries")
    asked = _kept(rows.where(F.col("vec_id") % every == 0).select("vec_id", "a", "b").distinct(), f"{folder}/asked")

    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, longest = entries.agg(F.count("*"), F.max(squared)).first()
    sample = np.array([r[0] for r in entries.orderBy("a", "b").limit(SAMPLE).select("v").collect()])
    pivots = spread(np.c_[sample, np.sqrt(np.maximum(longest - (sample * sample).sum(1), 0))], PIVOTS)
    prefix = min(PREFIX, len(pivots))

    def index(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(2))
            order = orders(v, np.sqrt(np.maximum(longest - (v * v).sum(1), 0)), pivots, prefix)
            asked_as = orders(v, np.zeros(len(v)), pivots, prefix)
            lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, prefix, dtype=np.int32), pa.array(x.ravel())) for x in (order, asked_as)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "posted", "sought"])

    fields = [*entries.schema.fields, T.StructField("posted", T.ArrayType(T.IntegerType())), T.StructField("sought", T.ArrayType(T.IntegerType()))]
    indexed = _kept(entries.mapInArrow(index, T.StructType(fields)), f"{folder}/index")
    # Read anew, so that the two sides of the search have no column in common.
    again = spark.read.parquet(f"{folder}/index")
    queries = again.join(asked.select("a", "b").distinct(), ["a", "b"]).select("a", "b", "v", "sought")
    index_blocks, query_blocks = ceil(n / INDEX_BLOCK), max(1, ceil(asked.select("a", "b").distinct().count() / QUERY_BLOCK))
    deal = lambda blocks: F.pmod(F.xxhash64("a", "b"), F.lit(blocks)).cast("int")
    numbers = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = indexed.select(deal(index_blocks).alias("vb"), numbers(query_blocks).alias("qb"), "v", "ids", "posted")
    right = queries.select(numbers(index_blocks).alias("vb"), deal(query_blocks).alias("qb"), "a", "b", "v", "sought")

    def search(members: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["a", "b", "vec_id", "score", "times"]
        out: list[list] = [[], [], [], [], []]
        if members.num_rows and wanted.num_rows:
            v, q = _matrix(members["v"]), _matrix(wanted["v"])
            block, sought = Block(_matrix(members["posted"])), _matrix(wanted["sought"])
            ids = members["ids"].to_pylist()
            least = np.array([x[0]["vec_id"] for x in ids])
            many = max(LEAST, ceil(CANDIDATES * len(v)))
            for i, (a, b) in enumerate(zip(wanted["a"].to_pylist(), wanted["b"].to_pylist(), strict=True)):
                at = block.candidates(sought[i], many)
                score = (v[at] * q[i]).sum(1)
                best = np.lexsort((least[at], -score))
                # The smallest id of every entry before another is ahead of all ids of that one.
                best = best[:_enough(least[at[best]].tolist(), [1] * len(best), k)]
                found = sorted((-score[x], vec["vec_id"], vec["times"]) for x in best.tolist() for vec in ids[at[x]])
                found = found[:_enough([vec for _, vec, _ in found], [times for _, _, times in found], k)]
                out[0] += [a] * len(found)
                out[1] += [b] * len(found)
                out[2] += [vec for _, vec, _ in found]
                out[3] += [-s for s, _, _ in found]
                out[4] += [times for _, _, times in found]
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=names)

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInArrow(search, "a bigint, b bigint, vec_id bigint, score double, times bigint")
    # With k hits of an id at most, 2 k hits leave k without any one id.
    ranked = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    found = found.repartition("a", "b").withColumn("n", ranked("a", "b", "vec_id")).where(F.col("n") <= k)
    found = found.withColumn("n", ranked("a", "b")).where(F.col("n") <= 2 * k)
    best = _kept(found.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "times"))).alias("found")), f"{folder}/found")
    # A copied vector asks often: this join has plain exchanges on both sides, so that Spark can split it.
    answers = asked.withColumnRenamed("vec_id", "query_id").join(best, ["a", "b"])
    others = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    others = F.slice(F.flatten(F.transform(others, lambda x: F.array_repeat(x, x["times"].cast("int")))), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
