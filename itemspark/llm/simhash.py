"""SimHash near-duplicates through BK-trees.

Fingerprints: lower-case words, shingles of ``words`` of them, each hashed to 64 bits; a bit is 1 if it is set
in over half the hashes. Equal fingerprints are one node, named by its smallest doc_id. Two fingerprints at
most ``radius`` bits apart agree on one of ``radius + 1`` bands and, in what is left, on one of as many
sub-bands, so every node goes to the shards of its (band, sub-band) values, and no link is missed. A shard's
fingerprints make a BK-tree, whose children are keyed by their integer Hamming distance to the parent; a search
follows only the edges within the radius of its own distance. Shard trees reach the tasks that search them
through the shuffle: broadcasting would collect the fingerprints of all documents on the driver. A shard above
``BLOCK`` fingerprints is dealt into blocks, and every pair of blocks is a tree and its searches.

Each tree gives the edges of a spanning forest, not its pairs. Components are found by repeated minimum labels
with pointer jumping over tables in the shared folder, which is also where fingerprints are kept, so that lost
executors cost no recomputation. The tables that a hot key is joined with are read from there too, which lets
Spark split skewed partitions.

Null and empty texts have fingerprint zero and are linked like any other. Documents without an id take part;
their component is null unless it holds an id. Repeated rows are one row each in ``components`` and one
document to ``deduplicated``. Ties do not arise: components are named by the smallest id. Other columns play
no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.llm.common import pieces, ship
from itemspark.session import work_dir

BLOCK = 2_048
SEED = 42
#: Names of nodes all of whose documents lack an id begin here.
NAMELESS = 1 << 62


def fingerprint(text: bytes, words: int) -> int:
    """The fingerprint as a signed number. Words are runs of bytes other than blanks, tabs and line ends."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_digest
    if len(found) <= words:
        return int.from_bytes(digest(joined, SEED), "big", signed=True)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.r_[0, ends[:-words] + 1].tolist()
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(bits)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (a signed 64-bit number) and a hash of the text per row."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            found = [fingerprint(t, words) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), batch.column(2)], names=["doc_id", "fp", "h"])

    raw = F.col(text).cast("string")
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), raw.cast("binary").alias("text"), F.xxhash64(raw).alias("h")).mapInArrow(run, "doc_id bigint, fp bigint, h bigint")


class Tree:
    """A BK-tree of numbers under Hamming distance."""

    def __init__(self):
        self.root: list | None = None

    def add(self, value: int, name: int) -> None:
        if self.root is None:
            self.root = [value, name, {}]
            return
        node = self.root
        while True:
            away = (value ^ node[0]).bit_count()
            child = node[2].get(away)
            if child is None:
                node[2][away] = [value, name, {}]
                return
            node = child

    def near(self, value: int, radius: int) -> Iterator[int]:
        """The names of all members at most ``radius`` bits away."""
        open_ = [self.root] if self.root else []
        while open_:
            node = open_.pop()
            away = (value ^ node[0]).bit_count()
            if away <= radius:
                yield node[1]
            for key, child in node[2].items():
                if away - radius <= key <= away + radius:
                    open_.append(child)


class Forest:
    """Disjoint sets of names; ``joined`` are the pairs that joined two of them."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.joined: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        if a != b:
            self.parent[b] = a
            self.joined.append((a, b))

    def stars(self) -> list[tuple[int, int]]:
        return [(self.root(b), b) for _, b in self.joined]


def shard_edges(rows: Iterable[tuple[int, int, bool, bool]], radius: int) -> list[tuple[int, int]]:
    """Spanning edges of a shard's links. Rows: number, name, whether it is in the tree, whether it searches."""
    rows = list(rows)
    tree, forest = Tree(), Forest()
    for value, name, member, searches in rows:
        if member and searches:
            for found in tree.near(value, radius):
                forest.join(found, name)
        if member:
            tree.add(value, name)
    for value, name, member, searches in rows:
        if searches and not member:
            for found in tree.near(value, radius):
                forest.join(found, name)
    return forest.stars()


def _masks(radius: int) -> list[int]:
    """The bits of every (band, sub-band)."""
    parts = radius + 1
    cut = lambda bits: [bits[k * len(bits) // parts:(k + 1) * len(bits) // parts] for k in range(parts)]
    out = []
    for band in cut(list(range(64))):
        for sub in cut([b for b in range(64) if b not in band]):
            mask = sum(1 << b for b in band + sub)
            out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b), a < b, that connect what links at most ``radius`` bits long connect. Nodes: fp, node."""
    spark = nodes.sparkSession
    ship(spark)
    shards = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(_masks(radius))])
    rows = nodes.select("fp", "node", F.explode(shards).alias("shard")).select("fp", "node", "shard.k", "shard.bits")
    large = rows.groupBy("k", "bits").count().where(F.col("count") > BLOCK)
    rows = rows.join(large, ["k", "bits"], "left")
    blocks = F.ceil(F.coalesce("count", F.lit(1)) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks.cast("bigint")).cast("int")
    rows = rows.select("k", "bits", "fp", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("k", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "node")
    # A key of two blocks has the rows of both; that of one block has its own.
    keys = ["k", "bits", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(data: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, (data[1:, :4] != data[:-1, :4]).any(1)])
            size = np.diff(np.r_[first, len(data)])
            found = []
            for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                i, j = int(data[a, 2]), int(data[a, 3])
                found += shard_edges(((fp & (1 << 64) - 1, node, own == i, own == j) for own, fp, node in data[a:a + n, 4:].tolist()), radius)
            return pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

        for batch in batches:
            data = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)
            if not len(data):
                continue
            data = np.concatenate([*held, data])
            last = int(np.flatnonzero(np.r_[True, (data[1:, :4] != data[:-1, :4]).any(1)])[-1])
            if last:
                yield edges(data[:last])
            held = [data[last:]]
        if held:
            yield edges(held[0])

    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(run, "a bigint, b bigint").distinct()


def _kept(df: DataFrame, folder: str) -> DataFrame:
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def labels(edges: DataFrame, folder: str) -> DataFrame:
    """node and label, the smallest node connected with it, for every node of an edge."""
    both = _kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{folder}/both")
    held = _kept(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), f"{folder}/labels-0")
    step = 0
    while True:
        step += 1
        near = both.join(held.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label").unionByName(held)
        least = _kept(near.groupBy("node").agg(F.min("label").alias("label")), f"{folder}/least-{step}")
        jump = held.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = _kept(least.join(jump, "label", "left").select("node", F.coalesce(F.least("label", "further"), "label").alias("label")), f"{folder}/labels-{step}")
        same = held.withColumnRenamed("label", "before").join(moved, "node").where("label <> before").isEmpty()
        held = moved
        if same:
            return held


def components(df: DataFrame, words: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return _grouped(df, words, radius, doc_id, text).select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def _grouped(df: DataFrame, words: int, radius: int, doc_id: str, text: str) -> DataFrame:
    folder = work_dir(df.sparkSession, "simhash")
    prints = _kept(fingerprints(df, words, doc_id, text), f"{folder}/prints")
    name = F.coalesce(F.min("doc_id"), F.lit(NAMELESS) + F.shiftrightunsigned(F.first("fp"), 2))
    nodes = _kept(prints.groupBy("fp").agg(name.alias("node")), f"{folder}/nodes")
    found = labels(_kept(links(nodes, radius), f"{folder}/edges"), folder)
    final = nodes.join(found, "node", "left").select("fp", F.coalesce("label", "node").alias("label"))
    final = _kept(final.select("fp", F.when(F.col("label") < NAMELESS, F.col("label")).alias("component_id")), f"{folder}/components")
    return prints.join(final, "fp")


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _free(df: DataFrame, name: str) -> str:
    """The name, made longer until no column of the frame has it."""
    while name in map(str.lower, df.columns):
        name += "_"
    return name


def deduplicated(df: DataFrame, words: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the smallest id of each component, with all their columns.

    A row is told by its id and its text: of rows alike in both one stays, and where the smallest id has several
    texts, one of each fingerprint stays (copies of another id go), so that no text is lost with a copy of another.
    Rows without an id cannot be told apart and stay, as do ids of 2**62 and more, which have no component.
    """
    found = _grouped(df, words, radius, doc_id, text).where("doc_id IS NOT NULL")
    stay = found.where("doc_id = component_id").groupBy("doc_id", "fp").agg(F.min("h").alias("h")).select("doc_id", "h")
    of, hashed = _free(df, "_of"), _free(df, "_text_hash")
    alike = [F.col(doc_id).cast("bigint") == F.col(of), F.xxhash64(F.col(text).cast("string")) == F.col(hashed)]
    named = lambda x: x.select(F.col("doc_id").alias(of), F.col("h").alias(hashed))
    gone = found.where("component_id IS NOT NULL").select("doc_id", "h").distinct().join(stay, ["doc_id", "h"], "left_anti")
    left = df.join(named(gone), alike, "left_anti")
    again = named(found.groupBy("doc_id", "h").count().where("count > 1"))
    if again.isEmpty():
        return left
    once = left.join(again, alike, "left_semi").withColumn(hashed, F.xxhash64(F.col(text).cast("string"))).dropDuplicates([doc_id, hashed]).drop(hashed)
    return left.join(again, alike, "left_anti").unionByName(once)
