"""Ranked lexical search by MaxScore with pair bounds.

A first pass counts the terms of every document and keeps the counts of terms that an item holds; sums over it
give the corpus figures and document frequencies. A second pass writes the index, one row per block of documents:
postings with impacts, the largest impact per term, and for each pair of terms that are neighbours in some item's
order of weights the intersection of their postings with the largest joint score.

A query's terms stand by rising weight. Its bound over the first k terms is the least over all ways to take them
singly or as neighbouring pairs, a pair counting its joint maximum (or one term's maximum, if that is larger).
Terms whose bound stays below the threshold open no candidates; the others' postings are scored, then the
remaining terms are added from the heaviest down, and before each one candidates that cannot reach the threshold
go: those in the next pair's intersection are held to its joint maximum, those outside to its larger single one.

The threshold of an item is the score of its k-th best among seeds, the documents that give a pair or a term its
maximum in some block; a worker raises it as it fills its own best k. Ties with the threshold stay, so that ids
decide. Items are taken in shards of ``SHIPPED`` bytes, each with its own passes.

Null texts have no terms and are no document of the corpus; rows that repeat are documents each; null doc_ids rank
first among equal scores. Every row of the items is a query of its own, also where its id repeats or is null; items
without a known term have no rows, as has a corpus without terms. Other columns play no part. Texts of any length
are counted whole. Work tables go below the session's work folder and are left to its owner.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemspark.llm.common import pieces, ship
from itemspark.session import stored

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Documents of a block (below 2**15); bytes of items that a pass carries.
BLOCK, SHIPPED = 2_048, 16 << 20
COUNTED = "doc_id bigint, n bigint, terms array<int>, times array<bigint>"
INDEX = ("doc_id array<bigint>, term array<int>, starts array<int>, docs array<smallint>, impacts array<int>, most array<bigint>,"
         " pair array<int>, pair_starts array<int>, pair_docs array<smallint>, joint array<bigint>")
FOUND = "query int, doc_id bigint, score bigint"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text; bytes are lowered, so only A-Z change."""
    return TERM.findall(text.encode().lower()) if text else []


class Items:
    """The queries of a shard: their terms by number, and the pairs that are neighbours by weight."""

    def __init__(self, texts: list[str | None]):
        held = [sorted(set(terms(t))) for t in texts]
        self.names = sorted(set().union(*held)) if held else []
        self.number = {name: k for k, name in enumerate(self.names)}
        self.of = [np.array([self.number[x] for x in own], np.int64) for own in held]
        self.weights = np.zeros(len(self.names), np.int64)
        self.pairs = np.zeros((0, 2), np.int64)
        self.pairs_of: list[np.ndarray] = []

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        """Weights from the document frequencies; terms no document holds leave their items."""
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(self.names))], np.int64)
        self.of = [own[np.argsort(self.weights[own], kind="stable")] for own in ([x for x in own.tolist() if df.get(x)] for own in self.of) for own in [np.array(own, np.int64)]]
        keys = [own[:-1] * len(self.names) + own[1:] for own in self.of]
        known = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]))
        self.pairs = np.stack(np.divmod(known, max(1, len(self.names))), 1)
        self.pairs_of = [np.searchsorted(known, k) for k in keys]


def _counted(items: Items, limit: int):
    number, known = items.number, frozenset(items.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, limit):
            ids, sizes, own, times, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if words := terms(text):
                    counts = Counter(filter(known.__contains__, words))
                    ids.append(doc_id)
                    sizes.append(len(words))
                    own += map(number.__getitem__, counts)
                    times += counts.values()
                    ends.append(len(own))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((own, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return run


def _indexed(items: Items, documents: int, words: int):
    weights, pairs = items.weights, items.pairs

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.column(1).to_numpy()
        own, times = batch.column(2), batch.column(3)
        sizes = np.diff(own.offsets.to_numpy())
        term, tf = own.flatten().to_numpy(), times.flatten().to_numpy()
        doc = np.repeat(np.arange(len(n)), sizes)
        slow = 10 + np.array([90 * int(x) * documents // words for x in n], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * slow[doc])
        by = np.lexsort((doc, term))
        # A block is small and an impact below 10**6, so both fit narrow numbers; scores are 64-bit.
        term, doc, impact = term[by], doc[by].astype(np.int16), impact[by].astype(np.int32)
        here, first = np.unique(term, return_index=True)
        starts = np.append(first, len(term))
        most = np.maximum.reduceat(impact, first).astype(np.int64) if len(term) else impact
        at = {t: k for k, t in enumerate(here.tolist())}
        kept, joint, shared = [], [], []
        for k, (x, y) in enumerate(pairs.tolist()):
            if x in at and y in at:
                p, q = (slice(starts[at[t]], starts[at[t] + 1]) for t in (x, y))
                both, i, j = np.intersect1d(doc[p], doc[q], assume_unique=True, return_indices=True)
                if len(both):
                    scores = weights[x] * impact[p][i].astype(np.int64) + weights[y] * impact[q][j].astype(np.int64)
                    kept.append(k)
                    joint.append(scores.max())
                    # The document that reaches the maximum stands first, as the pair's seed.
                    best = int(scores.argmax())
                    shared.append(np.r_[both[best], np.delete(both, best)])
        ends = np.cumsum([0, *map(len, shared)])
        row = [batch.column(0).to_pylist(), here, starts, doc, impact, most, kept, ends, np.concatenate([np.zeros(0, np.int16), *shared]), joint]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(kind)) for x, kind in zip(row, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                yield block(batch.slice(start, BLOCK))

    return run


class Block:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict, items: Items):
        get = lambda c: np.asarray(row[c].values)
        self.ids = row["doc_id"].values.to_pylist()
        self.docs, self.impacts, starts, self.size = get("docs"), get("impacts"), get("starts"), len(self.ids)
        self.weights, number = items.weights, len(items.names)
        self.start, self.end, self.most = np.zeros(number, np.int64), np.zeros(number, np.int64), np.zeros(number, np.int64)
        here = get("term")
        self.start[here], self.end[here], self.most[here] = starts[:-1], starts[1:], get("most")
        self.limit = self.most * self.weights
        kept, ends = get("pair"), get("pair_starts")
        self.joint, self.pair = np.zeros(len(items.pairs), np.int64), {}
        self.joint[kept] = get("joint")
        shared = get("pair_docs")
        self.pair = {k: shared[a:b] for k, a, b in zip(kept.tolist(), ends, ends[1:], strict=False)}

    def posting(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.start[term], self.end[term])
        return self.docs[part], self.impacts[part].astype(np.int64) * self.weights[term]

    def exact(self, own: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whole scores of some documents."""
        out = np.zeros(len(docs), np.int64)
        for term in own.tolist():
            held, scores = self.posting(term)
            if len(held):
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                out += np.where(held[at] == docs, scores[at], 0)
        return out

    def seeds(self, own: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
        docs = {int(self.pair[p][0]) for p in pairs.tolist() if p in self.pair}
        for term in own[-3:].tolist():
            held, scores = self.posting(term)
            if len(held):
                docs.add(int(held[scores.argmax()]))
        found = np.array(sorted(docs), np.int64)
        return list(zip(self.exact(own, found).tolist(), found.tolist(), strict=True))

    def search(self, own: np.ndarray, pairs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents whose score is at least ``least`` (and above 0), with their scores."""
        limit = self.limit[own].tolist()
        # Both in one document: the joint maximum; one of them: its own; so a pair never counts less than either.
        both = [max(int(self.joint[p]), limit[k], limit[k + 1]) for k, p in enumerate(pairs.tolist())]
        bound = [0]
        for k, x in enumerate(limit):
            bound.append(bound[-1] + x if not k else min(bound[-1] + x, bound[-2] + both[k - 1]))
        free = len(own)
        while free and bound[free] >= least:
            free -= 1
        score = np.zeros(self.size, np.int64)
        for term in own[free:].tolist():
            held, scores = self.posting(term)
            score[held] += scores
        docs = np.flatnonzero(score)
        for k in range(free - 1, -1, -1):
            rest = np.full(len(docs), bound[k + 1], np.int64)
            if k:
                single = bound[k - 1] + max(limit[k], limit[k - 1])
                rest = np.minimum(rest, np.where(np.isin(docs, self.pair.get(int(pairs[k - 1]), ())), bound[k - 1] + both[k - 1], single))
            docs = docs[score[docs] + rest >= least]
            if not len(docs):
                break
            held, scores = self.posting(int(own[k]))
            if len(held):
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                score[docs] += np.where(held[at] == docs, scores[at], 0)
        docs = docs[score[docs] >= max(1, least)]
        return docs, score[docs]


def _order(found: tuple[int, int | None]) -> tuple[int, bool, int]:
    """Higher scores first, then null ids, then smaller ones."""
    return found[0], found[1] is None, -(found[1] or 0)


def _asked(items: Items, k: int, least: list[int] | None):
    """Seeds of every block where no thresholds are given, else the searches; a worker passes on its best ``k`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int | None]]] = [[] for _ in items.of]
        for batch in batches:
            for at in range(batch.num_rows):
                block = Block({name: batch.column(c)[at] for c, name in enumerate(batch.schema.names)}, items)
                for q, (own, pairs) in enumerate(zip(items.of, items.pairs_of, strict=True)):
                    if not len(own):
                        continue
                    if least is None:
                        new = [(s, block.ids[d]) for s, d in block.seeds(own, pairs)]
                    else:
                        floor = max(least[q], best[q][-1][0] if len(best[q]) >= k else 0)
                        docs, scores = block.search(own, pairs, floor)
                        if len(docs) > k:
                            # Whole ties with the k-th score stay until ids have been compared.
                            stay = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                            docs, scores = docs[stay], scores[stay]
                        new = [(s, block.ids[d]) for s, d in zip(scores.tolist(), docs.tolist(), strict=True)]
                    if new:
                        best[q] = nlargest(k, best[q] + new, key=_order)
        rows = [(q, d, s) for q, own in enumerate(best) for s, d in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return run


def _shard(docs: DataFrame, rows: list, k: int, limit: int) -> DataFrame | None:
    """item_id, rank, doc_id, score of the items of one shard."""
    spark, items = docs.sparkSession, Items([r[1] for r in rows])
    counted = stored(docs.mapInArrow(_counted(items, limit), COUNTED), "lexical-counts")
    documents, words = counted.agg(F.count("*"), F.sum("n")).first()
    if not documents or not items.names:
        return None
    # One row per term of the shard's items.
    items.weigh(documents, dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect()))
    index = stored(counted.mapInArrow(_indexed(items, documents, words), INDEX), "lexical-index")
    first = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))

    def ranked(least: list[int] | None) -> DataFrame:
        return index.mapInArrow(_asked(items, k, least), FOUND).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)

    least = [0] * len(rows)
    for q, score in ranked(None).where(F.col("rank") == k).select("query", "score").collect():
        least[q] = score
    names = spark.createDataFrame([(q, r[0]) for q, r in enumerate(rows)], "query int, item_id bigint")
    return ranked(least).join(names, "query").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", shipped: int = SHIPPED, limit: int = 4 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents with a score above 0."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    many, out = max(1, math.ceil(size / shipped)), None
    for shard in range(many):
        part = asked.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(many)) == shard).orderBy("item_id", "text").collect()
        found = _shard(rows, part, k, limit) if part else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out
