"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case, with every run of white space as one blank. A test item of n characters may
be matched with ``floor(rate * n)`` edits and is split into one piece more, so that a match holds some piece
unchanged. An automaton over all pieces finds the exact hits in one pass over a document. A hit is verified
upwards: pieces are the leaves of a binary tree, a node of m pieces may have m - 1 edits (if both halves of a
node had as many edits as pieces, the node would exceed its own), and Myers' bit-parallel distance of a node's
text around the hit decides whether its parent is tried; the root is the item.

The benchmark goes to every task; above ``SHIPPED`` bytes it is dealt into shards of that size, each with a
pass over the documents. Items of fewer than ``least`` characters are not matched: they occur by chance.

Null and empty texts hold nothing; null items are not matched; repeated documents are matched each, repeated
items of one id count once. A document's distance to an item is the least over all its passages. Documents
without an id are in no pair of ``matches``, but are judged by ``decontaminated``. Either table may be empty;
other columns play no part. Texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.llm.common import pieces, ship

RATE, LEAST = 0.1, 30
SHIPPED = 32 << 20


def folded(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


class Node:
    """Pieces [first, last) of an item: its characters [start, end), and the errors it may have."""

    __slots__ = ("start", "end", "errors", "parent", "peq", "text")

    def __init__(self, item: str, start: int, end: int, errors: int, parent: Node | None):
        self.start, self.end, self.errors, self.parent = start, end, errors, parent
        self.text, self.peq = item, None

    def distance(self, text: str, lo: int, hi: int) -> int:
        """Myers: the least edits between this node's text and any stretch of ``text[lo:hi]``."""
        if self.peq is None:
            self.peq = {}
            for k, c in enumerate(self.text[self.start:self.end]):
                self.peq[c] = self.peq.get(c, 0) | 1 << k
        get, n = self.peq.get, self.end - self.start
        full, top = (1 << n) - 1, 1 << n - 1
        vp, vn, score, best = full, 0, n, n
        for c in text[lo:hi]:
            eq = get(c, 0)
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp = vn | (full & ~(d0 | vp))
            hn = d0 & vp
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
                if score < best:
                    best = score
            hp = hp << 1 & full
            hn = hn << 1 & full
            vp = hn | (full & ~(d0 | hp))
            vn = hp & d0
        return best


class Matcher:
    """Finds items in texts. Items: (id, text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, least: int = LEAST):
        self.leaves: list[tuple[int, Node]] = []
        found: dict[str, list[int]] = {}
        for item_id, raw in items:
            text = folded(raw)
            if len(text) < least:
                continue
            budget = floor(rate * len(text))
            cuts = [k * len(text) // (budget + 1) for k in range(budget + 2)]
            self._grow(item_id, text, cuts, 0, budget + 1, None, found)
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, tuple(places))
        if found:
            self.automaton.make_automaton()

    def _grow(self, item_id, text, cuts, a, b, parent, found) -> None:
        node = Node(text, cuts[a], cuts[b], b - a - 1, parent)
        if b - a == 1:
            found.setdefault(text[node.start:node.end], []).append(len(self.leaves))
            self.leaves.append((item_id, node))
            return
        mid = (a + b + 1) // 2
        self._grow(item_id, text, cuts, a, mid, node, found)
        self._grow(item_id, text, cuts, mid, b, node, found)

    def matches(self, raw: str | None, first: bool = False) -> dict[int, int]:
        """Edits by item id, of the items the text holds; of any one item if only the ``first`` is asked for."""
        out: dict[int, int] = {}
        text = folded(raw)
        if not text or not len(self.automaton):
            return out
        failed: set[tuple[int, int]] = set()
        for end, places in self.automaton.iter(text):
            for place in places:
                item_id, leaf = self.leaves[place]
                if out.get(item_id) == 0:
                    continue
                at = end + 1 - leaf.end  # where the item's first character would stand
                node, edits = leaf, 0
                while (node := node.parent) is not None:
                    if (id(node), at) in failed:
                        break
                    edits = node.distance(text, max(0, at + node.start - node.errors), at + node.end + node.errors)
                    if edits > node.errors:
                        failed.add((id(node), at))
                        break
                else:
                    out[item_id] = min(edits, out.get(item_id, edits))
                    if first:
                        return out
        return out


def _shards(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items, at most about ``SHIPPED`` bytes at a time."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, ceil(size / SHIPPED))
    for k in range(many):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(many)) == k)
        yield [tuple(r) for r in part.orderBy("item_id", "text").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, edits: one row for every item that a document holds."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def finder(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate, least)
            for batch in pieces(batches, 1):
                found = [(d, i, e) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, e in matcher.matches(t).items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(3)], names=["doc_id", "item_id", "edits"])
        return run

    parts = [rows.mapInArrow(finder(items), "doc_id bigint, item_id bigint, edits bigint") for items in _shards(benchmark, item_id, item_text)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def keeper(items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate, least)
            for batch in pieces(batches, at):
                yield batch.filter(pa.array([not matcher.matches(t, True) for t in batch.column(at).to_pylist()]))
        return run

    for items in _shards(benchmark, item_id, item_text):
        docs = docs.mapInArrow(keeper(items), docs.schema)
    return docs
