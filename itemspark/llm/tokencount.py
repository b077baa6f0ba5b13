"""Token counts by rank-synchronous merging of ragged numpy arrays.

The pre-tokens of a batch lie end to end in one array of symbols. In every round each sequence finds its
lowest-ranked neighbouring pair and merges it wherever it stands, all sequences at once; a sequence without a
pair leaves the arrays, and what is left of it is counted. A character outside the vocabulary counts as its
UTF-8 bytes. Counts of pre-tokens are kept per worker, within a bound.

Null texts count as empty, empty texts have no tokens, repeated rows are counted each, other columns of the
input are not looked at; an empty table gives an empty result. Texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.llm.common import pieces, ship
from itemspark.llm.vocabulary import BIG, load, segments

#: Pre-tokens whose counts a worker keeps.
KEPT = 300_000
SLOTS = 22
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class Pairs:
    """Merge ranks by pair of symbols, in an open-addressing table looked up for whole arrays."""

    def __init__(self, order: dict[str, int]):
        found = [(order[s[:k]] << 32 | order[s[k:]], rank) for s, rank in order.items()
                 for k in range(1, len(s)) if s[:k] in order and s[k:] in order]
        keys = np.array([x[0] for x in found], np.int64)
        ranks = np.array([x[1] for x in found], np.int32)
        self.keys, self.ranks = np.full(1 << SLOTS, -1, np.int64), np.full(1 << SLOTS, BIG, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = keys[free]  # of two for one slot the last stays, the other moves on
            done = self.keys[slot[todo]] == keys[todo]
            self.ranks[slot[todo[done]]] = ranks[todo[done]]
            todo = todo[~done]
            slot[todo] = (slot[todo] + 1) & ((1 << SLOTS) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.int64(-7046029254386353131)) >> np.int64(64 - SLOTS)) & np.int64((1 << SLOTS) - 1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        rank = self.ranks[slot]
        odd = np.flatnonzero(self.keys[slot] != key)
        rank[odd] = BIG
        odd = odd[self.keys[slot[odd]] >= 0]
        while len(odd):
            slot[odd] = (slot[odd] + 1) & ((1 << SLOTS) - 1)
            hit = self.keys[slot[odd]] == key[odd]
            rank[odd[hit]] = self.ranks[slot[odd[hit]]]
            odd = odd[~hit & (self.keys[slot[odd]] >= 0)]
        return rank


@cache
def _tables(path: str) -> tuple[np.ndarray, Pairs]:
    order = load(path).order
    symbols = np.full(0x110000, -1, np.int32)
    for name, rank in order.items():
        if len(name) == 1:
            symbols[ord(name)] = rank
    return symbols, Pairs(order)


def merged_counts(words: list[str], path: str) -> np.ndarray:
    """The number of tokens of each pre-token."""
    table, pairs = _tables(path)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    seq = np.repeat(np.arange(len(words)), sizes)
    sym = table[points]
    weight = np.where(sym >= 0, 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).astype(np.int64)
    counts = np.zeros(len(words), np.int64)

    def ranks_at(at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at these places."""
        out = np.full(len(at), BIG, np.int32)
        ok = np.flatnonzero(at < len(sym) - 1)
        ok = ok[(seq[at[ok]] == seq[at[ok] + 1]) & (sym[at[ok]] >= 0) & (sym[at[ok] + 1] >= 0)]
        out[ok] = pairs(sym[at[ok]], sym[at[ok] + 1])
        return out

    rank = ranks_at(np.arange(len(sym)))
    while len(sym):
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        size = np.diff(np.r_[first, len(sym)])
        least = np.minimum.reduceat(rank, first)
        over = least == BIG
        if over.any():
            counts[seq[first[over]]] = np.add.reduceat(weight, first)[over]
            stay = np.repeat(~over, size)
            sym, seq, rank, weight = sym[stay], seq[stay], rank[stay], weight[stay]
            least, size = least[~over], size[~over]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(least, size))
        # Of occurrences that overlap, the first goes, then the next that is free.
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        turn = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        at = at[turn % 2 == 0]
        sym[at] = rank[at]
        stay = np.ones(len(sym), bool)
        stay[at + 1] = False
        place = np.cumsum(stay)[at] - 1
        sym, seq, rank, weight = sym[stay], seq[stay], rank[stay], weight[stay]
        rank[place] = ranks_at(place)
        before = place[place > 0] - 1
        rank[before] = ranks_at(before)
    return counts


@cache
def counter(path: str):
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        split = [segments(t) for t in texts]
        fresh = list(set().union(*split) - known.keys())
        if len(known) + len(fresh) > KEPT:
            known.clear()
            fresh = list(set().union(*split))
        if fresh:
            known.update(zip(fresh, merged_counts(fresh, path).tolist(), strict=True))
        return [sum(map(known.__getitem__, s)) for s in split]

    return count


def token_counts(df: DataFrame, path: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: UTF-8 bytes, tokens without special ones, and whether they exceed ``limit``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in pieces(batches, 1):
            n = np.array(count(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole.alias("text"),
                     F.octet_length(whole).cast("bigint").alias("n_bytes")).mapInArrow(run, SCHEMA)
