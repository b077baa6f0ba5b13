"""SentencePiece encoding and decoding by suffix-array matching.

The new pre-tokens of a batch are concatenated and indexed by a suffix array (prefix doubling, as deep as the
longest piece). A binary search of every piece gives its range of occurrences; each occurrence is an edge from
its first to its last byte. The edges are sorted by position, into a table of one row per position, and then
relaxed: each pre-token starts as single characters, and in every round takes the best-scored edge that spans
exactly two of its present symbols (the leftmost of equal ones, and all that do not overlap), until no edge
applies. For a BPE vocabulary this is the library's own order of merges, so the ids are the library's; a
shortest path over scores would not be. Characters no piece covers become byte pieces.

Null texts count as empty, and empty texts have no ids; repeated rows are encoded each; an empty table gives
an empty result. Texts are encoded whole, whatever their length. A blank and U+2581 are one character to the
vocabulary, so decoding returns a blank for either.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemspark.llm.common import pieces, ship
from itemspark.llm.vocabulary import BIG, BLANK, Vocabulary, load, segments

#: Pre-tokens whose ids a worker keeps, and bytes of new ones that are indexed at a time.
KEPT, INDEXED = 250_000, 1 << 18
#: Bytes of text that are encoded together.
BATCH = 2 << 20
#: Bytes that never occur in UTF-8: the blank, and the end of a pre-token.
BLANK_BYTE, END_BYTE = 0xFF, 0xFE


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").replace(BLANK.encode(), bytes([BLANK_BYTE]))


class Index:
    """The pieces as big-endian words, for the binary searches."""

    def __init__(self, vocabulary: Vocabulary):
        raw = [_bytes(name) for name in vocabulary.order]
        self.length = np.array([len(x) for x in raw], np.int64)
        self.words = -(-int(self.length.max()) // 8)
        low = np.frombuffer(b"".join(x.ljust(8 * self.words, b"\0") for x in raw), ">u8").reshape(len(raw), -1)
        high = np.frombuffer(b"".join(x.ljust(8 * self.words, b"\xff") for x in raw), ">u8").reshape(len(raw), -1)
        self.low, self.high = low.astype(np.uint64), high.astype(np.uint64)
        self.short, self.long = np.flatnonzero(self.length <= 8), np.flatnonzero(self.length > 8)
        self.short = self.short[np.argsort(self.low[self.short, 0])]  # in order, so that searches stay close


@cache
def _index(path: str) -> Index:
    return Index(load(path))


def suffix_array(text: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted to a depth of ``8 * words`` bytes, and each position's first eight bytes as a number."""
    n = len(text)
    padded = np.r_[text, np.zeros(8 * words, np.uint8)]
    key = np.zeros(n + 8 * words, np.uint64)
    for k in range(8):
        key[:len(padded) - k] |= padded[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.argsort(key[:n])
    depth, held = 8, key[:n]
    while depth < 8 * words:
        in_order = held[order]
        rank = np.zeros(n + depth, np.int64)
        rank[order] = np.r_[1, 1 + np.cumsum(in_order[1:] != in_order[:-1])]
        held = rank[:n] << 32 | rank[depth:]
        order = np.argsort(held)
        depth *= 2
    return order, key


def occurrences(index: Index, order: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every piece, where its range in the suffix array begins and ends.

    Pieces of up to eight bytes are searched for among the suffixes' first words, longer ones word by word.
    """
    lo, hi = np.zeros(len(index.length), np.int64), np.zeros(len(index.length), np.int64)
    first = key[order]
    lo[index.short] = np.searchsorted(first, index.low[index.short, 0], side="left")
    hi[index.short] = np.searchsorted(first, index.high[index.short, 0], side="right")

    def bound(wanted: np.ndarray, or_equal: bool) -> np.ndarray:
        lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
        for _ in range(int(len(order)).bit_length()):
            open_ = np.flatnonzero(lo < hi)
            mid = (lo[open_] + hi[open_]) >> 1
            at = order[mid]
            less = np.zeros(len(open_), bool)
            same = np.ones(len(open_), bool)
            for w in range(index.words):
                have, want = key[at + 8 * w], wanted[open_, w]
                less |= same & (have < want)
                same &= have == want
            less |= same & or_equal
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return lo

    lo[index.long], hi[index.long] = bound(index.low[index.long], False), bound(index.high[index.long], True)
    return lo, hi


def encode_words(words: list[str], path: str) -> list[bytes]:
    """Each pre-token's ids, as little-endian 32-bit numbers. A pre-token holds no line end here."""
    vocabulary, index = load(path), _index(path)
    text = np.frombuffer(_bytes("\n".join(words) + "\n").replace(b"\n", bytes([END_BYTE])), np.uint8)
    order, key = suffix_array(text, index.words)
    lo, hi = occurrences(index, order, key)
    many = hi - lo
    piece = np.repeat(np.arange(len(many), dtype=np.int32), many)
    at = np.arange(len(piece), dtype=np.int32)
    at += np.repeat((lo - np.cumsum(many) + many).astype(np.int32), many)
    # The edges by position: row of the position, column of the length.
    span = int(index.length.max()) + 1
    edges = np.full(len(text) * span, BIG, np.int32)
    cell = order.astype(np.int32)[at] * np.int32(span)
    cell += index.length.astype(np.int32)[piece]
    edges[cell] = piece
    del at, cell, piece, order, key

    starts = (text < 0x80) | (text >= 0xC0)
    starts &= text != END_BYTE
    begin = np.flatnonzero(starts)
    seq = np.cumsum(text == END_BYTE)[begin]
    ends = np.flatnonzero(starts | (text == END_BYTE))
    size = np.diff(np.r_[ends, len(text)])[np.searchsorted(ends, begin)]

    def best_at(k: np.ndarray) -> np.ndarray:
        """The edge over the symbols at these places and the ones after them."""
        out = np.full(len(k), BIG, np.int32)
        ok = k[k < len(begin) - 1]
        wide = size[ok] + size[ok + 1]
        fits = (seq[ok] == seq[ok + 1]) & (wide < span)
        out[:len(ok)][fits] = edges[begin[ok[fits]] * span + wide[fits]]
        return out

    final: list[tuple[np.ndarray, np.ndarray]] = []
    rank = best_at(np.arange(len(begin)))
    while len(begin):
        first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        count = np.diff(np.r_[first, len(seq)])
        least = np.minimum.reduceat(rank, first)
        over = np.repeat(least == BIG, count)
        if over.any():
            final.append((begin[over], size[over]))
            begin, seq, size, rank = begin[~over], seq[~over], size[~over], rank[~over]
            count, least = count[least < BIG], least[least < BIG]
            if not len(begin):
                break
        k = np.flatnonzero(rank == np.repeat(least, count))
        run = np.flatnonzero(np.r_[True, np.diff(k) != 1])
        k = k[(np.arange(len(k)) - np.repeat(run, np.diff(np.r_[run, len(k)]))) % 2 == 0]
        size[k] += size[k + 1]
        stay = np.ones(len(begin), bool)
        stay[k + 1] = False
        place = np.cumsum(stay)[k] - 1
        begin, seq, size, rank = begin[stay], seq[stay], size[stay], rank[stay]
        rank[place] = best_at(place)
        before = place[place > 0] - 1
        rank[before] = best_at(before)

    begin, size = (np.concatenate([x[i] for x in final]) for i in (0, 1)) if final else (np.zeros(0, np.int64),) * 2
    by_place = np.argsort(begin)
    begin, size = begin[by_place], size[by_place]
    ids = edges[begin * span + np.minimum(size, span - 1)]
    known = ids < BIG
    width = np.where(known, 1, size)
    out = np.repeat(np.where(known, vocabulary.by_order[np.where(known, ids, 0)], -1), width)
    raw_at = np.repeat(begin, width) + np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width)
    out = np.where(out >= 0, out, vocabulary.byte_ids[text[raw_at]]).astype("<i4")
    last = np.cumsum(np.bincount(np.cumsum(text == END_BYTE)[begin], weights=width, minlength=len(words))).astype(np.int64)
    data = out.tobytes()
    return [data[4 * a:4 * b] for a, b in zip(np.r_[0, last[:-1]].tolist(), last.tolist(), strict=True)]


@cache
def encoder(path: str):
    line_end = load(path).byte_ids[ord("\n")].astype("<i4").tobytes()
    known: dict[str, bytes] = {"\n": line_end}

    def encode(texts: list[str]) -> list[bytes]:
        split = [segments(t) for t in texts]
        fresh = set().union(*split) - known.keys()
        if len(known) + len(fresh) > KEPT:
            known.clear()
            known["\n"] = line_end
            fresh = set().union(*split) - known.keys()
        part, held = [], 0
        for k, word in enumerate(fresh):
            part.append(word)
            held += len(word)
            if held >= INDEXED or k == len(fresh) - 1:
                known.update(zip(part, encode_words(part, path), strict=True))
                part, held = [], 0
        return [b"".join(map(known.__getitem__, s)) for s in split]

    return encode


@cache
def decoder(path: str):
    """Gives the text of some ids: piece texts and byte pieces in turn, less the blank put before the text."""
    vocabulary = load(path)
    raw = [name.replace(BLANK, " ").encode() for name in vocabulary.names]
    for byte, i in enumerate(vocabulary.byte_ids.tolist()):
        raw[i] = bytes([byte])
    for i in set(range(len(raw))) - set(vocabulary.by_order.tolist()) - set(vocabulary.byte_ids.tolist()):
        raw[i] = b""

    def decode(ids: list[int]) -> str:
        return b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace")[1:]

    return decode


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def encoded(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``token_ids`` and ``n_tokens`` (replacing columns of these names); every other column stays."""
    ship(df.sparkSession)
    kept = df.select([c for c in df.columns if c not in ("token_ids", "n_tokens")])
    at = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in pieces(batches, at, BATCH):
            lists = _lists(encode([x or "" for x in batch.column(at).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pc.list_value_length(lists).cast(pa.int64())], names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)


def decoded(df: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Adds the text of the ids as ``to``; null ids give the empty text."""
    ship(df.sparkSession)
    kept = df.select([c for c in df.columns if c != to])
    at = kept.columns.index(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = [decode(x or []) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)


def coded(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its ids, their number, and whether decoding them gives the text again.

    Both ways in one pass, so that neither texts nor ids travel twice.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = encoder(path), decoder(path)
        for batch in pieces(batches, 1, BATCH):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = encode(texts)
            same = [decode(np.frombuffer(i, "<i4").tolist()) == t.replace(BLANK, " ") for i, t in zip(ids, texts, strict=True)]
            lists = _lists(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(lists).cast(pa.int64()), lists, pa.array(same)],
                                             names=["doc_id", "n_tokens", "token_ids", "round_trip"])

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, token_ids array<int>, round_trip boolean")
