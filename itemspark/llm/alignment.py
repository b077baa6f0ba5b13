"""Alignment of two tokenizers' tokens by merge-path partitioning.

The texts of a batch lie end to end as bytes, so that each tokenizer gives one rising array of token ends. The
two arrays are merged: diagonals of the merge grid, ``WIDTH`` steps apart, are cut by binary search, all at once,
into pieces of equal work that need nothing of each other, and all pieces are walked in step. A step that ends a
token gives one overlap (link) of an A token and a B token; a B end equal to the A end before it closes a group
instead. Pieces count their closed groups, and the running sum of the counts stitches groups that cross pieces.

How many documents of the corpus hold a pair of ids linked takes two passes: a batch writes its documents and its
distinct pairs, pairs are counted over all batches (one row per batch and pair is shuffled, never one per link),
and the counts go back to the batches. A batch holds about ``BATCH`` bytes of text, or one longer text.

Null and empty texts, and texts whose tokens' bytes differ from blank + text under either tokenizer (a literal
U+2581 for example), have no tokens: zeros and an empty digest. Repeated rows are documents each, null ids stay,
other columns play no part, an empty table gives an empty result. Texts of any length are aligned whole; texts
above ``PART`` characters are handed to the tokenizers in parts cut at single blanks between letters or digits,
which neither merges across. The work table goes below the session's work folder and is left to its owner.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.llm.common import pieces, ship
from itemspark.session import stored

#: Steps of a merge piece; bytes of text of a batch; characters given to a tokenizer at once.
WIDTH, BATCH, PART = 32, 4 << 20, 1 << 20
#: Fixed value: the byte-level pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUN = re.compile(r"\s{1000}")
CUT = re.compile(r"(?<=[a-zA-Z0-9]) (?=[a-zA-Z0-9])")
STORED = ("batch bigint, doc_id array<bigint>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<bigint>, sha array<string>,"
          " size array<int>, packed binary, keys array<bigint>, docs array<int>")
SCHEMA = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def parts(text: str, size: int = PART) -> list[str]:
    """The text in parts that start with the blank that both tokenizers see as the start of a word; the first has none."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while found := CUT.search(text, start + size):
        out.append(text[start:found.start()])
        start = found.start()
    return [*out, text[start:]]


@cache
def byte_level(path: str) -> tuple[Callable[[str], np.ndarray], list[bytes]]:
    """Ids of a text by a byte-level BPE file, and every id's bytes."""
    import tiktoken
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {k for k, v in model.get_added_tokens_decoder().items() if v.special}
    table = [b""] * model.get_vocab_size()
    for name, k in model.get_vocab().items():
        table[k] = name.encode() if k in special else bytes(back[c] for c in name)

    # The same merges in a leaner library, which cannot take long runs of white space.
    lean = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks={x: k for k, x in enumerate(table) if k not in special}, special_tokens={})

    def ids(text: str) -> np.ndarray:
        return np.concatenate([np.array(model.encode(p, add_special_tokens=False).ids if RUN.search(p) else lean.encode_ordinary(p), np.int32)
                               for p in parts(" " + text)])

    return ids, table


@cache
def piece_level(path: str) -> tuple[Callable[[str], np.ndarray], list[bytes]]:
    """Ids of a text by a piece model that sets a blank before it, and every id's bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes([int(model.id_to_piece(k)[1:-1], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode()
             for k in range(model.get_piece_size())]

    def ids(text: str) -> np.ndarray:
        return np.concatenate([np.array(model.encode(p[1:] if k else p, num_threads=1), np.int32) for k, p in enumerate(parts(text))])

    return ids, table


def overlaps(a: np.ndarray, b: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per link, in order: its A token, its B token, its group. ``a`` and ``b`` are rising ends with one last value."""
    n, m = len(a), len(b)
    cut = np.arange(0, n + m, width)
    low, high = np.maximum(0, cut - m), np.minimum(cut, n)
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        before = open_ & (a[np.minimum(mid, n - 1)] <= b[np.clip(cut - mid - 1, 0, m - 1)])
        low, high = np.where(before, mid + 1, low), np.where(open_ & ~before, mid, high)
    i, j = low, cut - low
    far = max(a[-1], b[-1]) + 1 if n and m else 1
    a, b = np.append(a, far), np.append(b, far)
    left, right = np.empty((len(cut), width), np.int32), np.empty((len(cut), width), np.int32)
    link, close = np.zeros((len(cut), width), bool), np.zeros((len(cut), width), bool)
    for k in range(width):
        live = cut + k < n + m
        x, y = a[i], b[j]
        first = x <= y
        same = ~first & (i > 0) & (a[i - 1] == y) & live
        left[:, k], right[:, k], close[:, k], link[:, k] = i, j, same, live & ~same
        i, j = np.minimum(i + first, n), np.minimum(j + ~first, m)
    closed = close.sum(1)
    group = (np.cumsum(close, 1) - close) + (np.cumsum(closed) - closed)[:, None]
    return left[link], right[link], group[link]


class Aligner:
    """Tokenizes and aligns the texts of a batch."""

    def __init__(self, a_path: str, b_path: str):
        (self.a, self.a_bytes), (self.b, self.b_bytes) = byte_level(a_path), piece_level(b_path)
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        self.shown = {(side, end): np.array([f"{k}{end}" for k in range(len(table))], object)
                      for side, table, ends in ((0, self.a_bytes, ",|"), (1, self.b_bytes, ",;")) for end in ends}
        self.span = len(self.b_bytes)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both tokenizers, or None if either's bytes are not the text's."""
        if not text:
            return None
        raw, a, b = (" " + text).encode(), self.a(text), self.b(text)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != raw or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
            return None
        return a, b

    def align(self, texts: list[str | None]) -> dict:
        """Tokens, links and groups of the texts that have tokens; ``of``: their places among the texts."""
        found = [(k, t) for k, t in enumerate(map(self.tokens, texts)) if t is not None]
        a, b = (np.concatenate([np.zeros(0, np.int32), *(t[side] for _, t in found)]) for side in (0, 1))
        n_a, n_b = (np.array([len(t[side]) for _, t in found], np.int64) for side in (0, 1))
        i, j, group = overlaps(np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]))
        doc = np.repeat(np.arange(len(found)), n_a)[i]
        a_group, b_group = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        a_group[i], b_group[j] = group, group
        return {"of": np.array([k for k, _ in found], np.int64), "a": a, "b": b, "n_a": n_a, "n_b": n_b, "i": i, "j": j, "doc": doc,
                "a_group": a_group, "b_group": b_group}

    def shown_groups(self, x: dict) -> Iterator[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        a, b, ga, gb = x["a"], x["b"], x["a_group"], x["b_group"]
        if not len(a):
            return
        last_a, last_b = np.append(ga[1:] != ga[:-1], True), np.append(gb[1:] != gb[:-1], True)
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.searchsorted(gb, ga)] = np.where(last_a, self.shown[0, "|"][a], self.shown[0, ","][a])
        out[np.arange(len(b)) + np.searchsorted(ga, gb, "right")] = np.where(last_b, self.shown[1, ";"][b], self.shown[1, ","][b])
        ends = np.cumsum(x["n_a"] + x["n_b"])
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            yield "".join(out[start:end].tolist())[:-1]

    def group_counts(self, x: dict) -> np.ndarray:
        ends = np.cumsum(x["n_a"])
        return x["a_group"][ends - 1] - x["a_group"][ends - x["n_a"]] + 1


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def groups(df: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with tokens: doc_id and its groups in order, each with the A ids and the B ids it holds."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = aligner(a_path, b_path)
        for batch in pieces(batches, 1, BATCH):
            x = find.align(batch.column(1).to_pylist())
            if not len(x["of"]):
                continue
            many = x["a_group"][-1] + 1
            lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(x[f"{s}_group"], np.arange(many + 1)), pa.int32()), pa.array(x[s])) for s in "ab"]
            ends = pa.array(np.r_[0, np.cumsum(find.group_counts(x))], pa.int32())
            shown = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(lists, ["a", "b"]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(x["of"])), shown], names=["doc_id", "groups"])

    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, groups array<struct<a:array<int>,b:array<int>>>")


def _batches(df: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per batch: its documents' figures, their distinct pairs packed, and the batch's pairs with their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, part = aligner(a_path, b_path), TaskContext.get().partitionId()
        for turn, batch in enumerate(pieces(batches, 1, BATCH)):
            x, rows = find.align(batch.column(1).to_pylist()), batch.num_rows
            span = find.span * len(find.a_bytes)
            pairs, times = np.unique(x["doc"] * span + x["a"][x["i"]].astype(np.int64) * find.span + x["b"][x["j"]], return_counts=True)
            doc, pair = np.divmod(pairs, span)
            keys, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
            packed = zstandard.ZstdCompressor(level=1).compress(np.diff(place, prepend=0).astype("<i4").tobytes() + times.astype("<i4").tobytes())
            spread = lambda v, kind: pa.array([_spread(v, x["of"], rows)], pa.list_(kind))
            sha = np.full(rows, "", object)
            sha[x["of"]] = [hashlib.sha256(g.encode()).hexdigest() for g in find.shown_groups(x)]
            yield pa.RecordBatch.from_arrays([
                pa.array([part << 32 | turn], pa.int64()), pa.array([batch.column(0)], pa.list_(pa.int64())), spread(x["n_a"], pa.int32()),
                spread(x["n_b"], pa.int32()), spread(find.group_counts(x), pa.int32()), spread(np.bincount(x["doc"], minlength=len(x["of"])), pa.int64()),
                pa.array([sha.tolist()], pa.list_(pa.string())), spread(np.bincount(doc, minlength=len(x["of"])), pa.int32()),
                pa.array([packed], pa.binary()), pa.array([keys], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int32())),
            ], names=[c.split()[0] for c in STORED.split(", ")])

    return df.mapInArrow(run, STORED)


def _spread(values: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, np.int64)
    out[of] = values
    return out


def aligned(df: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: tokens, groups and links, what the corpus says of the links, and a digest of the groups."""
    ship(df.sparkSession)
    span = len(piece_level(b_path)[1])
    rows = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    batches = stored(_batches(rows, a_path, b_path), "alignment")
    held = batches.select("batch", F.posexplode(F.arrays_zip("keys", "docs")).alias("place", "x")).select("batch", "place", "x.keys", "x.docs")
    counts = held.groupBy("keys").agg(F.sum("docs").alias("n")).withColumn("a", F.floor(F.col("keys") / span))
    # One row per A id: never more than the vocabulary's size.
    best = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("best")))
    said = held.select("batch", "place", "keys").join(counts.join(best, "a"), "keys").select("batch", "place", "n", (F.col("n") == F.col("best")).alias("top"))

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row, many = left.slice(0, 1), right.num_rows
        n, top = np.zeros(many, np.int64), np.zeros(many, bool)
        place = right.column("place").to_numpy()
        n[place], top[place] = right.column("n").to_numpy(), right.column("top").to_numpy()
        col = lambda c: row.column(c).combine_chunks().values
        size = col("size").to_numpy()
        gap, times = np.frombuffer(zstandard.ZstdDecompressor().decompress(row.column("packed")[0].as_py()), "<i4").reshape(2, -1)
        at, ends = np.cumsum(gap), np.append(0, np.cumsum(size))
        total = lambda v: np.diff(np.append(0, np.cumsum(v))[ends])
        return pa.table([col("doc_id"), *(col(c).cast(pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                         pa.array(total(times * top[at])), pa.array(total(times * n[at])), col("sha")],
                        names=[c.split()[0] for c in SCHEMA.split(", ")])

    figures = batches.drop("keys", "docs").withColumnRenamed("batch", "of")
    return figures.groupBy("of").cogroup(said.groupBy("batch")).applyInArrow(finish, SCHEMA)
