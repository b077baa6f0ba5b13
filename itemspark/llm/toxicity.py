"""Toxicity by compression distance: two zstandard dictionaries, window lengths, calibrated thresholds.

A window is one word between blanks, in lower case, followed by a fixed anchor. One dictionary is trained on passages
of ordinary text. The other is made of those windows of toxic text that ordinary text does not share: their word is
in so many toxic passages as ``SHARE`` of the toxic documents (``LEAST`` at least) and ``LIFT`` times as common there
as in ordinary ones (passages are stretches of words, counted once however many documents repeat them), the most
common last, ``TOXIC_BYTES`` in all. A window that this dictionary holds compresses to little more than a frame and
one match; one that it holds in part, or not at all, to more. A window counts as toxic if its length under the toxic
dictionary is at most ``most`` and shorter by ``gap`` than under the ordinary one (and than without any). Both thresholds are calibrated on
documents: the pair is taken under which the number of toxic windows tells the labels best. A document's score is the
share of toxic documents among calibration documents with as many toxic windows.

The labelled rows learnt from are a bounded sample: at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` documents, in hash
order of their ids; half of them train the dictionaries, half calibrate. Everything else is whole texts of
all documents. Null and empty texts have no words and get the score of a document without a toxic word;
repeated rows are scored each; several labels of one id count as toxic if one does, null labels do not count;
labels of missing documents have no effect. Without a toxic or an ordinary labelled document every score is
0 and nothing is predicted toxic. Empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.llm.common import crc_mod, pieces, ship

TOXIC_ROWS, ORDINARY_ROWS = 4_000, 8_000
#: Words of a passage; passages that a word must be in, as a share of the toxic documents and at least; times as common there.
PASSAGE, SHARE, LEAST, LIFT = 12, 0.012, 3, 20
TOXIC_BYTES, ORDINARY_BYTES, ORDINARY_WINDOWS = 65_536, 65_536, 40_000
#: Bytes above the shortest length, and bytes shorter than under the ordinary dictionary, that are tried; less than a match costs is noise.
OVER, GAPS = (0, 1, 2, 3), (3, 4, 5, 6)
LEVEL = 3
ANCHOR = bytes(range(1, 17))
#: Counts of toxic words that are told apart, and words a worker remembers.
COUNTS, KEPT = 8, 150_000
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Model:
    """``most`` and ``gap``: the thresholds of a toxic window; ``scores``: by toxic windows."""

    toxic: bytes
    ordinary: bytes
    most: int
    gap: int
    scores: tuple[float, ...]


@cache
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False)


def lengths(word: bytes, toxic: bytes, ordinary: bytes) -> tuple[int, int]:
    """The window's compressed length under the toxic dictionary, and under the better of the ordinary one and none."""
    window = b" " + word + b" " + ANCHOR
    near, far, bare = (len(_compressor(d).compress(window)) for d in (toxic, ordinary, b""))
    return near, min(far, bare)


class Judge:
    """Counts the toxic words of texts; remembers, within a bound, which words it has measured."""

    def __init__(self, model: Model):
        self.model, self.seen, self.toxic = model, set(), set()

    def count(self, text: str) -> int:
        words = WORD.findall(text.lower())
        distinct = set(words)
        if fresh := distinct - self.seen:
            if len(self.seen) > KEPT:
                self.seen, fresh = set(), distinct
            self.seen |= fresh
            m = self.model
            for word in fresh:
                near, far = lengths(word.encode(), m.toxic, m.ordinary)
                if near <= m.most and far - near >= m.gap:
                    self.toxic.add(word)
        return 0 if distinct.isdisjoint(self.toxic) else sum(w in self.toxic for w in words)

    def score(self, text: str | None) -> float:
        scores = self.model.scores
        return scores[min(self.count(text), len(scores) - 1)] if text else scores[0]


@cache
def judge(model: Model) -> Judge:
    return Judge(model)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there are too few samples to train one, the samples' own last bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from labelled rows whose crc32(id as text) mod 5 is not 0."""
    ship(docs.sparkSession)
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select(F.col(doc_id).cast("bigint").alias("doc_id")), "doc_id", "left_semi")
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*by_hash).limit(TOXIC_ROWS).unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(ORDINARY_ROWS))
    # At most TOXIC_ROWS + ORDINARY_ROWS ids: small enough for every task, so that no text is shuffled.
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.withColumn("half", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(2)))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    passages = rows.where("half = 0").select("toxic", words.alias("w")).where(F.size("w") > 0).select("toxic", F.explode(F.transform(
        F.sequence(F.lit(0), (F.size("w") - 1).cast("int"), F.lit(PASSAGE)), lambda k: F.slice("w", k + 1, PASSAGE))).alias("p"))
    passages = passages.groupBy("p").agg(F.min("toxic").alias("toxic"), F.xxhash64("p").alias("h")).persist()
    n = {r[0]: r[1] for r in passages.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        passages.unpersist()
        return Model(b"", b"", -1, 0, (0.0,))
    count = lambda k: F.count(F.when(F.col("toxic") == k, 1))
    marked = passages.select("toxic", F.explode(F.array_distinct("p")).alias("word")).groupBy("word").agg(count(1).alias("t"), count(0).alias("o"))
    least = max(LEAST, SHARE * rows.where("half = 0 AND toxic = 1").select("text").distinct().count())
    marked = marked.where((F.col("t") >= least) & (F.col("t") / n[1] >= LIFT * (F.col("o") + 0.5) / n[0]))
    marked = [r[0] for r in marked.orderBy(F.desc("t"), "word").limit(TOXIC_BYTES // len(ANCHOR)).collect()]
    ordinary = [f" {' '.join(r[0])} ".encode() for r in passages.where("toxic = 0").orderBy("h", "p").limit(ORDINARY_WINDOWS).select("p").collect()]
    passages.unpersist()
    if not marked:
        return Model(b"", b"", -1, 0, (0.0,))
    pair = b"".join(b" " + w.encode() + b" " + ANCHOR for w in reversed(marked))[-TOXIC_BYTES:], _dictionary(ordinary, ORDINARY_BYTES)
    floor = min(lengths(w.encode(), *pair)[0] for w in marked)
    tried = [(floor + over, gap) for over in OVER for gap in GAPS]

    # The other half: documents by their number of toxic windows under every pair of thresholds.
    tell = rows.where("half = 1").select("toxic", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: Counter = Counter()
        known: dict[str, list[int]] = {}
        for batch in pieces(batches, 1):
            for kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: Counter = Counter()
                for word, many in Counter(WORD.findall((body or "").lower())).items():
                    if word not in known:
                        if len(known) > KEPT:
                            known.clear()
                        near, far = lengths(word.encode(), *pair)
                        known[word] = [c for c, (most, gap) in enumerate(tried) if near <= most and far - near >= gap]
                    for c in known[word]:
                        found[c] += many
                for c in range(len(tried)):
                    cells[c, min(found[c], COUNTS), int(kind > 0)] += 1
        rows_ = [(*at, many) for at, many in cells.items()]
        yield pa.RecordBatch.from_pydict({name: pa.array([r[k] for r in rows_], pa.int64()) for k, name in enumerate(("pair", "windows", "toxic", "n"))})

    tables = np.zeros((len(tried), COUNTS + 1, 2))
    for c, windows, kind, many in tell.mapInArrow(measure, "pair bigint, windows bigint, toxic bigint, n bigint").groupBy("pair", "windows", "toxic").agg(F.sum("n")).collect():
        tables[c, windows, kind] += many
    told = [_scores(t) for t in tables]
    best = int(np.argmax([(t * np.log([[1 - x, x] for x in s])).sum() for t, s in zip(tables, told, strict=True)]))
    return Model(*pair, *tried[best], told[best])


def _scores(table: np.ndarray) -> tuple[float, ...]:
    """The share of toxic documents by count, never falling: counts that would fall are pooled.

    A count leans on the share of all documents with a toxic word, by the weight of one document.
    """
    any_word = (table[1:, 1].sum() + 0.2) / (table[1:].sum() + 1)
    pools = [[t + (any_word if k else 0.2), o + t + 1.0, 1] for k, (o, t) in enumerate(table.tolist())]
    out: list[list[float]] = []
    for pool in pools:
        out.append(pool)
        while len(out) > 1 and out[-2][0] / out[-2][1] > out[-1][0] / out[-1][1]:
            last = out.pop()
            out[-1] = [out[-1][k] + last[k] for k in range(3)]
    return tuple(t / n for t, n, many in out for _ in range(int(many)))


def scored(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: str | None = None) -> DataFrame:
    """doc_id, score and, if asked for, one column of the input."""
    ship(df.sparkSession)
    fields = [F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), *([F.col(keep).cast("int").alias(keep)] if keep else [])]
    names = ["doc_id", "score", *([keep] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = judge(model)
        for batch in pieces(batches, 1):
            scores = pa.array([say.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, *batch.columns[2:]], names=names)

    return df.select(*fields).mapInArrow(run, "doc_id bigint, score double" + (f", {keep} int" if keep else ""))


def predicted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = scored(docs, trained(docs, labels, doc_id, text), doc_id, text)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = judge(model)
        for batch in pieces(batches, at):
            yield batch.filter(pa.array([say.score(t) < 0.5 for t in batch.column(at).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)
