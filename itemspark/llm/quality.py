"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``WORDS`` words between blanks (bytes up to 0x20). A passage is encoded as the
hashed counts of its byte 1-, 2- and 3-grams, damped and scaled to length 1, then by a learnt layer. Gated attention
weighs the passages: the weight of passage code e is exp(w . (tanh(V e) * sigmoid(U e))), divided by the sum over the
document; the score is the logistic function of a linear form of the weighted mean code. Only documents are
labelled: which passages matter is learnt. All layers are trained together by Adam on the labelled rows, with the
rarer label weighted up to the share ``BALANCE``.

Learnt from: labelled rows whose crc32(id as text) mod 4 is not 2, a bounded sample of ``ROWS`` documents in hash
order of id and text, of which those are kept whose passages, added up in that order, stay within ``PASSAGES``. A
long document is used whole or not at all. Scores cover all rows and whole texts, long ones in stretches of bytes.

Null and empty texts and texts of blanks have no passage: they get the share of good labels among such documents of
the sample, or of the whole sample where it has none. Repeated rows are scored each; where an id has several labels,
the lower counts; null labels and null ids teach nothing, nor do labels of missing documents. Without labels every
score is 0.5; with one kind of label only, every score is that label. Other columns play no part; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemspark.llm.common import crc_mod, pieces, ship

#: Documents and passages learnt from; words of a passage; hashed features; sizes of code and gate.
ROWS, PASSAGES, WORDS, FEATURES, CODE, GATE = 4_000, 24_000, 64, 1_024, 24, 12
#: Passes over the sample, documents of a step, step size, weight decay, share of the rarer label in the loss.
PASSES, STEP, RATE, DECAY, BALANCE = 30, 128, 0.01, 1e-4, 0.3
#: Bytes encoded at once.
STRETCH = 1 << 20
SCHEMA = "doc_id bigint, score double"


@dataclass(frozen=True)
class Model:
    """Layers by name; ``empty`` is the score without passages."""

    layers: dict[str, np.ndarray] | None
    empty: float


def passages(text: bytes, words: int = WORDS) -> np.ndarray:
    """The passage of every byte; blanks belong to the word before them."""
    blank = np.frombuffer(text, np.uint8) <= 0x20
    starts = ~blank & np.append(True, blank[:-1])
    return np.maximum(np.cumsum(starts, dtype=np.int32) - 1, 0) // words


def encoded(text: bytes, words: int = WORDS, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """Scaled feature rows of the text's passages, a few thousand passages at a time."""
    if not text.strip(bytes(range(0x21))):
        return
    raw, of = np.frombuffer(text, np.uint8).astype(np.uint32), passages(text, words)
    carry = None
    for start in range(0, len(raw), stretch):
        part, own = raw[start:start + stretch + 2], of[start:start + stretch]
        low, many = int(own[0]), int(own[-1] - own[0]) + 1
        counts = np.zeros(many * FEATURES)
        code, last = np.zeros(len(part), np.uint32), part
        for size in range(3):
            n = min(len(own), len(part) - size)
            if n <= 0:
                break
            code = (code[:n] if size else np.zeros(n, np.uint32)) * np.uint32(257) + last[size:size + n] + np.uint32(1)
            slot = (code * np.uint32(2654435761)) >> np.uint32(22)
            inside = slice(None) if not size else of[start:start + n] == of[start + size:start + size + n]
            counts += np.bincount(((own[:n] - low).astype(np.int64) * FEATURES + slot)[inside], minlength=many * FEATURES)
        rows = counts.reshape(many, FEATURES)
        if carry is not None:
            if carry[0] == low:
                rows[0] += carry[1]
            else:
                yield _scaled(carry[1][None])
        if start + stretch < len(raw):
            carry, rows = (low + many - 1, rows[-1].copy()), rows[:-1]
        if len(rows):
            yield _scaled(rows)


def _scaled(rows: np.ndarray) -> np.ndarray:
    out = np.log1p(rows)
    return (out / np.sqrt((out * out).sum(1, keepdims=True))).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _attended(m: dict[str, np.ndarray], code: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Scores of bags and what the gradient needs; ``starts`` has the first passage of each bag, none empty."""
    t, s = np.tanh(code @ m["v"]), _sigmoid(code @ m["u"])
    logit = (t * s) @ m["w"]
    size = np.diff(np.append(starts, len(code)))
    raised = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), size))
    weight = raised / np.repeat(np.add.reduceat(raised, starts), size)
    mean = np.add.reduceat(code * weight[:, None], starts)
    return _sigmoid(mean @ m["c"] + m["d"][0]), t, s, weight, mean, size


def fitted(rows: np.ndarray, starts: np.ndarray, labels: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """The layers after training on bags of feature rows."""
    rnd = np.random.default_rng(seed)
    m = {"e": rnd.normal(0, 1, (FEATURES, CODE)), "b": np.zeros(CODE), "v": rnd.normal(0, CODE**-0.5, (CODE, GATE)), "u": rnd.normal(0, CODE**-0.5, (CODE, GATE)),
         "w": rnd.normal(0, GATE**-0.5, GATE), "c": rnd.normal(0, CODE**-0.5, CODE), "d": np.zeros(1)}
    m = {k: x.astype(np.float32) for k, x in m.items()}
    first, second = ({k: np.zeros_like(x) for k, x in m.items()} for _ in range(2))
    ends, rare = np.append(starts[1:], len(rows)), labels.mean() < 0.5
    share = min(labels.mean(), 1 - labels.mean())
    up = max(1.0, BALANCE / (1 - BALANCE) * (1 - share) / share)
    cost = np.where((labels > 0.5) == rare, up, 1.0).astype(np.float32)
    turn = 0
    for _ in range(PASSES):
        for own in np.array_split(order := rnd.permutation(len(starts)), -(-len(order) // STEP)):
            x = np.concatenate([rows[starts[k]:ends[k]] for k in own]).astype(np.float32)
            at = np.append(0, np.cumsum(ends[own] - starts[own]))[:-1]
            code = np.tanh(x @ m["e"] + m["b"])
            score, t, s, weight, mean, size = _attended(m, code, at)
            of = np.repeat(np.arange(len(own)), size)
            miss = (score - labels[own]) * cost[own] / len(own)
            g = {"c": mean.T @ miss, "d": miss.sum(keepdims=True)}
            to_mean = miss[:, None] * m["c"]
            along = (code * to_mean[of]).sum(1)
            to_logit = weight * (along - np.repeat(np.add.reduceat(weight * along, at), size))
            g["w"] = (t * s).T @ to_logit
            to_t, to_s = to_logit[:, None] * m["w"] * s * (1 - t * t), to_logit[:, None] * m["w"] * t * s * (1 - s)
            g["v"], g["u"] = code.T @ to_t, code.T @ to_s
            to_code = (weight[:, None] * to_mean[of] + to_t @ m["v"].T + to_s @ m["u"].T) * (1 - code * code)
            g["e"], g["b"] = x.T @ to_code, to_code.sum(0)
            turn += 1
            for k, value in m.items():
                slope = g[k] + DECAY * value
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                m[k] = value - (RATE * first[k] / (1 - 0.9**turn) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return m


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """The score of every text; codes of passages are kept, their features are not."""
    out = np.full(len(texts), model.empty)
    if model.layers is None:
        return out
    m, codes, starts, of = model.layers, [], [], []
    have = 0
    for k, text in enumerate(texts):
        got = [np.tanh(x @ m["e"] + m["b"]) for x in encoded((text or "").encode())]
        if got:
            codes += got
            starts.append(have)
            of.append(k)
            have += sum(map(len, got))
    if of:
        out[of] = _attended(m, np.concatenate(codes), np.array(starts))[0]
    return out


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS, most: int = PASSAGES) -> Model:
    """Learns from labelled rows whose crc32(id as text) mod 4 is not 2."""
    ship(docs.sparkSession)
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("good"))
    known = known.where(F.col("good").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.min("good").alias("good"))
    whole = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = whole.withColumn("h", F.xxhash64("doc_id", "text"))
    # Texts stay where they are: figures of the rows meet the labels, and the chosen rows, ``rows`` at most, the texts.
    slim = whole.select("doc_id", "h", (F.size(F.split("text", r"[\x00-\x20]+")) / WORDS + 1).alias("n")).join(known, "doc_id").distinct()
    sample = slim.orderBy("h", "doc_id").limit(rows).withColumn("upto", F.sum("n").over(Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    sample = sample.where(F.col("upto") <= most).select("doc_id", "h", "good")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            for good, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(encoded(body.encode()))
                rows_ = np.concatenate(found).astype(np.float16) if found else np.zeros((0, FEATURES), np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([good], pa.int32()), pa.array([rows_.tobytes()], pa.binary())], names=["good", "x"])

    picked = whole.join(F.broadcast(sample), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    held = picked.orderBy("h", "doc_id").select("good", "text").mapInArrow(features, "good int, x binary").collect()
    labels_ = np.array([r[0] > 0 for r in held], np.float32)
    bags = [np.frombuffer(r[1], np.float16).reshape(-1, FEATURES) for r in held]
    full = np.array([len(b) > 0 for b in bags], bool)
    if not len(labels_):
        return Model(None, 0.5)
    empty = float(labels_[~full].mean() if (~full).any() else labels_.mean())
    if not full.any() or labels_[full].min() == labels_[full].max():
        return Model(None, float(labels_.mean()) if not full.any() else float(labels_[full].mean()))
    sizes = np.array([len(b) for b in bags])[full]
    return Model(fitted(np.concatenate(bags), np.append(0, np.cumsum(sizes))[:-1], labels_[full]), empty)


def scored(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(model, batch.column(1).to_pylist()).astype(np.float64))], names=["doc_id", "score"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def predicted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = scored(docs, trained(docs, labels, doc_id, text, label), doc_id, text)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
