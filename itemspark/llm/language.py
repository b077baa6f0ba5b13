"""Language identification by string kernels.

A text's blended spectrum is the set of its byte n-grams of 1, 2 and 3 bytes, in lower case, with every ASCII
character but letters as one blank. Two texts' kernel is the number of n-grams they share over the geometric
mean of their numbers (presence, not counts). Landmarks, spread over the languages, give the Nyström features;
ridge regression on them, one language against the rest, gives the weights. Texts are scored in batches: a
0/1 matrix of their n-grams times the landmarks' n-grams, times the weights.

The labelled rows learnt from are a bounded sample, about ``ROWS`` of all languages together and at most
``LANGUAGES`` languages (the most frequent ones, ties by name), in hash order of their ids; n-grams are the
``GRAMS`` that most documents of the sample hold (ties by number). Only the text decides a prediction.

A null text and one without a letter get ``und`` and score 0, as does every text if nothing can be learnt.
Repeated rows are scored each; rows with a null language are not learnt from; columns other than id, text and
language play no part; an empty table gives an empty result. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.llm.common import crc_mod, pieces, share, ship

ROWS, LANGUAGES, LANDMARKS, GRAMS = 3_000, 500, 128, 8_192
RIDGE = 1e-2
#: Documents of one matrix product.
BATCH = 64
NONE = np.uint16(65535)
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"

#: Lower-case text's bytes: letters and bytes of other scripts stay, the rest is one blank.
FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each between blanks, and where each begins; one more for the end."""
    framed = pc.binary_join_element_wise(" ", pc.utf8_lower(pc.fill_null(texts, "")), " ", "")
    framed = pa.concat_arrays([framed])
    ends = np.frombuffer(framed.buffers()[1], np.int32, len(framed) + 1 + framed.offset)[framed.offset:]
    data = np.frombuffer(framed.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    return FOLD[data], (ends - ends[0]).astype(np.int64)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """At every byte the number of the n-gram that begins there, by n; the last n - 1 bytes have none."""
    wide = data.astype(np.int32)
    two = wide[:-1] << 8 | wide[1:]
    return [wide, two + 256, (two[:-1] << 8 | wide[2:]) + 65792]


def spectra(texts: pa.Array) -> list[bytes]:
    """Each text's n-grams, sorted, as 32-bit numbers."""
    data, ends = folded(texts)
    return [np.unique(np.concatenate(grams(data[a:b]))).astype("<i4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@dataclass(frozen=True, eq=False)
class Model:
    languages: tuple[str, ...]
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def _kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    shared = rows @ landmarks.T
    return shared / np.sqrt(np.maximum(rows.sum(1), 1)[:, None] * np.maximum(landmarks.sum(1), 1)[None, :])


def fitted(spectra_: list[np.ndarray], names: list[str]) -> Model | None:
    """Learns from spectra and their languages, in the given order."""
    languages = sorted(set(names))
    if not languages:
        return None
    found, many = np.unique(np.concatenate(spectra_), return_counts=True)
    vocabulary = np.sort(found[np.lexsort((found, -many))[:GRAMS]])
    rows = np.zeros((len(names), len(vocabulary)), np.float32)
    for k, s in enumerate(spectra_):
        rows[k, np.searchsorted(vocabulary, s[np.isin(s, vocabulary)])] = 1
    each = max(1, LANDMARKS // len(languages))
    label = np.array([languages.index(x) for x in names])
    chosen = np.concatenate([np.flatnonzero(label == c)[:each] for c in range(len(languages))])
    landmarks = rows[chosen]
    values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks).astype(np.float64))
    use = values > 1e-6 * values.max()
    into = vectors[:, use] / np.sqrt(values[use])
    phi = np.c_[_kernel(rows, landmarks).astype(np.float64) @ into, np.ones(len(names))]
    want = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Each language weighs as much as another, whatever its share of the sample.
    weight = (1.0 / np.bincount(label)[label])[:, None] * len(names) / len(languages)
    solved = np.linalg.solve(phi.T @ (weight * phi) + RIDGE * np.eye(phi.shape[1]), phi.T @ (weight * want))
    return Model(tuple(languages), vocabulary.astype(np.int32), landmarks, (into @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32))


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.column = np.full(65792 + (1 << 24), NONE, np.uint16)
        self.column[model.grams] = np.arange(len(model.grams))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each text, by place, and its regression value."""
        best, value = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        width = len(self.model.grams)
        for start in range(0, len(texts), BATCH):
            data, ends = folded(texts.slice(start, BATCH))
            n = len(ends) - 1
            rows = np.zeros(n * width, np.float32)
            base = np.repeat(np.arange(n, dtype=np.int32) * width, np.diff(ends))
            for gram in grams(data):
                column = self.column[gram]
                ok = np.flatnonzero(column != NONE)
                # A text ends in a blank and the next begins with one, so the n-grams across are those of blanks.
                rows[base[ok] + column[ok]] = 1
            scores = _kernel(rows.reshape(n, width), self.model.landmarks) @ self.model.weights + self.model.bias
            best[start:start + n] = scores.argmax(1)
            value[start:start + n] = scores.max(1)
        return best, value


def trained(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Learns from rows with a language whose crc32(id as text) mod 4 is not 2."""
    ship(docs.sparkSession)
    id_ = F.col(doc_id).cast("bigint")
    known = docs.where(F.col(lang).isNotNull() & (crc_mod(id_, 4) != 2)).select(id_.alias("doc_id"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return None
    each = max(6, ROWS // len(sizes))
    wanted = F.create_map(*[x for r in sizes for x in (F.lit(r[0]), F.lit(min(1.0, each / r[1])))])
    sample = known.withColumn("at", share(F.col("doc_id"))).where((F.col("at") < F.element_at(wanted, F.col("lang"))) & F.col("text").rlike(r"\p{L}"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spectra(batch.column(2)), pa.binary())], names=["doc_id", "lang", "spectrum"])

    rows = sample.select("doc_id", "lang", "text").mapInArrow(measure, "doc_id bigint, lang string, spectrum binary").collect()
    rows.sort(key=lambda r: (r[1], r[0] is None, r[0], bytes(r[2])))
    return fitted([np.frombuffer(r[2], "<i4") for r in rows], [r[1] for r in rows]) if rows else None


def predicted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    return identified(docs, trained(docs, doc_id, text, lang), doc_id, text)


def identified(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model) if model else None
        for batch in pieces(batches, 1):
            names, values = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            told = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False))
            if score and len(told):
                best, value = score(batch.column(1).take(pa.array(told)))
                for k, c in zip(told.tolist(), best.tolist(), strict=True):
                    names[k] = model.languages[c]
                values[told] = np.clip((1 + value) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(values, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    body, id_ = F.col(text).cast("string"), F.col(doc_id).cast("bigint")
    return docs.select(id_.alias("doc_id"), body.alias("text"), (crc_mod(id_, 4) == 2).alias("held_out"),
                       F.coalesce(body.rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(run, SCHEMA)
