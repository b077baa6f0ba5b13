"""Attention-based quality: features and scores against plain loops, held-out rows, odd tables."""

import math

import numpy as np
import pytest

from itemspark.llm import quality

SF = "/root/testdata/sf0.1"
DOC = "doc_id bigint, text string, score double, good int, quality int, h bigint"
LABEL = "doc_id bigint, quality int, toxic int, text string"


def plain_features(text, words):
    """Counts of hashed byte 1-, 2- and 3-grams per passage, a blank belonging to the word before it."""
    of, word, before = [], -1, True
    for b in text:
        if b > 0x20 and before:
            word += 1
        before = b <= 0x20
        of.append(max(word, 0) // words)
    rows = np.zeros((of[-1] + 1, quality.FEATURES))
    for k in range(len(text)):
        code = 0
        for size in range(3):
            if k + size < len(text) and of[k + size] == of[k]:
                code = (code * 257 + text[k + size] + 1) % 2**32
                rows[of[k], (code * 2654435761 % 2**32) >> 22] += 1
    rows = np.log1p(rows)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


@pytest.mark.parametrize("words, stretch", [(4, 16), (3, 7), (64, 50), (2, 1 << 20)])
def test_features_are_those_of_plain_loops(words, stretch):
    for text in (("ab c  d\n e fgh éé i j k l m n o p " * 5).encode(), b"  x", b"longword" * 30, b"a " * 40):
        got = np.concatenate(list(quality.encoded(text, words, stretch)))
        assert np.allclose(got, plain_features(text, words), atol=1e-6)
    assert not list(quality.encoded(b" \n\t ")) and not list(quality.encoded(b""))


def test_scores_are_those_of_plain_loops():
    rnd = np.random.default_rng(1)
    shapes = {"e": (quality.FEATURES, 5), "b": 5, "v": (5, 3), "u": (5, 3), "w": 3, "c": 5, "d": 1}
    m = {k: rnd.normal(0, 1, s).astype(np.float32) for k, s in shapes.items()}
    texts = ["one " * 200 + "two three " * 50, None, "", "short", "é" * 300 + " x" * 130, " \n "]
    want = []
    for text in texts:
        if not (text or "").strip():
            want.append(0.25)
            continue
        codes = [np.tanh(x @ m["e"] + m["b"]) for x in plain_features(text.encode(), quality.WORDS)]
        raised = [math.exp(sum(m["w"][g] * math.tanh(e @ m["v"][:, g]) / (1 + math.exp(-(e @ m["u"][:, g]))) for g in range(3))) for e in codes]
        mean = sum(r * e for r, e in zip(raised, codes, strict=True)) / sum(raised)
        want.append(1 / (1 + math.exp(-(mean @ m["c"] + m["d"][0]))))
    assert np.allclose(quality.scores(quality.Model(m, 0.25), texts), want, atol=1e-5)


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.predicted(docs, labels).where("held_out").join(labels, "doc_id").select("quality", "score", "predicted").collect()
    bad, good = ([r for r in rows if r["quality"] == k] for k in (0, 1))
    assert len(bad) > 100 and len(good) > 700
    assert sum(r["predicted"] == 0 for r in bad) / len(bad) >= 0.9
    assert sum(r["predicted"] == 1 for r in good) / len(good) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def small(spark, n=60, lone=None):
    texts = [("the calm water of a lake " * 9 if k % 2 else "BUY!! NOW!! $$$ " * 9) + str(k) for k in range(n)]
    docs = spark.createDataFrame([(k, t, 5.0, 9, 9, 9) for k, t in enumerate(texts)] + [(1000, None, 5.0, 9, 9, 9), (1001, "", 5.0, 9, 9, 9), (None, "x", 5.0, 9, 9, 9), (3, texts[3], 5.0, 9, 9, 9)], DOC)
    labels = spark.createDataFrame([(k, k % 2 if lone is None else lone, 0, "z") for k in range(n)] + [(None, 0, 0, ""), (5000, 0, 0, ""), (7, None, 0, "")], LABEL)
    return docs, labels


def test_odd_rows_and_clashing_names(spark):
    docs, labels = small(spark)
    rows = quality.predicted(docs.repartition(3), labels).collect()
    assert len(rows) == 64 and sum(r["doc_id"] == 3 for r in rows) == 2
    by = {r["doc_id"]: r["score"] for r in rows}
    assert all((by[k] >= 0.7) == bool(k % 2) for k in range(60))
    assert by[1000] == by[1001]


def test_little_to_learn_from(spark):
    docs, labels = small(spark)
    assert {r["score"] for r in quality.predicted(docs, labels.where("false")).collect()} == {0.5}
    assert {r["score"] for r in quality.predicted(*small(spark, 8, 1)).collect()} == {1.0}
    assert quality.predicted(docs.where("false"), labels).count() == 0
    held = quality.trained(docs, labels, rows=20)
    assert held.layers is not None


def test_the_sample_is_the_same_for_any_partitions(spark):
    docs, labels = small(spark)
    one, two = (quality.trained(docs.repartition(n), labels, rows=30) for n in (1, 7))
    assert all((one.layers[k] == two.layers[k]).all() for k in one.layers)
