"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from itemspark.llm import lexical

DOC = "doc_id bigint, text string, score bigint, rank int, query int"
ITEM = "item_id bigint, text string, doc_id bigint"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, 7, 7, 7) for d, t in rows], DOC)


def plain(rows, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(w), len(w)) for d, w in ((d, split(t)) for d, t in rows) if w]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in held:
            m = 10 + 90 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(split(text)) if t in c)
            if s > 0:
                found.append((-s, d is not None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def table():
    rnd = random.Random(11)
    word = [f"{a}{b}" for a in "abcdefgh" for b in ("", "x", "É", "é9", "Q")]
    weights = [1 / (k + 1) for k in range(len(word))]
    rows = [(k, " ".join(rnd.choices(word, weights, k=rnd.randint(0, 40))) + rnd.choice(["", "!", "-a_b", "\n"])) for k in range(700)]
    rows += [(2000 + k, "a b ax gQ hé9 copy") for k in range(120)] + [(5, "a b"), (5, "a b"), (None, "a b ax gQ hé9 copy"), (900, None), (901, ""), (902, "!! ??"), (903, "hQ " * 20_000)]
    items = [(k, " ".join(rnd.choices(word, k=rnd.randint(1, 14)))) for k in range(25)] + [(50, "A B aX gq HÉ9 copy"), (51, None), (52, "unheard of"), (53, ""), (None, "hQ"), (3, "hQ"), (3, "copy hQ")]
    return rows, items


@pytest.mark.parametrize("block, shipped", [(4096, 1 << 20), (50, 1 << 20), (64, 1000)])
def test_search_is_that_of_scoring_everything(spark, table, monkeypatch, block, shipped):
    rows, items = table
    monkeypatch.setattr(lexical, "BLOCK", block)
    got = lexical.search(docs(spark, rows).repartition(5), spark.createDataFrame([(i, t, 1) for i, t in items], ITEM), shipped=shipped, limit=6000).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, items)


def test_pair_bounds_leave_documents_out_and_lose_none(spark, table):
    """At a threshold, fewer documents are scored to the end than hold a term, and all above it are found."""
    rows, items = table
    asked = lexical.Items([t for _, t in items])
    held = [r for r in rows if lexical.terms(r[1])]
    counted = [Counter(w for w in lexical.terms(t) if w in asked.number) for _, t in held]
    asked.weigh(len(held), Counter(asked.number[w] for c in counted for w in c))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in held], "n": [len(lexical.terms(t)) for _, t in held],
                                        "terms": pa.array([[asked.number[w] for w in c] for c in counted], pa.list_(pa.int32())),
                                        "times": pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))})
    row = next(lexical._indexed(asked, len(held), sum(len(lexical.terms(t)) for _, t in held))([batch]))
    block = lexical.Block({name: row.column(k)[0] for k, name in enumerate(row.schema.names)}, asked)
    saved = 0
    for own, pairs in zip(asked.of, asked.pairs_of, strict=True):
        every = block.exact(own, np.arange(block.size))
        for least in np.sort(every)[[-1, -10, -100]].tolist():
            found, scores = block.search(own, pairs, least)
            want = np.flatnonzero(every >= max(least, 1))
            assert found.tolist() == want.tolist() and (scores == every[want]).all()
        single = block.limit[own]
        both = [max(int(block.joint[p]), *single[k:k + 2]) for k, p in enumerate(pairs.tolist())]
        saved += sum(j < a + b for j, a, b in zip(both, single, single[1:], strict=False))
    assert saved > 10


def test_empty_tables(spark):
    some, none = docs(spark, [(1, "a")]), docs(spark, [(1, "a")]).where("false")
    items = spark.createDataFrame([(1, "a", 1)], ITEM)
    assert lexical.search(none, items).count() == 0
    assert lexical.search(some, items.where("false")).count() == 0
    assert lexical.search(docs(spark, [(1, None)]), items).count() == 0
    assert [tuple(r) for r in lexical.search(some, items).collect()] == [(1, 1, 1, plain([(1, "a")], [(1, "a")])[0][3])]
