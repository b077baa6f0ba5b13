"""The pipeline against plain loops, and the registration of the corpus queries."""

import importlib.util
import math
import re

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from itemspark.llm import decontaminate, secrets, toxicity
from itemspark.llm.common import table

SF = "/root/testdata/sf0.001"
brute = importlib.util.spec_from_file_location("pairs_and_pages", __file__.replace("test_pipeline", "test_pairs_and_pages"))
pairs = importlib.util.module_from_spec(brute)
brute.loader.exec_module(pairs)
PLAIN = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for r in secrets.RULES]


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, (rule, p) in enumerate(zip(secrets.RULES, PLAIN, strict=True)) for m in p.finditer(text)
                  if m.end(rule.group) - m.start(rule.group) >= rule.least)


@pytest.fixture(scope="module")
def expected(spark):
    docs = [r.asDict() for r in table(spark, SF, "documents").collect()]
    model = toxicity.trained(table(spark, SF, "documents"), table(spark, SF, "labels"))

    def toxic(text):
        near = [toxicity.lengths(w.encode(), model.toxic, model.ordinary) for w in toxicity.WORD.findall(text.lower())]
        n = sum(a <= model.most and b - a >= model.gap for a, b in near)
        return model.scores[min(n, len(model.scores) - 1)] >= 0.5

    docs = [d for d in docs if not toxic(d["text"])]
    prints = [(d["doc_id"], pairs.brute_fingerprint(d["text"])) for d in docs]
    label = pairs.brute_components(prints, 3)
    docs = [d for d in docs if label[d["doc_id"]] == d["doc_id"]]
    items = [decontaminate.folded(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    nodes = [decontaminate.Node(t, 0, len(t), math.floor(decontaminate.RATE * len(t)), None) for t in items if len(t) >= decontaminate.LEAST]

    def leaks(text):
        text = decontaminate.folded(text)
        return any(n.distance(text, 0, len(text)) <= n.errors for n in nodes)

    docs = [d for d in docs if not leaks(d["text"])]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.MODEL))
    for d in docs:
        if found := plain_spans(d["text"]):
            d["text"] = secrets.blanked(d["text"], found, [r.kind for r in secrets.RULES])
            d["n_chars"] = len(d["text"])
        d["token_ids"] = library.encode(d["text"])
        d["n_tokens"] = len(d["token_ids"])
    return docs


def test_pipeline_against_plain_loops(spark, expected):
    got = sorted((r.asDict() for r in corpus_pipeline.run(spark, SF).collect()), key=lambda r: r["doc_id"])
    assert got == sorted(expected, key=lambda r: r["doc_id"]) and 0 < len(got) < table(spark, SF, "documents").count()


def test_stages_keep_columns_and_take_empty_and_odd_documents(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", None, None, 0), (-2, None, "en", "s", None)], docs.schema)
    for rows in (docs.where("false"), odd):
        kept = rows
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, SF)
            assert kept.columns[:5] == docs.columns, name
        got = {(r["doc_id"], r["text"]) for r in kept.collect()}
        assert got <= {tuple(r)[:2] for r in odd.collect()}
        assert kept.schema["n_tokens"] is not None


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
