"""Cross-tokenizer alignment against plain loops over the libraries' own tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from itemspark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOC = "doc_id bigint, text string, lang string, groups string, n_a bigint, batch string"
ODD = ["", None, " ", "\n", "a\n\nb ", "  a  b", "a" + " " * 5_000 + "b", "the" * 3_000, "x" * 6_000 + "é" * 2_000, "日本 𝒳\x00\tab", "▁a", "a▁b", "123 !!", "représenter",
       "<s></s><0x0A>", "<|endoftext|> it's", "a \n b", "\x1c\x1d \x85  x", "tab\tand\rreturn\r\n", "same text", "same text", " \t \n  "]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    letters = "abc the tion \n\n  'sélèßñ日\x00\t.,!?<>0123456789AB\x1c\x85\xa0ǝ"
    return ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(300)]


def plain(texts, libraries):
    """Tokens, groups and links one text at a time, then counts over all."""
    a_model, b_model = libraries
    names = {v: k for k, v in a_model.get_vocab().items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    out, held = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = a_model.encode(raw.decode(), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_raw = [bytes(back[c] for c in names[k]) for k in a]
        b_raw = [bytes([int(p[3:5], 16)]) if b_model.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b_model.id_to_piece(k)) for k in b)]
        if not text or b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            out.append(None)
            continue
        spans = []
        for parts in (a_raw, b_raw):
            ends = np.cumsum([len(x) for x in parts]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (x, y) in enumerate(spans[1]) if s < y and x < e] if len(raw) < 4000 else _swept(a, b, spans)
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [[[t for t, (s, e) in zip(ids, span, strict=True) if low <= s and e <= high] for ids, span in zip((a, b), spans, strict=True)]
                  for low, high in zip([0, *shared[:-1]], shared, strict=True)]
        out.append((a, b, groups, links))
        held.update(set(links))
    best = Counter()
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return out, held, best


def _swept(a, b, spans):
    i = j = 0
    links = []
    while i < len(a) and j < len(b):
        links.append((a[i], b[j]))
        x, y = spans[0][i][1], spans[1][j][1]
        i, j = i + (x <= y), j + (y <= x)
    return links


def test_alignment_is_that_of_plain_loops(spark, libraries, texts):
    df = spark.createDataFrame([(k, t, "en", "old", 1, "old") for k, t in enumerate(texts)], DOC).repartition(3)
    rows = {r["doc_id"]: r for r in alignment.aligned(df, A, B).collect()}
    assert len(rows) == len(texts)
    found, held, best = plain(texts, libraries)
    some = 0
    for k, x in enumerate(found):
        if x is None:
            assert tuple(rows[k])[1:] == (0, 0, 0, 0, 0, 0, ""), texts[k]
            continue
        a, b, groups, links = x
        digest = hashlib.sha256(";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups).encode()).hexdigest()
        assert tuple(rows[k])[1:] == (len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), digest), texts[k]
        some += 1
    assert some > 200
    assert found[ODD.index("▁a")] is None


def test_groups_are_real_ids(spark, libraries):
    df = spark.createDataFrame([(1, "représenter the tokens", "en", "", 1, ""), (2, None, "en", "", 1, ""), (3, "b", "en", "", 1, "")], DOC)
    got = {r["doc_id"]: [[list(g["a"]), list(g["b"])] for g in r["groups"]] for r in alignment.groups(df, A, B).collect()}
    found, _, _ = plain(["représenter the tokens", None, "b"], libraries)
    assert got == {1: found[0][2], 3: found[2][2]}


def test_small_pieces_give_the_links_of_large_ones():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        last = int(rnd.integers(1, 80))
        a, b = (np.append(np.sort(rnd.choice(last, int(rnd.integers(0, last)), replace=False))[1:], last) for _ in range(2))
        want = alignment.overlaps(a, b, 1 << 10)
        for width in (1, 2, 3, 7):
            assert all((x == y).all() for x, y in zip(alignment.overlaps(a, b, width), want, strict=True))
        pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if (a[i - 1] if i else 0) < b[j] and (b[j - 1] if j else 0) < a[i]]
        assert list(zip(want[0].tolist(), want[1].tolist(), strict=True)) == pairs


def test_long_texts_in_parts_have_the_librarys_ids(libraries, monkeypatch):
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdeé1.\n") for _ in range(rnd.randint(1, 9))) for _ in range(3000))
    want_a, want_b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    for size in (50, 700):
        monkeypatch.setattr(alignment, "PART", size)
        monkeypatch.setattr(alignment.parts, "__defaults__", (size,))
        assert len(alignment.parts(text)) > 10 and "".join(alignment.parts(text)) == text
        assert alignment.byte_level(A)[0](text).tolist() == want_a and alignment.piece_level(B)[0](text).tolist() == want_b


def test_empty_tables_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b", "en", "", 1, ""), (5, "a b", "en", "", 1, ""), (5, "a b", "en", "", 1, "")], DOC)
    assert alignment.aligned(df.where("false"), A, B).count() == 0
    rows = alignment.aligned(df.repartition(3), A, B).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["doc_id"] or 0)] == [None, 5, 5]
    assert {r["count_sum"] for r in rows} == {3 * rows[0]["n_links"]}
    assert alignment.aligned(df.withColumn("text", F.lit(None).cast("string")), A, B).agg(F.sum("n_links")).first()[0] == 0
