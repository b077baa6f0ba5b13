"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.llm import alignment, decontaminate, language, lexical, maintext, permutation, piececoding, quality, secrets, simhash, tokencount, toxicity, warc
from itemspark.llm.common import table

MODEL, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return language.predicted(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to.

    The table has no capture times; a page's id stands for the second of a year. The rows come in the order of
    the merged index; its own columns are left out.
    """
    at = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31536000)))
    found = warc.captures(table(spark, sf_dir, "pages").withColumn("captured_at", at))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return permutation.neighbours(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return simhash.components(table(spark, sf_dir, "documents"))


def op5_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip."""
    return piececoding.coded(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return toxicity.predicted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return maintext.extracted(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, edits: the benchmark items that documents hold."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return quality.predicted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.path(MODEL))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_warc, op3_neighbours, op4_simhash, op5_piece_coding, op6_toxicity, op7_main_text, op8_secret_scan, op9_token_counts,
                                   op10_decontamination, op11_lexical_search, op12_quality, op13_alignment)}

#: SQL for the queries that it can express; the tests hold the others against brute force.
ORACLES: dict[str, str] = {
    "op2_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, upper(sha1(coalesce(html, ''))) AS x FROM pages),
d AS (SELECT page_id, h, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM g""",
    "op11_lexical_search": r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM t WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term, docs),
b AS (SELECT row_number() OVER () AS q, item_id, text FROM benchmark),
i AS (SELECT DISTINCT q, item_id, term FROM (SELECT q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM b)),
s AS (SELECT q, item_id, r, doc_id, CAST(sum(weight * (1000000000 * tf // (1000 * tf + 8 * (10 + 90 * n * docs // words)))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN p USING (term) JOIN d USING (r), c GROUP BY q, item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
}
