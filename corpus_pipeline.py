"""A training-corpus pipeline over ``documents``: each stage is one corpus operator, written and read again.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns documents with
their columns; the last adds token ids. Toxic documents go, one document of each SimHash component stays,
documents with a benchmark passage go, secrets are replaced by their kind, and texts are encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from itemspark.llm import decontaminate, piececoding, secrets, simhash, toxicity
from itemspark.llm.common import table
from itemspark.session import work_dir

MODEL = "piece_bpe_32k.model"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piececoding.encoded(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("piece coding", encoded),
]

#: The learnt and iterative stages have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written below the session's work folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), work_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
