"""Helpers shared by the corpus operators: tables, worker path, text batches, class letters."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where the cluster has not installed it."""
    spark.sparkContext.environment.setdefault(
        "PYTHONPATH", os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x))


def pieces(batches: Iterable[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one piece hold about ``limit`` bytes; one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for k, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += int(size)
        yield batch.slice(start)


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def share(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
