"""Sources: whole documents, nested item records, media, and dealing out of unsplittable scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.operators.reconcile import RAW_FIELDS

ITEM_SCHEMA = ", ".join(["id bigint", "source string", *[f"`{n}` {t}" for n, t in RAW_FIELDS.items()]])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, text). Bytes that are no UTF-8 come back as replacement characters."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("text"))


def read_items(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested item records with an explicit schema: one array per file, or (splittable) one object per line."""
    return spark.read.schema(ITEM_SCHEMA).json(path, multiLine=multi_line)


def read_media(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Binary media: path, size, bytes, digest."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path", "length", "content", F.substring(F.sha2("content", 256), 1, 12).alias("digest"),
        (F.col("length") < k.MIN_IMAGE_BYTES).alias("too_small"))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A scan dealt to as many tasks as the session asks for in ``spark.itemspark.scan.tasks``; unset, the scan as it is.

    Clusters leave it unset: their tables have splits enough, cut by ``spark.sql.files.maxPartitionBytes``. A
    laptop sets it where a table is one row group, which cannot be split.
    """
    tasks = df.sparkSession.conf.get("spark.itemspark.scan.tasks", None)
    return df.repartition(int(tasks), key) if tasks else df
