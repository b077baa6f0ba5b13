"""Backups: guarded reads with quarantine, dumps, versioned restore, deterministic snapshots.

Records travel in long form: one JSON line per progress record, attempt, session or result. The nested
single-document envelope is read too; it is only written by whoever needs that small format.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.operators.stages import stage

NUMBER = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$"
ATTEMPT = "struct<at:double,correct:boolean,confidence:string,selfGraded:boolean,elapsedMs:double>"
PROGRESS = f"struct<contentHash:string,box:double,dueAt:double,timesWrong:double,correction:string,notes:string,attempts:array<{ATTEMPT}>>"
RESULT = "struct<contentHash:string,questionId:double,correct:boolean,confidence:string,skillArea:string,elapsedMs:double>"
SESSION = f"struct<id:string,mode:string,startedAt:double,finishedAt:double,scaledScore:double,results:array<{RESULT}>>"
# Microseconds survive the trip through text.
TIME_FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CONFIDENCE = ("guessed", "unsure", "confident")


def _kind(v: Column, path: str) -> Column:
    """JSON type at a path; null when absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is(v: Column, path: str, pattern: str) -> Column:
    return F.coalesce(_kind(v, path).rlike(pattern), F.lit(False))


def _elements(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _all(v: Column, path: str, test) -> Column:
    return F.coalesce(F.forall(_elements(v, path), test), F.lit(False))


def _reason(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first failing check; null for a sound record."""
    return F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok in checks])


def progress_reason(v: Column, strict: bool = True) -> Column:
    """Why a progress record (a variant) cannot be trusted. Lenient mode skips the integer and attempt-detail checks."""
    text_or_null = r"^(STRING|VOID)$"
    box = F.try_variant_get(v, "$.box", "double")

    def attempt_ok(a):
        good = _is(a, "$.at", NUMBER) & _is(a, "$.correct", "^BOOLEAN$") & F.coalesce(
            F.try_variant_get(a, "$.confidence", "string").isin(*CONFIDENCE), F.lit(False))
        return good & _is(a, "$.selfGraded", "^BOOLEAN$") & _is(a, "$.elapsedMs", NUMBER) if strict else good

    box_ok = _is(v, "$.box", NUMBER) & F.coalesce(box.between(1, 5), F.lit(False))
    if strict:
        box_ok = box_ok & F.coalesce(box == F.floor(box), F.lit(False))
    return _reason([
        ("not json", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))),
        ("no key", _is(v, "$.contentHash", "^STRING$")), ("bad box", box_ok), ("bad due time", _is(v, "$.dueAt", NUMBER)),
        ("bad wrong count", _is(v, "$.timesWrong", NUMBER)), ("no attempts", _is(v, "$.attempts", "^ARRAY")),
        ("bad attempt", _all(v, "$.attempts", attempt_ok)), ("bad correction", _is(v, "$.correction", text_or_null)),
        ("bad notes", _is(v, "$.notes", text_or_null)),
    ])


def session_reason(v: Column, strict: bool = True) -> Column:
    def result_ok(r):
        good = _is(r, "$.contentHash", "^STRING$") & _is(r, "$.correct", "^BOOLEAN$") & _is(r, "$.skillArea", "^STRING$")
        return good & F.coalesce(F.try_variant_get(r, "$.confidence", "string").isin(*CONFIDENCE), F.lit(False)) if strict else good

    return _reason([
        ("not json", F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))),
        ("no id", _is(v, "$.id", "^STRING$")), ("bad start time", _is(v, "$.startedAt", NUMBER)),
        ("no results", _is(v, "$.results", "^ARRAY")), ("bad result", _all(v, "$.results", result_ok)),
    ])


def judge(rows: DataFrame, raw: str, reason: Callable[[Column], Column]) -> DataFrame:
    """Add the reason code of each raw JSON text; it is parsed once and judged once."""
    parsed = stage(rows, {"_v": F.try_parse_json(raw)})
    return stage(parsed, {"reason": reason(F.col("_v"))}, keep=rows.columns)


def split_records(rows: DataFrame, raw: str, reason: Callable[[Column], Column], schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): parsed sound records, and the raw text of the others with a reason code."""
    judged = judge(rows, raw, reason)
    good = judged.filter(F.col("reason").isNull()).withColumn("record", F.from_json(raw, schema)).drop("reason", raw)
    return good, judged.filter(F.col("reason").isNotNull())


def read_envelope(spark: SparkSession, path: str, strict: bool = True) -> dict[str, DataFrame]:
    """Nested backup files: progress, attempts, sessions, results of sound elements, and quarantine.

    A file of another version or without both lists is rejected as a whole.
    """
    files = spark.read.schema("version string, progress array<string>, sessions array<string>, _corrupt string").option(
        "columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    sound = F.coalesce((F.col("version") == "1") & F.col("progress").isNotNull() & F.col("sessions").isNotNull(), F.lit(False))
    rejected = files.filter(~sound).select("file", F.lit("not a version 1 backup").alias("reason"), F.lit(None).cast("string").alias("raw"))
    known = files.filter(sound)
    p, bad_p = split_records(known.select("file", F.explode("progress").alias("raw")), "raw", lambda v: progress_reason(v, strict), PROGRESS)
    s, bad_s = split_records(known.select("file", F.explode("sessions").alias("raw")), "raw", lambda v: session_reason(v, strict), SESSION)
    return {
        "progress": p.select("file", progress_columns()), "attempts": p.select("file", F.col("record.contentHash").alias("content_hash"), F.inline("record.attempts")),
        "sessions": s.select("file", F.col("record.id").alias("id"), F.col("record.mode").alias("mode"), *[millis(F.col(f"record.{a}")).alias(b) for a, b in (("startedAt", "started_at"), ("finishedAt", "finished_at"))]),
        "results": s.select("file", F.col("record.id").alias("session_id"), F.posexplode("record.results").alias("pos", "r")).select("file", "session_id", "pos", "r.*"),
        "quarantine": rejected.unionByName(bad_p.select("file", "reason", "raw")).unionByName(bad_s.select("file", "reason", "raw")),
    }


def millis(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("bigint"))


def progress_columns() -> Column:
    r = lambda n: F.col(f"record.{n}")
    return F.inline(F.array(F.struct(
        r("contentHash").alias("content_hash"), F.least(F.lit(5), F.greatest(F.lit(1), F.round(r("box")))).cast("int").alias("box"),
        millis(r("dueAt")).alias("due_at"), r("timesWrong").cast("bigint").alias("times_wrong"), r("correction").alias("correction"), r("notes").alias("notes"))))


def write_dump(frames: dict[str, DataFrame], path: str) -> None:
    """Whole-state dump: one folder of JSON lines per table."""
    for name, df in frames.items():
        df.write.mode("errorifexists").options(**TIME_FORMATS).json(f"{path}/{name}", ignoreNullFields=False)


def read_dump(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(s).options(**TIME_FORMATS).json(f"{path}/{name}") for name, s in schemas.items()}


def restore(df: DataFrame, root: str, version: int) -> None:
    """Replace-all: write a new version next to the old, then append a pointer to it.

    Readers follow the newest pointer, so they see the old state or the new one, never a mix, and
    nothing being read is overwritten.
    """
    df.write.mode("errorifexists").parquet(f"{root}/v={version}")
    df.sparkSession.range(1).select(F.lit(version).alias("version")).write.mode("append").json(f"{root}/pointer")


def _version(spark: SparkSession, root: str) -> int:
    return spark.read.schema("version bigint").json(f"{root}/pointer").agg(F.max("version")).first()[0]


def current(spark: SparkSession, root: str) -> DataFrame:
    """The state the newest pointer names."""
    return spark.read.parquet(f"{root}/v={_version(spark, root)}")


def restore_all(frames: dict[str, DataFrame], root: str, version: int) -> None:
    """Replace several tables in one step: all of a version are written before its pointer is."""
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{root}/v={version}/{name}")
    spark = next(iter(frames.values())).sparkSession
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").json(f"{root}/pointer")


def current_all(spark: SparkSession, root: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of the version the newest pointer names."""
    version = _version(spark, root)
    return {name: spark.read.parquet(f"{root}/v={version}/{name}") for name in names}


def write_snapshot(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Columns by name, rows by key over range partitions, LF line ends. Two runs over the same rows hold
    the same lines; how lines fall into part files is no part of the contract (see :func:`rows_digest`)."""
    df.select(*sorted(df.columns)).orderBy(*key).write.mode("errorifexists").json(path, lineSep="\n", ignoreNullFields=False)


def _row_bits(df: DataFrame) -> Column:
    """The leading 60 md5 bits of a row, columns by name."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cols)), 1, 15), 16, 10).cast("decimal(38,0)")


def _added_up(bits: str) -> Column:
    """Sum modulo 2**60: blind to order, but not to how often a row stands there."""
    return F.coalesce((F.sum(bits) % F.lit(1 << 60).cast("decimal(38,0)")).cast("bigint"), F.lit(0).cast("bigint")).alias("digest")


def rows_digest(df: DataFrame) -> DataFrame:
    """Order-free content digest of a frame: row count and the sum, modulo 2**60, of each row's leading md5 bits."""
    return df.select(_row_bits(df).alias("_h")).agg(F.count(F.lit(1)).alias("n_rows"), _added_up("_h"))


def range_digests(df: DataFrame, key: str, width: int) -> DataFrame:
    """Per range of ``width`` keys: range_id, n_rows, digest. Ranges add up to ``rows_digest`` (modulo 2**60)."""
    rows = df.select(F.floor(F.col(key) / F.lit(width)).alias("range_id"), _row_bits(df).alias("_h"))
    return rows.groupBy("range_id").agg(F.count(F.lit(1)).alias("n_rows"), _added_up("_h"))


def changed_ranges(before: DataFrame, after: DataFrame, key: str, width: int = 100_000) -> DataFrame:
    """The key ranges in which two snapshots differ: range_id, rows_before, rows_after. Rows meet only as digests."""
    a, b = (range_digests(x, key, width).select("range_id", F.col("n_rows").alias(f"rows_{n}"), F.col("digest").alias(f"_{n}")) for x, n in ((before, "before"), (after, "after")))
    both = a.withColumn("_at", F.coalesce("range_id", F.lit(-1) - F.lit(1 << 62))).drop("range_id").join(
        b.withColumn("_at", F.coalesce("range_id", F.lit(-1) - F.lit(1 << 62))).drop("range_id"), "_at", "full")
    rows = [F.coalesce(f"rows_{n}", F.lit(0).cast("bigint")).alias(f"rows_{n}") for n in ("before", "after")]
    at = F.when(F.col("_at") != F.lit(-1) - F.lit(1 << 62), F.col("_at")).alias("range_id")
    return both.where(~F.col("_before").eqNullSafe(F.col("_after")) | ~F.col("rows_before").eqNullSafe(F.col("rows_after"))).select(at, *rows)


def write_review_queue(queue: DataFrame, path: str) -> None:
    queue.write.mode("errorifexists").json(path)
