"""A marked-up exam dump derived from every line of every row of ``documents``.

Each line becomes one block: marker, optional type marker and shared background, stem, options,
answer, page break, explanation with numbered slots, references. The item number is the line's
length, so lines of equal length repeat a marker. The oracle states the expected fields directly from
the line, without parsing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemspark.functions import items as it
from itemspark.functions.identity import content_hash
from itemspark.functions.text import legacy_notes, once
from itemspark.operators.extract import FIELDS, extract_fields, segments
from itemspark.operators.stages import stage
from itemspark.plans.adapters import documents

L = F.lit


def _block(line: Column, i: Column) -> Column:
    first, last = F.substring_index(line, " ", 1), F.substring_index(line, " ", -1)
    # The number of words; like the words themselves made only where it is written.
    size = F.octet_length(line) - F.octet_length(F.replace(line, L(" "))) + 1
    return once(F.length(line), lambda n: _written(line, i, n, first, last, size))


def _written(line: Column, i: Column, n: Column, first: Column, last: Column, size: Column) -> Column:
    num, choice = n.cast("string"), n % 3 == 0
    none = L("")
    return F.concat(
        L("  Question: "), num, L("\n"),
        F.when(n % 3 == 1, L("HOTSPOT -\n")).when(n % 3 == 2, L("DRAG DROP\n-\n")).otherwise(none),
        F.when(n % 11 == 0, F.concat(L("Case study -\nThis is a case study. Read it all.\nMore.\n\nBackground of "), first, L("\n\n"))).otherwise(none),
        L("Consider "), line, L("\n"),
        F.when(choice, F.concat(L("A."), L("the "), first, L("\nB. a "), last, L("\n"), F.when(n % 5 == 0, L("A.again\n")).otherwise(none),
                                L("C.\tcount "), size.cast("string"), L("\n"))).otherwise(none),
        F.when(~choice | (n % 7 == 0), L("Answer:\n")).when(n % 2 == 0, L("Answer: AC\n")).when(n % 4 == 1, L("Answer: D, A\n")).otherwise(L("Answer:\n B\n")),
        L("\fExplanation:\n"),
        F.when(~choice & (n % 4 != 0), F.concat(L("Box 1: pick "), first, L(" - Box 2: pick "), last, L("\nBox 1: restated\n"))).otherwise(none),
        L("Because "), line, F.when(n % 13 == 0, L(" (Common Data Service and CDS)")).otherwise(none), L("\n"),
        F.when(n % 6 == 5, F.concat(L("See https://example.org/e"), num, L("\n"))).otherwise(
            F.concat(L("Reference:\nhttps://docs.example.org/"), num, L("/\ntail"), i.cast("string"), L("\nhttps://example.org/"), num, L("\n"))))


def raw_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    blocks = F.transform(F.split("text", "\n"), lambda line, i: _block(line, i))
    return docs.select("doc_id", F.concat(L("Front matter\n"), F.array_join(blocks, "")).alias("text"))


def raw_items(spark: SparkSession, sf_dir: str, source: str = "a", fields: Sequence[str] = FIELDS, spread: Sequence[str] | None = None) -> DataFrame:
    return extract_fields(segments(raw_dump(spark, sf_dir), offsets=False), source, fields=fields, spread=spread)


def dump_items(spark: SparkSession, sf_dir: str, fields: Sequence[str] = (*FIELDS, "self_graded", "content_hash", "currency_note", "currency")) -> DataFrame:
    """The dump's items with the wanted columns of a reconciled bank."""
    own = {
        "self_graded": (["type", "options", "correct", "boxes"], it.self_graded),
        "content_hash": (["type", "stem", "options", "boxes"], lambda: content_hash(F.col("type"), F.col("stem"), F.col("options"), F.col("boxes"), F.col("images"))),
        "currency_note": (["stem", "explanation", "refs"], lambda: legacy_notes(F.concat_ws(" ", "stem", "explanation", F.array_join("refs", " ")))),
    }
    made = [n for n in own if n in fields or n == "currency_note" and "currency" in fields]
    read = dict.fromkeys([*[f for f in fields if f in FIELDS], *[x for n in made for x in own[n][0]]])
    rows = raw_items(spark, sf_dir, fields=list(read)).withColumn("images", F.array().cast("array<string>"))
    if made:
        rows = stage(rows, {n: own[n][1]() for n in made})
    if "currency" in fields:
        rows = rows.withColumn("currency", F.when(F.col("currency_note").isNull(), "current").otherwise("suspect"))
    return rows.withColumn("subtopic", F.lit("general"))


CTE_LINES = """lines AS (
  SELECT doc_id, i - 1 AS i, line, length(line) AS n, string_split(line, ' ') AS words, words[1] AS fst, words[-1] AS lst, len(words) AS size,
         length(line) % 3 = 0 AS choice
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
blocks AS (
  SELECT *, '  Question: ' || n || chr(10)
    || CASE n % 3 WHEN 1 THEN 'HOTSPOT -' || chr(10) WHEN 2 THEN 'DRAG DROP' || chr(10) || '-' || chr(10) ELSE '' END
    || CASE WHEN n % 11 = 0 THEN 'Case study -' || chr(10) || 'This is a case study. Read it all.' || chr(10) || 'More.' || chr(10) || chr(10) || 'Background of ' || fst || chr(10) || chr(10) ELSE '' END
    || 'Consider ' || line || chr(10)
    || CASE WHEN choice THEN 'A.the ' || fst || chr(10) || 'B. a ' || lst || chr(10) || CASE WHEN n % 5 = 0 THEN 'A.again' || chr(10) ELSE '' END || 'C.' || chr(9) || 'count ' || size || chr(10) ELSE '' END
    || CASE WHEN NOT choice OR n % 7 = 0 THEN 'Answer:' || chr(10) WHEN n % 2 = 0 THEN 'Answer: AC' || chr(10) WHEN n % 4 = 1 THEN 'Answer: D, A' || chr(10) ELSE 'Answer:' || chr(10) || ' B' || chr(10) END AS head,
    CASE WHEN NOT choice AND n % 4 <> 0 THEN 'Box 1: pick ' || fst || ' - Box 2: pick ' || lst || chr(10) || 'Box 1: restated' || chr(10) ELSE '' END
    || 'Because ' || line || CASE WHEN n % 13 = 0 THEN ' (Common Data Service and CDS)' ELSE '' END || chr(10)
    || CASE WHEN n % 6 = 5 THEN 'See https://example.org/e' || n || chr(10) ELSE '' END AS expl,
    CASE WHEN n % 6 = 5 THEN '' ELSE 'Reference:' || chr(10) || 'https://docs.example.org/' || n || '/' || chr(10) || 'tail' || i || chr(10) || 'https://example.org/' || n || chr(10) END AS tail
  FROM lines),
raw AS (SELECT *, head || chr(12) || 'Explanation:' || chr(10) || expl || tail AS body FROM blocks)"""

CTE_ITEMS = CTE_LINES + """,
items AS (
  SELECT doc_id, n AS id, CASE n % 3 WHEN 1 THEN 'hotspot' WHEN 2 THEN 'dragdrop' ELSE CASE WHEN NOT (n % 7 = 0) AND (n % 2 = 0 OR n % 4 = 1) THEN 'mcq-multi' ELSE 'mcq-single' END END AS type,
    'Consider ' || rtrim(line) AS stem, line,
    CASE WHEN choice THEN [{'key': 'A', 'text': rtrim('the ' || fst)}, {'key': 'B', 'text': rtrim('a ' || lst)}, {'key': 'C', 'text': 'count ' || size}] ELSE [] END AS options,
    CASE WHEN NOT choice OR n % 7 = 0 THEN [] WHEN n % 2 = 0 THEN ['A', 'C'] WHEN n % 4 = 1 THEN ['A', 'D'] ELSE ['B'] END AS correct,
    trim(regexp_replace(expl, ' +' || chr(10), chr(10), 'g'), ' ' || chr(10)) AS explanation,
    CASE WHEN n % 6 = 5 THEN ['https://example.org/e' || n] ELSE ['https://docs.example.org/' || n || '/tail' || i || 'https://example.org/' || n] END AS refs,
    CASE WHEN NOT choice AND n % 4 <> 0 THEN [{'box': 1, 'answer': rtrim('pick ' || fst, ' -')}, {'box': 2, 'answer': rtrim('pick ' || lst, ' -')}] ELSE [] END AS boxes,
    CASE WHEN n % 11 = 0 THEN rtrim('Background of ' || fst) END AS background, choice, n
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY i) AS rn FROM blocks) WHERE rn = 1)"""
