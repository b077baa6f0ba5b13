"""Text-to-record queries over the dump derived from ``documents``, and over pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspark.functions import text as t
from itemspark.operators import extract as ex
from itemspark.plans import adapters as ad
from itemspark.plans.dump import CTE_ITEMS, CTE_LINES, raw_dump, raw_items

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


CTE_SEGMENTS = f"""{CTE_LINES},
placed AS (SELECT doc_id, n AS id, body, 13 + coalesce(sum(length(body)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
   row_number() OVER (PARTITION BY doc_id, n ORDER BY i) AS rn FROM raw),
segs AS (SELECT doc_id, id, body, CAST(lo AS BIGINT) AS seg_start, CAST(lo + length(body) AS BIGINT) AS seg_end FROM placed WHERE rn = 1)"""


@register("marker_segments", f"WITH {CTE_SEGMENTS} SELECT doc_id, id, md5(body) AS body_md5, seg_start, seg_end FROM segs")
def marker_segments(spark, sf):
    return ex.segments(raw_dump(spark, sf)).select(
        "doc_id", "id", F.md5("body").alias("body_md5"), F.col("start").alias("seg_start"), F.col("end").alias("seg_end"))


CTE_SPANS = f"""{CTE_SEGMENTS},
docs AS (SELECT doc_id, 'Front matter' || chr(10) || string_agg(body, '' ORDER BY i) AS text FROM raw GROUP BY 1),
pages0 AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS page_text, generate_subscripts(string_split(text, chr(12)), 1) AS page FROM docs),
spans AS (SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(coalesce(sum(length(page_text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo,
  length(page_text) AS len FROM pages0)"""


@register("page_spans", f"WITH {CTE_SPANS} SELECT doc_id, page, lo, lo + len AS hi FROM spans")
def page_spans(spark, sf):
    return ex.page_spans(raw_dump(spark, sf))


@register("segment_pages", f"""WITH {CTE_SPANS}
SELECT s.doc_id, id, page FROM segs s JOIN spans p ON s.doc_id = p.doc_id AND lo < seg_end AND lo + len >= seg_start""")
def segment_pages(spark, sf):
    dump = raw_dump(spark, sf)
    segs = ex.segments(dump).select("doc_id", "id", "start", "end")
    return ex.overlap_join(segs, ex.page_spans(dump)).select("doc_id", "id", "page")


@register("marker_ownership", """WITH m AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS owner FROM conversations)
SELECT conv_id, turn, owner FROM m WHERE owner IS NOT NULL""")
def marker_ownership(spark, sf):
    """A user turn is the marker; turns before the first one belong to nobody."""
    c = ad.table(spark, sf, "conversations").withColumn("marker", F.when(F.col("role") == "user", F.col("turn")))
    return ex.own_by_marker(c, doc="conv_id", order="turn").select("conv_id", "turn", "owner")


@register("owned_blocks", """WITH m AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS owner FROM conversations)
SELECT conv_id, owner, row_number() OVER (PARTITION BY conv_id, owner ORDER BY turn) AS nth, text AS line FROM m WHERE owner IS NOT NULL AND trim(text) <> ''""")
def owned_blocks(spark, sf):
    c = ad.table(spark, sf, "conversations").withColumn("marker", F.when(F.col("role") == "user", F.col("turn")))
    owned = ex.own_by_marker(c, doc="conv_id", order="turn")
    return ex.block_lines(owned, ["conv_id", "owner"], "turn", "text")


@register("split_run_markers", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS para FROM documents)
SELECT doc_id, CAST(para - 1 AS INTEGER) AS para, 'Question: ' || length(line) || ' ' || line AS line, length(line) AS marker FROM l""")
def split_run_markers(spark, sf):
    """Every line is a paragraph of three runs, with its marker broken over the first two."""
    docs = ad.documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "line"))
    parts = F.array(F.lit("Quest"), F.concat(F.lit("ion: "), F.length("line").cast("string")), F.concat(F.lit(" "), F.col("line")))
    runs = docs.select("doc_id", "para", F.posexplode(parts).alias("run", "payload")).withColumn("kind", F.lit("TXT"))
    return ex.paragraphs_of_runs(runs).select("doc_id", "para", "line", "marker")


# RE2 has no lookaround, and none is needed here: the same steps, in order.
CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\.[ ]*of', ' ', 'g'), chr(12), chr(10)), '[ \t]+\n', chr(10), 'g'),
  '(?m)^[ \t]*-[ \t]*$\n?', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"""


@register("cleaned_blocks", f"""SELECT doc_id, regexp_replace(regexp_replace({CLEAN}, '^\\s+', ''), '\\s+$', '') AS text
FROM (SELECT doc_id, replace(replace(text, '. ', ' ' || chr(10)), ' the ', chr(10) || ' - ' || chr(10)) AS text FROM documents)""")
def cleaned_blocks(spark, sf):
    """Whole documents broken into more lines, some of them lone hyphens, then cleaned; the watermark is a pattern."""
    messy = F.replace(F.replace("text", F.lit(". "), F.lit(" \n")), F.lit(" the "), F.lit("\n - \n"))
    return ad.documents(spark, sf).select("doc_id", t.clean_block(messy, r"\.[ ]*of").alias("text"))


@register("stripped_markers", f"""WITH {CTE_LINES} SELECT doc_id, i AS para,
  regexp_replace(regexp_replace(regexp_replace(head, 'Question:\\s*\\d+', '', 'g'), 'Answer:', '', 'g'), '(?m)^[ \\t]*(HOTSPOT|DRAG DROP)\\b[ \\t]*-?[ \\t]*', '', 'g') AS text FROM raw""")
def stripped_markers(spark, sf):
    from itemspark.plans.dump import _block
    heads = F.transform(F.split("text", "\n"), lambda line, i: t.strip_markers(F.substring_index(_block(line, i), "\f", 1)))
    docs = ad.documents(spark, sf)
    return docs.select("doc_id", F.posexplode(heads).alias("para", "text")).withColumn("para", F.col("para").cast("bigint"))


def fields(spark, sf, want, *cols):
    """Items with the wanted fields extracted, shown as ``cols`` or as they are."""
    return raw_items(spark, sf, fields=want).select("doc_id", "id", *(cols or want))


def items_sql(*cols):
    return f"WITH {CTE_ITEMS} SELECT doc_id, id, {', '.join(cols)} FROM items"


@register("wrapped_urls", items_sql("array_to_string(refs, ' ') AS refs", "CAST(len(refs) AS INTEGER) AS n_refs"))
def wrapped_urls(spark, sf):
    """References with a link broken over two lines, or harvested from the explanation."""
    return fields(spark, sf, ["refs"], F.array_join("refs", " ").alias("refs"), F.size("refs").alias("n_refs"))


@register("sections", items_sql("stem", "explanation"))
def sections(spark, sf):
    return fields(spark, sf, ["stem", "explanation"])


@register("labelled_options", items_sql("array_to_string(list_transform(options, lambda o: o.key || ':' || o.text), '|') AS options"))
def labelled_options(spark, sf):
    return fields(spark, sf, ["options"], F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(":"), o["text"])), "|").alias("options"))


@register("answer_keys", items_sql("array_to_string(correct, '') AS correct"))
def answer_keys(spark, sf):
    return fields(spark, sf, ["correct"], F.array_join("correct", "").alias("correct"))


@register("numbered_slots", items_sql("array_to_string(list_transform(boxes, lambda b: b.box || ':' || b.answer), '|') AS boxes"))
def numbered_slots(spark, sf):
    return fields(spark, sf, ["boxes"], F.array_join(F.transform("boxes", lambda b: F.concat(b["box"].cast("string"), F.lit(":"), b["answer"])), "|").alias("boxes"))


@register("shared_backgrounds", items_sql("background", "stem"))
def shared_backgrounds(spark, sf):
    return fields(spark, sf, ["background", "stem"])


@register("item_types", items_sql("type"))
def item_types(spark, sf):
    return fields(spark, sf, ["type"])


NOTES = """list_filter([CASE WHEN choice AND n % 7 = 0 THEN 'no answer key in PDF text; candidate for DOCX merge' END,
  CASE WHEN list_contains(correct, 'D') THEN 'answer key [''D''] has no matching option' END,
  CASE WHEN NOT choice AND n % 4 = 0 THEN 'no Box N: structure; will need self-grading against the image' END,
  CASE WHEN n % 13 = 0 THEN 'References Common Data Service; terminology superseded by Dataverse. References CDS; terminology superseded by Dataverse.' END], lambda x: x IS NOT NULL)"""
NOTED = f"""WITH {CTE_ITEMS}, noted AS (SELECT *, {NOTES} AS notes FROM items)"""
LOW = "CASE WHEN len(notes) > 0 AND NOT (n % 13 = 0 AND len(notes) = 1) THEN 'low' ELSE 'high' END"


@register("parse_notes", f"{NOTED} SELECT doc_id, id, array_to_string(notes, '; ') AS notes, {LOW} AS confidence FROM noted")
def parse_notes(spark, sf):
    return fields(spark, sf, ["parse_notes", "parse_confidence"], F.array_join("parse_notes", "; ").alias("notes"), F.col("parse_confidence").alias("confidence"))


@register("parse_notes_second_source", f"""WITH {CTE_ITEMS} SELECT doc_id, id,
  CASE WHEN len(correct) = 0 THEN 'no answer key in DOCX text' ELSE '' END AS notes, CASE WHEN len(correct) = 0 THEN 'low' ELSE 'high' END AS confidence FROM items""")
def parse_notes_second_source(spark, sf):
    return raw_items(spark, sf, "b", ["parse_notes", "parse_confidence"]).select("doc_id", "id", F.array_join("parse_notes", "; ").alias("notes"), F.col("parse_confidence").alias("confidence"))


@register("page_links", """SELECT page_id, array_to_string(list_transform(list_distinct_in_order, lambda x: x), ' ') AS links FROM (
  SELECT page_id, list_filter(found, lambda x, i: list_position(found, x) = i) AS list_distinct_in_order
  FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, 'https?://[^\\s)>\\]]+') AS found FROM pages))""")
def page_links(spark, sf):
    p = ad.table(spark, sf, "pages")
    return p.select("page_id", F.array_join(t.urls(F.concat_ws(" ", "url", "html")), " ").alias("links"))


@register("url_hosts", """SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS host FROM pages""")
def url_hosts(spark, sf):
    return ad.table(spark, sf, "pages").select("page_id", t.host_of(F.col("url")).alias("host"))


@register("code_languages", """WITH h AS (SELECT page_id, html AS code FROM pages UNION ALL SELECT doc_id, 'using  System; ' || text FROM documents UNION ALL SELECT doc_id, text FROM documents)
SELECT CASE WHEN starts_with(trim(code), '<') AND regexp_matches(code, '</[A-Za-z]|/>|<\\?xml') THEN 'xml'
  WHEN regexp_matches(code, '\\busing\\s+System\\b') THEN 'csharp' ELSE 'javascript' END AS language, count(*) AS n FROM h GROUP BY 1""")
def code_languages(spark, sf):
    """Pages are markup, documents with a C# preamble are C#, bare documents neither."""
    d = ad.documents(spark, sf).select(F.col("text").alias("code"))
    rows = ad.table(spark, sf, "pages").select(F.col("html").alias("code")).union(
        d.select(F.concat(F.lit("using  System; "), F.col("code")).alias("code"))).union(d)
    return rows.groupBy(t.code_language(F.col("code")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
