"""Condensed text: clips, cues, answer lines, reasons, entries, sheets, density."""

from __future__ import annotations

from pyspark.sql import functions as F

from itemspark.functions import digest as d
from itemspark.functions import items as it
from itemspark.operators import digest as dg
from itemspark.plans import adapters as ad
from itemspark.plans.dump import CTE_ITEMS, dump_items

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def flat_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def clip_sql(x: str, w: int) -> str:
    """Clipped text of an already collapsed expression."""
    h = f"left({x}, {w})"
    blank = f"(length({h}) - strpos(reverse({h}), ' '))"
    body = f"CASE WHEN strpos({h}, ' ') > 0 AND {blank} > {w * 0.6} THEN left({h}, {blank}) ELSE {h} END"
    return f"CASE WHEN length({x}) > {w} THEN regexp_replace({body}, '[\\s,;:.–-]+$', '') || ' […]' ELSE {x} END"


@register("clipped_texts", f"WITH f AS (SELECT doc_id, {flat_sql('text')} AS t FROM documents) SELECT doc_id, {clip_sql('t', 76)} AS text, length(t) > 76 AS cut FROM f")
def clipped_texts(spark, sf):
    return ad.documents(spark, sf).select("doc_id", d.clip(F.col("text"), 76).alias("c")).select("doc_id", "c.text", "c.cut")


NOISE = [(" of ", " Select and place. "), (" les ", " NOTE: one "), (" der ", " to answer, two "), (" los ", " Select the best answer. ")]


def noisy():
    c = F.col("text")
    for a, b in NOISE:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


NOISY_SQL = "text"
for _a, _b in NOISE:
    NOISY_SQL = f"replace({NOISY_SQL}, '{_a}', '{_b}')"
STRIPPED = NOISY_SQL
for _p in ("NOTE:.*", "To answer,.*", "Each correct (selection|answer presents).*", "More than one answer choice may achieve the goal.*", "Select the best answer\\.?", "Select and place\\.?"):
    STRIPPED = f"regexp_replace({STRIPPED}, '(?i){_p}', ' ', 'g')"


@register("boilerplate_removed", f"SELECT doc_id, md5({STRIPPED}) AS text_md5, length({STRIPPED}) AS n FROM documents")
def boilerplate_removed(spark, sf):
    t = d.strip_boilerplate(noisy())
    return ad.documents(spark, sf).select("doc_id", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("n"))


# Stems made of whole documents: goal lines and question sentences appear where the text has certain lengths.
ASKING_SQL = """CASE length(text) % 4 WHEN 0 THEN replace(text, ' and ', '? ') WHEN 1 THEN replace(text, chr(10), chr(10) || 'You need to ') WHEN 2 THEN replace(text, chr(10), chr(10) || 'You must to go' || chr(10)) ELSE text END"""


def asking():
    n, c = F.length("text") % 4, F.col("text")
    return (F.when(n == 0, F.replace(c, F.lit(" and "), F.lit("? "))).when(n == 1, F.replace(c, F.lit("\n"), F.lit("\nYou need to ")))
            .when(n == 2, F.replace(c, F.lit("\n"), F.lit("\nYou must to go\n"))).otherwise(c))


@register("cues", f"""WITH s AS (SELECT doc_id, source, {ASKING_SQL} AS stem FROM documents),
p AS (SELECT doc_id, source, list_filter(list_transform(string_split(stem, chr(10)), lambda x: {flat_sql('x')}), lambda x: x <> '') AS lines, regexp_extract_all({flat_sql('stem')}, '[^.?!]+\\?') AS asks FROM s),
q AS (SELECT *, {flat_sql('asks[-1]')} AS ask, list_position(list_transform(lines, lambda l: regexp_matches(l, '(?i)^you (need|must|are asked) to\\b')), true) AS at_goal FROM p),
r AS (SELECT doc_id, CASE WHEN length(ask) >= 28 THEN ask WHEN length(lines[at_goal]) >= 40 THEN lines[at_goal]
   ELSE coalesce(CASE WHEN at_goal > 1 THEN lines[at_goal - 1] END, CASE WHEN at_goal > 0 THEN lines[at_goal] END, ask, lines[-1], source) END AS t FROM q)
SELECT doc_id, {clip_sql('t', 76)} AS cue, length(t) > 76 AS cut FROM r""")
def cues(spark, sf):
    rows = dg.with_cue(ad.documents(spark, sf).select("doc_id", asking().alias("stem"), "source"), subtopic="source", name="c")
    return rows.select("doc_id", F.col("c.text").alias("cue"), "c.cut")


ANSWER_SQL = f"""answers AS (SELECT *, NOT choice AND len(boxes) = 0 AS self_graded,
  {flat_sql("array_to_string(list_transform(correct, lambda k: CASE k WHEN 'A' THEN 'A. ' || options[1].text WHEN 'B' THEN 'B. ' || options[2].text WHEN 'C' THEN 'C. ' || options[3].text ELSE k || ' — no such option in the bank' END), ' · ')")} AS choice_text,
  list_transform(boxes, lambda b: {flat_sql('b.answer')}) AS box_texts FROM items),
lines0 AS (SELECT *, CASE WHEN len(correct) > 0 AND choice THEN {clip_sql('choice_text', 96)}
    WHEN len(boxes) > 0 THEN array_to_string(list_transform(box_texts, lambda b, i: i || '. ' || {clip_sql('b', 30)}), ' · ') ELSE 'in the image — you graded this one yourself' END AS ans,
  CASE WHEN len(correct) > 0 AND choice THEN length(choice_text) > 96 WHEN len(boxes) > 0 THEN len(list_filter(box_texts, lambda b: length(b) > 30)) > 0 ELSE false END AS ans_cut FROM answers)"""


@register("answer_lines", f"WITH {CTE_ITEMS}, {ANSWER_SQL} SELECT doc_id, id, ans AS answer, ans_cut AS cut FROM lines0")
def answer_lines(spark, sf):
    items = dump_items(spark, sf, ["type", "options", "correct", "explanation", "boxes", "self_graded"])
    rows = items.select("doc_id", "id", d.answer_line(it.response_kind(), F.col("correct"), F.col("options"), F.col("boxes")).alias("a"))
    return rows.select("doc_id", "id", F.col("a.text").alias("answer"), "a.cut")


def why_sql(source: str, cols: str, text: str) -> str:
    return f"""wbody AS (SELECT {cols}, {flat_sql(f"array_to_string(list_filter(string_split({text}, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\\s*Box \\d+\\s*:')), ' ')")} AS body FROM {source}),
wsent AS (SELECT *, CASE WHEN regexp_matches(body, '^.*?[.?!](\\s|$)') THEN regexp_extract(body, '^(.*?[.?!])(\\s|$)', 1) ELSE body END AS sent FROM wbody),
whys AS (SELECT *, {clip_sql('sent', 88)} AS why, sent <> '' AND (length(sent) > 88 OR length(body) > length(sent) + 4) AS why_cut FROM wsent)"""


@register("reasons", f"WITH {why_sql('documents', 'doc_id', 'text')} SELECT doc_id, why, why_cut AS cut FROM whys")
def reasons(spark, sf):
    rows = dg.with_reason(ad.documents(spark, sf).select("doc_id", "text"), "text", "w")
    return rows.select("doc_id", F.col("w.text").alias("why"), "w.cut")


# Each document is one learner's list; the item number gives the times wrong and who wrote a correction.
def wrong_rows(spark, sf):
    n = F.col("id") % 7
    note = F.when(F.col("id") % 10 == 3, F.concat(F.lit("I think "), F.col("stem")))
    items = dump_items(spark, sf, ["type", "stem", "options", "correct", "explanation", "boxes", "self_graded", "currency"])
    return items.withColumns({"times_wrong": n, "correction": note}).filter(n > 0)


ENTRY_SQL = f"""{CTE_ITEMS}, {ANSWER_SQL}, {why_sql('lines0', 'doc_id, id, n, stem, self_graded, ans, ans_cut', 'explanation')},
flat AS (SELECT *, {flat_sql('stem')} AS cue0, {flat_sql("'I think ' || stem")} AS own0 FROM whys WHERE n % 7 > 0),
entries AS (SELECT *, '**q' || id || '** general ·' || CASE WHEN self_graded OR n % 13 = 0 THEN ' ' || CASE WHEN self_graded THEN '~' ELSE '' END || CASE WHEN n % 13 = 0 THEN '?' ELSE '' END ELSE '' END || ' ×' || (n % 7)
   || chr(10) || '- Cue: ' || {clip_sql('cue0', 76)} || chr(10) || '- Ans: ' || ans || chr(10) || '- Why: ' || why
   || CASE WHEN n % 10 = 3 THEN chr(10) || '- Yours: ' || {clip_sql('own0', 88)} ELSE '' END AS entry, length(cue0) > 76 OR ans_cut OR why_cut AS truncated FROM flat)"""


@register("revision_entries", f"WITH {ENTRY_SQL} SELECT doc_id, id, entry, truncated FROM entries")
def revision_entries(spark, sf):
    return dg.entries(wrong_rows(spark, sf)).select("doc_id", "id", "entry", "truncated")


@register("revision_sheets", f"""WITH {ENTRY_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n % 7 DESC, id) AS rn FROM entries),
g AS (SELECT doc_id, string_agg(entry, chr(10) || chr(10) ORDER BY rn) AS body, count(*) AS n_entries, count(*) FILTER (truncated) AS n_truncated, bool_or(self_graded OR n % 13 = 0) AS flagged FROM top WHERE rn <= 10 GROUP BY 1),
h AS (SELECT d.doc_id, coalesce(n_entries, 0) AS n_entries, coalesce(n_truncated, 0) AS n_truncated, concat_ws(chr(10), '# Wrong answers, 9 March 2024',
   coalesce(n_entries, 0) || CASE WHEN n_entries = 1 THEN ' question' ELSE ' questions' END || ' · all areas · wrong at least once',
   CASE WHEN flagged THEN '~ self-graded · ? currency unverified · ×n times wrong' END,
   CASE WHEN n_truncated > 0 THEN n_truncated || CASE WHEN n_truncated = 1 THEN ' entry is' ELSE ' entries are' END || ' cut, marked […]. Full text stays in the app.' END)
   || chr(10) || chr(10) || coalesce(body, 'Nothing to revise: no question in this filter has been answered wrongly.') || chr(10) AS markdown FROM documents d LEFT JOIN g USING (doc_id))
SELECT doc_id, markdown, n_entries, n_truncated, CAST(length(markdown) AS INTEGER) AS chars,
  CAST(list_sum(list_transform(string_split(markdown, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN 1 ELSE CAST(ceil(length(x) / 48) AS INTEGER) END)) AS INTEGER) AS lines FROM h""")
def revision_sheets(spark, sf):
    out = dg.sheets(wrong_rows(spark, sf), ["doc_id"], [F.desc("times_wrong"), F.col("id")], "2024-03-09", "Wrong answers", 10,
                    groups=ad.documents(spark, sf).select("doc_id"))
    return out.select("doc_id", "markdown", "n_entries", "n_truncated", "chars", "lines")


@register("text_density", """SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(l AS INTEGER) AS lines, round(l / 30, 6) AS sides, l / 30 <= 3 AS fits FROM (
  SELECT doc_id, text, list_sum(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN 1 ELSE ceil(length(x) / 48) END)) AS l FROM documents)""")
def text_density(spark, sf):
    rows = dg.with_density(ad.documents(spark, sf).select("doc_id", "text"), "text")
    return rows.select("doc_id", "chars", "lines", F.round("sides", 6).alias("sides"), "fits")
