"""Raw text to item rows. Segmentation and field extraction are narrow: no shuffle moves text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.functions import text as t
from itemspark.operators.scans import by_position, fill_forward, running_totals, salted_lookup
from itemspark.operators.stages import stage


OFFSETS = "struct<at:array<bigint>,n:bigint>"


def starts_of(lengths: Column, gap: int = 0, block: int = 1000) -> Column:
    """Start offset of each piece from an array of piece lengths, ``gap`` apart.

    Offsets are summed in blocks and the blocks then shifted: appending to one long array element by
    element would copy it each time, which a document of a million pieces could not afford.
    """
    start = F.struct(F.array().cast("array<bigint>").alias("at"), F.lit(0).cast("bigint").alias("n"))

    def add(acc, n):
        return F.struct(F.concat(acc["at"], F.array(acc["n"])).alias("at"), (acc["n"] + n + F.lit(gap)).alias("n")).cast(OFFSETS)

    def shift(acc, part):
        moved = F.transform(part["at"], lambda x: x + acc["n"])
        return F.struct(F.concat(acc["at"], moved).alias("at"), (acc["n"] + part["n"]).alias("n")).cast(OFFSETS)

    last = F.greatest(F.ceil(F.size(lengths) / F.lit(block)) - 1, F.lit(0)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * block + 1, block))
    parts = F.transform(blocks, lambda x: F.aggregate(x, start, add))
    return F.aggregate(parts, start, shift, lambda acc: acc["at"])


def segments(docs: DataFrame, doc: str = "doc_id", text: str = "text", marker: str = k.MARKER,
             keep: list[str] | None = None, offsets: bool = True) -> DataFrame:
    """Cut each document at every marker: (doc, id, body, start, end), first block of an id wins.

    Without ``offsets`` start and end are left out, and so is what they cost.

    A repeated marker still ends the block before it. Text ahead of the first marker belongs to nobody.
    Everything happens inside the document's row, so a document is the unit of parallelism; the work
    grows with its length times a logarithm.
    """
    cols = [doc, *(keep or [])]
    pieces = F.split(F.regexp_replace(F.col(text), f"(?md){marker}", f"{t.CUT}$0"), t.CUT)
    number = rf"\A{marker.lstrip('^')}"
    if not offsets:
        cut = F.transform(pieces, lambda p, i: F.struct(F.regexp_extract(p, number, 1).try_cast("bigint").alias("id"), i.alias("nth"), p.alias("body")))
        return _first_blocks(stage(docs, {"_b": F.sort_array(F.filter(cut, lambda b: b["id"].isNotNull() & (b["nth"] > 0)))}, keep=cols), cols)
    rows = stage(docs, {"_p": pieces}, keep=cols)
    rows = stage(rows, {"_len": F.transform("_p", F.length), "_id": F.transform("_p", lambda p: F.regexp_extract(p, number, 1).try_cast("bigint"))})
    rows = stage(rows, {"_at": starts_of(F.col("_len"))})
    blocks = F.transform(F.arrays_zip("_id", "_at", "_len", "_p"), lambda x, i: F.struct(
        x["_id"].alias("id"), i.alias("nth"), x["_p"].alias("body"), x["_at"].alias("start"), (x["_at"] + x["_len"]).alias("end")))
    return _first_blocks(stage(rows, {"_b": F.sort_array(F.filter(blocks, lambda b: b["id"].isNotNull() & (b["nth"] > 0)))}, keep=cols), cols)


def _first_blocks(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Of blocks sorted by (id, nth), the first of an id is the one whose neighbour before has another id."""
    firsts = F.filter("_b", lambda b, i: (i == 0) | (F.get("_b", i - 1)["id"] != b["id"]))
    return rows.select(*cols, F.inline(firsts)).drop("nth")


def page_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text", mark: str = "\f") -> DataFrame:
    """Half-open offsets of each page: (doc, lo, hi, page)."""
    rows = stage(docs, {"_len": F.transform(F.split(text, mark), F.length)}, keep=[doc])
    rows = stage(rows, {"_lo": starts_of(F.col("_len"), gap=len(mark))})
    zipped = F.transform(F.arrays_zip("_lo", "_len"), lambda x, i: F.struct(
        x["_lo"].alias("lo"), (x["_lo"] + x["_len"]).alias("hi"), (i + 1).alias("page")))
    return rows.select(doc, F.inline(zipped))


def overlap_join(segs: DataFrame, spans: DataFrame, doc: str = "doc_id", width: int = 4096) -> DataFrame:
    """Segments (start, end) with the spans (lo, hi) they overlap: ``lo < end AND hi >= start``.

    Both sides are cut into buckets of ``width`` offsets and equi-joined on (doc, bucket); a pair is kept
    only in the first bucket the two share, so nothing has to be deduplicated afterwards.
    """
    first = lambda c: F.floor(F.col(c) / F.lit(width))
    a = segs.withColumn("_a0", first("start")).withColumn("_b", F.explode(F.sequence(first("start"), first("end"))))
    b = spans.withColumn("_b0", first("lo")).withColumn("_b", F.explode(F.sequence(first("lo"), first("hi"))))
    pairs = a.join(b, [doc, "_b"])
    touches = (F.col("lo") < F.col("end")) & (F.col("hi") >= F.col("start"))
    return pairs.filter(touches & (F.col("_b") == F.greatest("_a0", "_b0"))).drop("_a0", "_b0", "_b")


FIELDS = ("type", "stem", "options", "correct", "explanation", "refs", "boxes", "background", "parse_confidence", "parse_notes")


def extract_fields(blocks: DataFrame, source: str = "a", id_col: str = "id", watermark: str | None = None, fields: Sequence[str] = FIELDS,
                   spread: Sequence[str] | None = None) -> DataFrame:
    """The wanted fields of one block per row; ``source`` b uses the second source's shorter note list.

    A chain of narrow stages: each reads only columns of those before, and each text is scanned once. Only the
    steps that a wanted field rests on are built, since a stage's columns cannot be pruned afterwards.

    With ``spread`` the rows are dealt by these columns as soon as all is made that does not depend on the source.
    Parses of the same blocks are equal up to there, so that Spark runs that part once for both, and a join of them
    on these columns moves no row again.
    """
    c = F.col
    no_boxes = F.array().cast(t.BOXES_TYPE)
    bounds = lambda: [c("_e_end"), c("_r_start"), c("_r_end")]
    stem = lambda: t.background_and_stem(c("_region"), c("_paragraphs"))["stem"]
    low = lambda: low_confidence() if source == "a" else F.size("parse_notes") > 0
    # Parses that are spread carry the same columns to where they part.
    noted = source == "a" or bool(spread)
    notes = ["stem", "type", "options", "correct", *(["boxes", "currency_note"] if noted else [])]
    # name: (columns it is made of, its expression)
    steps = {
        "_block": (["body"], lambda: t.normalise_block(c("body"), watermark)),
        "_head": (["_block"], lambda: F.get(t.around_match(c("_block"), k.ANSWER_LINE), F.lit(0))),
        "_declared": (["_block"], lambda: t.declared_type(c("_block"))),
        "currency_note": (["_block"], lambda: t.legacy_notes(c("_block"))),
        "_tail": (["_block", "_head"], lambda: F.substr(c("_block"), F.length("_head") + 1)),
        # An answer key stands on an answer line, and the tail begins at the first of these.
        "correct": (["_tail"], lambda: t.answer_key(c("_tail"))),
        "_pieces": (["_head"], lambda: t.option_pieces(t.strip_markers(c("_head")))),
        "_e": (["_tail"], lambda: t.around_match(c("_tail"), k.EXPLANATION)),
        "_r": (["_tail"], lambda: t.around_match(c("_tail"), k.REFERENCE)),
        "_region": (["_pieces"], lambda: t.clean_block(F.get("_pieces", F.lit(0)))),
        "options": (["_pieces"], lambda: t.options_of(c("_pieces"))),
        "_e_end": (["_tail", "_e"], lambda: t.match_end(c("_tail"), c("_e"))),
        "_r_start": (["_r"], lambda: F.length(F.get("_r", F.lit(0)))),
        "_r_end": (["_tail", "_r"], lambda: t.match_end(c("_tail"), c("_r"))),
        "_expl": (["_tail", "_e_end", "_r_start", "_r_end"], lambda: t.sections(c("_tail"), *bounds())["_expl"]),
        "_refs": (["_tail", "_e_end", "_r_start", "_r_end"], lambda: t.sections(c("_tail"), *bounds())["_refs"]),
        "_paragraphs": (["_region"], lambda: t.background_paragraphs(c("_region"))),
        "explanation": (["_expl"], lambda: t.clean_block(c("_expl"))),
        "_own": (["_refs"], lambda: t.harvest_urls(c("_refs"))),
        "background": (["_region", "_paragraphs"], lambda: t.background_and_stem(c("_region"), c("_paragraphs"))["background"]),
        "_asked": (["_region", "_paragraphs"], stem),
        "stem": (["_asked"], lambda: t.strip_leading_punctuation(c("_asked")) if source == "a" else c("_asked")),
        "_slots": (["_declared", "explanation"], lambda: F.when(c("_declared").isNotNull(), t.slot_statements(c("explanation")))),
        "refs": (["_own", "_expl"], lambda: F.when(F.size("_own") > 0, c("_own")).otherwise(t.harvest_urls(c("_expl")))),
        "type": (["_declared", "correct"], lambda: t.infer_type(c("_declared"), c("correct"))),
        "boxes": (["_slots"], lambda: F.coalesce(t.numbered_slots(c("_slots")), no_boxes)),
        "parse_notes": (notes, lambda: first_source_notes() if source == "a" else second_source_notes()),
        "parse_confidence": (["parse_notes", *(["currency_note"] if noted else [])], lambda: F.when(low(), "low").otherwise("high")),
    }
    lead = [x for x in blocks.columns if x not in ("body", id_col)] + [id_col]
    left, todo = set(), list(fields)
    while todo:
        name = todo.pop()
        if name in steps and name not in left:
            left.add(name)
            todo += steps[name][0]
    rows, made = blocks, {"body"}
    own = {"stem", "parse_notes", "parse_confidence"}
    while left:
        if spread and left <= own:
            rows, spread = rows.repartition(*spread), None
            rows = stage(rows, {n: c(n) for n in rows.columns if n not in lead})
        ready = [n for n in steps if n in left and made.issuperset(steps[n][0]) and not (spread and n in own)]
        left -= set(ready)
        read = {x for n in left for x in steps[n][0]}
        rows = stage(rows, {n: steps[n][1]() for n in ready}, keep=[*lead, *[x for x in rows.columns if x not in lead and (x in read or x in fields)]])
        made |= set(ready)
    return (rows.repartition(*spread) if spread else rows).select(*lead, *fields)


def first_source_notes() -> Column:
    choice, visual = F.col("type").isin(*k.CHOICE_TYPES), F.col("type").isin(*k.VISUAL_TYPES)
    orphans = t.orphaned_letters(F.col("correct"), F.col("options"))
    return t.notes_of(
        (F.col("stem") == "", F.lit("empty stem after cleaning")),
        (choice & (F.size("options") == 0), F.lit("mcq with no text options; answer area is probably an image")),
        (choice & (F.size("correct") == 0), F.lit("no answer key in PDF text; candidate for DOCX merge")),
        (choice & (F.size("options") > 0) & (F.size(orphans) > 0),
         F.concat(F.lit("answer key "), t.key_list(orphans), F.lit(" has no matching option"))),
        (visual & (F.size("boxes") == 0), F.lit("no Box N: structure; will need self-grading against the image")),
        (F.col("currency_note").isNotNull(), F.col("currency_note")))


def second_source_notes() -> Column:
    return t.notes_of(
        (F.col("stem") == "", F.lit("empty stem from DOCX text")),
        (F.col("type").isin(*k.CHOICE_TYPES) & (F.size("options") == 0), F.lit("mcq with no text options in DOCX")),
        (F.size("correct") == 0, F.lit("no answer key in DOCX text")))


def low_confidence() -> Column:
    """Any note lowers confidence, except a legacy-term note standing alone."""
    only_currency = F.col("currency_note").isNotNull() & (F.col("parse_notes") == F.array("currency_note"))
    return (F.size("parse_notes") > 0) & ~F.coalesce(only_currency, F.lit(False))


def paragraphs_of_runs(runs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Text of each paragraph, and the marker it names even when that is split over runs.

    The marker is looked for once, in the joined runs; its number is as much of the digits as is readable at the
    end of the first run that holds one of them. The runs of one paragraph are all that is grouped.
    """
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "TXT", F.struct("run", "payload")))), lambda r: r["payload"])

    rows = runs.groupBy(doc, "para").agg(texts.alias("_runs")).withColumn("line", F.array_join("_runs", ""))
    rows = stage(rows, {"_match": F.regexp_extract("line", k.MARKER_INLINE, 0), "_digits": F.regexp_extract("line", k.MARKER_INLINE, 1)})
    first = F.instr("line", F.col("_match")) + F.length("_match") - F.length("_digits")

    def add(acc, payload):
        n = acc["n"] + F.length(payload)
        return F.struct(n.alias("n"), F.when(acc["end"] > 0, acc["end"]).when(n >= F.col("_first"), n).otherwise(0).alias("end"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    rows = rows.withColumn("_first", first).withColumn("_end", F.aggregate("_runs", start, add)["end"])
    number = F.substr("_digits", F.lit(1), F.col("_end") - F.col("_first") + 1)
    return rows.select(doc, "para", "line", F.when(F.col("_match") != "", number.try_cast("bigint")).alias("marker"))


def own_by_marker(paragraphs: DataFrame, marker: str = "marker", doc: str = "doc_id", order: str = "para",
                  width: int = 1000, name: str = "owner") -> DataFrame:
    """Give each row the last marker at or above it; rows above any marker are dropped."""
    rows = fill_forward(paragraphs, [doc], [order], by_position(order, width), F.col(marker), name)
    return rows.filter(F.col(name).isNotNull())


def block_lines(lines: DataFrame, owner: list[str], order: str, line: str = "line", width: int = 1000) -> DataFrame:
    """Owned lines that are not blank, numbered within their block: (owner, nth, line), one row per line.

    A block is never gathered, so its length has no bound; a reader that wants a text sorts by ``nth``.
    """
    kept = lines.filter(~F.col(line).rlike(r"(?U)\A\s*\z"))
    numbered = running_totals(kept, owner, [order], by_position(order, width), {"nth": F.lit(1)})
    return numbered.select(*owner, "nth", F.col(line).alias("line"))


# ── Media ────────────────────────────────────────────────────────────────────


def png_size(content: Column) -> Column:
    """struct(width, height) from a PNG header; null for anything else."""
    word = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("bigint")
    is_png = (F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A") & (F.octet_length(content) >= 24)
    return F.when(is_png, F.struct(word(17).alias("width"), word(21).alias("height")))


def is_blank_frame(content: Column, floor: float = k.MAX_BLANK_BYTES_PER_PIXEL) -> Column:
    size = png_size(content)
    area = size["width"] * size["height"]
    return F.coalesce((area > 0) & (F.octet_length(content) / area < floor), F.lit(False))


def media_manifest(refs: DataFrame, media: DataFrame, min_bytes: int = k.MIN_IMAGE_BYTES) -> DataFrame:
    """Resolve references (owner, pos, path) to media (path, content), one row per reference.

    Outcomes: missing, too_small, blank, kept (first reference of a digest) or deduped (any later one).
    A kept file is named after its first owner and its place among that owner's newly kept files.
    Media are reduced to digest and verdict before the join, so no bytes are shuffled.
    """
    facts = media.select(
        "path", F.sha2("content", 256).alias("digest"),
        F.when(F.octet_length("content") < min_bytes, "too_small").when(is_blank_frame(F.col("content")), "blank").alias("_bad"))
    rows = refs.join(facts, "path", "left")
    rows = rows.withColumn("_bad", F.when(F.col("digest").isNull(), "missing").otherwise(F.col("_bad")))
    good = F.col("_bad").isNull()
    first = rows.filter(good).groupBy("digest").agg(F.min(F.struct("owner", "pos", "path")).alias("first"))
    rows = salted_lookup(rows.filter(good), first, ["digest"]).unionByName(rows.filter(~good), allowMissingColumns=True)
    is_first = F.coalesce((F.col("first.owner") == F.col("owner")) & (F.col("first.pos") == F.col("pos")), F.lit(False))
    return rows.select("owner", "pos", "path", "digest", F.coalesce("_bad", F.when(is_first, "kept").otherwise("deduped")).alias("outcome"),
                       F.col("first.owner").alias("first_owner"), F.col("first.pos").alias("first_pos"))


def owner_media(manifest: DataFrame, width: int = 1000) -> DataFrame:
    """Distinct media per owner in reference order, under the shared name of their first reference."""
    usable = manifest.filter(F.col("outcome").isin("kept", "deduped"))
    per_owner = usable.groupBy("owner", "digest").agg(F.min("pos").alias("pos"), F.min("first_owner").alias("first_owner"),
                                                       F.min("first_pos").alias("first_pos"))
    # The place of a file in its first owner's list counts everything that owner lists up to it.
    placed = running_totals(per_owner, ["owner"], ["pos"], by_position("pos", width), {"place": F.lit(1)})
    named = placed.filter((F.col("owner") == F.col("first_owner")) & (F.col("pos") == F.col("first_pos")))
    suffix = manifest.filter(F.col("outcome") == "kept").select("digest", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("_ext"))
    names = named.join(suffix, "digest").select("digest", F.concat(
        F.lit("q"), F.col("owner").cast("string"), F.lit("-"), F.col("place").cast("string"),
        F.when(F.col("_ext") == "", ".png").otherwise(F.col("_ext"))).alias("name"))
    return salted_lookup(placed.select("owner", "pos", "place", "digest"), names, ["digest"])


def media_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
