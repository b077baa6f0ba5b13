"""Text to fields: every step is one column expression over a block of raw text.

Patterns follow `re.MULTILINE` semantics, so the Java flags are always ``(?md)``: ``d`` keeps ``^``, ``$``
and ``.`` from treating anything but a newline as the end of a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemspark.functions import constants as k

# Separators put into text before splitting; both are Unicode noncharacters, which text never carries.
CUT, TAG = "﷐", "﷑"

OPTIONS_TYPE = "array<struct<key:string,text:string>>"
BOXES_TYPE = "array<struct<box:int,answer:string>>"


# Unicode whitespace as `str.strip` knows it.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Whitespace off both ends; looks at the ends only."""
    return F.btrim(text, F.lit(WHITESPACE))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is evaluated a single time; written out, it is evaluated at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _if_any(text: Column, needles: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """Run a rewrite only on text holding one of the needles; a substring test is far cheaper than a regex."""
    def rewritten(t: Column) -> Column:
        hit = t.contains(needles[0])
        for n in needles[1:]:
            hit = hit | t.contains(n)
        return F.when(hit, change(t)).otherwise(t)
    return once(text, rewritten)


def normalise_block(text: Column, watermark: str | None = None) -> Column:
    """Watermark out, page breaks to newlines, trailing blanks off. Runs before any sectioning."""
    if watermark:
        text = F.regexp_replace(text, watermark, " ")
    # Split and joined, since replace compares at every byte.
    text = _if_any(text, ("\f",), lambda x: F.array_join(F.split(x, "\f"), "\n"))
    return _if_any(text, (" \n", "\t\n"), lambda x: F.regexp_replace(x, r"[ \t]+\n", "\n"))


def clean_block(text: Column, watermark: str | None = None) -> Column:
    text = normalise_block(text, watermark)
    text = _if_any(text, ("-",), lambda x: F.regexp_replace(x, r"(?md)^[ \t]*-[ \t]*$\n?", ""))
    return strip(_if_any(text, ("\n\n\n",), lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n")))


def strip_markers(text: Column) -> Column:
    """Drop item markers, answer tokens and type markers wherever they stand."""
    text = _if_any(F.regexp_replace(text, k.MARKER_INLINE, ""), ("Answer:",), lambda x: F.regexp_replace(x, "Answer:", ""))
    return _if_any(text, k.DECLARED_WORDS, lambda x: F.regexp_replace(x, f"(?md){k.TYPE_MARKER}", ""))


def strip_leading_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A[\s\-–—:]+", "")


def stitch_wrapped_urls(text: Column, glue_adjacent: bool = True) -> Column:
    """Append spaceless lines to a preceding line that ends in a URL; every line loses its outer blanks.

    One pass: the line end goes where a URL, or a line just appended to one, stands before it and a spaceless
    line after it. Without ``glue_adjacent`` a line that itself starts a URL begins a new entry.
    """
    lines = F.array_join(F.transform(F.split(text, "\n"), strip), "\n")
    own = "" if glue_adjacent else "(?!https?://)"
    return F.regexp_replace(lines, rf"(https?://\S+|\G(?!\A)\S+)\n(?={own}[^ \n]+(?:\n|\z))", "$1")


def around_match(text: Column, pattern: str) -> Column:
    """Text before and after the first match; one piece when there is none."""
    return F.split(text, f"(?md){pattern}", 2)


def match_end(text: Column, pieces: Column) -> Column:
    """Offset behind the match of :func:`around_match`, 0 without one."""
    return F.when(F.size(pieces) > 1, F.length(text) - F.length(F.get(pieces, F.lit(1)))).otherwise(0)


def sections(tail: Column, e_end: Column, r_start: Column, r_end: Column) -> dict[str, Column]:
    """Explanation and references; a reference heading ahead of the explanation does not cut it, and
    without any heading the whole tail counts as references."""
    stop = F.when((r_end > 0) & (r_start > e_end), r_start).otherwise(F.length(tail))
    return {
        "_expl": F.when(e_end > 0, F.substr(tail, e_end + 1, stop - e_end)).otherwise(F.lit("")),
        "_refs": F.when(r_end > 0, F.substr(tail, r_end + 1)).when(e_end > 0, F.lit("")).otherwise(tail),
    }


def option_pieces(head: Column) -> Column:
    """The head cut at its labelled list items; the first piece is the stem."""
    return F.split(F.regexp_replace(head, f"(?md){k.OPTION}", f"{CUT}$1{TAG}$2"), CUT)


def options_of(pieces: Column) -> Column:
    """A body runs to the next label, even a repeated one; the first item of a label is kept.

    Only kept bodies are cleaned, each once: a lambda evaluates anew what it refers to outside.
    """
    found = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), lambda p: F.struct(
        F.substring_index(p, TAG, 1).alias("key"), F.substring_index(p, TAG, -1).alias("text")))
    return F.transform(first_by(found, "key"), lambda o: F.struct(o["key"].alias("key"), clean_block(o["text"]).alias("text"))).cast(OPTIONS_TYPE)


def first_by(items: Column, field: str) -> Column:
    """Keep the first struct of each value of ``field``."""
    names = F.transform(items, lambda x: x[field])
    return F.filter(items, lambda x, i: F.array_position(names, x[field]) == i + 1)


def answer_letters(raw: Column) -> Column:
    """Sorted distinct letters A-H."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(raw, F.lit("[A-H]"), F.lit(0))))


def answer_key(block: Column) -> Column:
    return answer_letters(F.regexp_extract(block, f"(?md){k.ANSWER_KEY}", 1))


def slot_statements(explanation: Column) -> Column:
    """Every non-empty numbered statement, in text order."""
    none = F.array().cast("array<struct<box:int,answer:string>>")
    return once(explanation, lambda x: F.when(x.contains("Box"), _statements(x)).when(x.isNotNull(), none))


def _statements(explanation: Column) -> Column:
    pattern = F.lit(f"(?md){k.BOX}")
    numbers, texts = F.regexp_extract_all(explanation, pattern, F.lit(1)), F.regexp_extract_all(explanation, pattern, F.lit(2))
    pairs = F.transform(F.arrays_zip(numbers.alias("n"), texts.alias("t")), lambda p: F.struct(
        p["n"].try_cast("int").alias("box"),
        F.regexp_replace(F.substring_index(clean_block(p["t"]), "\n", 1), r"\A[ -]+|[ -]+\z", "").alias("answer")))
    return F.filter(pairs, lambda p: p["answer"] != "")


def numbered_slots(statements: Column) -> Column:
    """First statement of each numbered slot, ordered by slot."""
    return F.array_sort(first_by(statements, "box")).cast(BOXES_TYPE)


def background_paragraphs(region: Column) -> Column:
    """Paragraphs of a shared-background block without its boilerplate; null for any other block."""
    body = F.regexp_replace(region, f"(?sd){k.BACKGROUND_BOILERPLATE}", "")
    body = strip(F.regexp_replace(body, f"(?md){k.BACKGROUND_HEADING}", ""))
    parts = F.filter(F.transform(F.split(body, r"\n\s*\n"), strip), lambda p: p != "")
    return F.when(region.rlike(k.SHARED_BACKGROUND), parts)


def background_and_stem(region: Column, paragraphs: Column) -> dict[str, Column]:
    """The last paragraph asks, everything above is shared; a lone paragraph is both."""
    alone = F.size(paragraphs) < 2
    upper = F.array_join(F.slice(paragraphs, 1, F.greatest(F.size(paragraphs) - 1, F.lit(1))), "\n\n")
    return {
        "background": F.when(paragraphs.isNotNull(), F.when(alone, F.get(paragraphs, F.lit(0))).otherwise(upper)),
        "stem": F.when(paragraphs.isNull(), region).when(alone, strip(region)).otherwise(F.element_at(paragraphs, -1)),
    }


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(k.URL), F.lit(0)))


def harvest_urls(text: Column) -> Column:
    """Distinct URLs in order, links broken over lines rejoined. Only text with a link at the end of a
    line is stitched."""
    wrapped = text.rlike(r"https?://\S+[ \t\f]*\n")
    return F.when(wrapped, urls(stitch_wrapped_urls(clean_block(text)))).otherwise(urls(text))


def declared_type(block: Column) -> Column:
    word = _if_any(block, k.DECLARED_WORDS, lambda x: F.regexp_extract(x, f"(?md){k.TYPE_MARKER}", 1))
    return once(word, lambda w: F.when(w == "HOTSPOT", "hotspot").when(w == "DRAG DROP", "dragdrop"))


def infer_type(declared: Column, correct: Column) -> Column:
    return F.coalesce(declared, F.when(F.size(correct) > 1, "mcq-multi").otherwise("mcq-single"))


def _mentions(text: Column, pattern: str) -> Column:
    """Regex test, preceded (or replaced) by a substring test where the pattern is a literal.

    A literal that begins in lower case is left to the regex, which skips ahead; the substring test would stop at every such letter.
    """
    literal = pattern.replace(r"\b", "").replace(r"\.", ".")
    if any(ch in literal for ch in "\\[](){}*+?|^$") or "." in pattern.replace(r"\.", "") or literal[:1].islower():
        return text.rlike(f"(?U){pattern}")
    return text.contains(literal) & text.rlike(f"(?U){pattern}") if r"\b" in pattern else text.contains(literal)


def legacy_notes(text: Column, terms=k.LEGACY_TERMS) -> Column:
    """Distinct notes, in rule order, of the legacy terms the text uses (case-sensitive); null if none."""
    hits = once(text, lambda x: F.array(*[F.when(_mentions(x, p), F.lit(note)) for p, note in terms]))
    return once(F.array_join(F.array_distinct(F.filter(hits, lambda x: x.isNotNull())), " "), lambda notes: F.when(notes != "", notes))


def host_of(url: Column) -> Column:
    """Host of a URL without a leading www.; the input when it cannot be parsed."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), url)


def code_language(code: Column) -> Column:
    text = strip(code)
    return F.when(text.startswith("<") & text.rlike(k.XML_HINT), "xml").when(text.rlike(k.CSHARP_HINT), "csharp").otherwise("javascript")


def key_list(letters: Column) -> Column:
    """A letter list the way notes quote it: ['A', 'D']."""
    return F.concat(F.lit("["), F.array_join(F.transform(letters, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def orphaned_letters(correct: Column, options: Column) -> Column:
    return F.array_sort(F.array_except(correct, F.transform(options, lambda o: o["key"])))


def notes_of(*pairs: tuple[Column, Column]) -> Column:
    """Reasons whose condition holds, in order."""
    return F.filter(F.array(*[F.when(cond, note) for cond, note in pairs]), lambda x: x.isNotNull())
