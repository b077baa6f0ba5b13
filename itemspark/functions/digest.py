"""Condensing text columns: clips, cues, answer lines, reasons, density."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemspark.functions import constants as k
from itemspark.functions.identity import collapse


def clip(raw: Column, width: int) -> Column:
    """Cut at a word boundary; struct(text, cut)."""
    return clip_flat(collapse(raw), width)


def clip_flat(text: Column, width: int) -> Column:
    """:func:`clip` for text whose whitespace is already collapsed."""
    head = F.substring(text, 1, width)
    blank = F.length(head) - F.instr(F.reverse(head), " ")
    has_blank = F.instr(head, " ") > 0
    body = F.when(has_blank & (blank > F.lit(width * 0.6)), F.substr(head, F.lit(1), blank)).otherwise(head)
    short = F.concat(F.regexp_replace(body, r"(?U)[\s,;:.–-]+\z", ""), F.lit(f" {k.TRUNCATION_MARK}"))
    cut = F.length(text) > width
    return F.struct(F.when(cut, short).otherwise(text).alias("text"), F.coalesce(cut, F.lit(False)).alias("cut"))


def strip_boilerplate(text: Column) -> Column:
    for pattern in k.BOILERPLATE:
        text = F.regexp_replace(text, f"(?iud){pattern}", " ")
    return text


def cue_lines(plain: Column) -> Column:
    """Non-empty collapsed lines of a stem without boilerplate."""
    return F.filter(F.transform(F.split(plain, "\n"), collapse), lambda x: x != "")


def last_question(flat: Column) -> Column:
    asks = F.regexp_extract_all(flat, F.lit(r"(?<![^.?!])[^.?!]++\?"), F.lit(0))
    return F.when(F.size(asks) > 0, collapse(F.element_at(asks, -1)))


def goal_position(lines: Column) -> Column:
    """1-based place of the first line stating a goal; 0 when there is none."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: x.rlike(r"(?i)^you (need|must|are asked) to\b")), F.lit(True)), F.lit(0)).cast("int")


def choose_cue(lines: Column, ask: Column, goal_at: Column, subtopic: Column) -> Column:
    """Last question sentence if substantial, else the goal line, else the line before it, and so on."""
    goal = F.when(goal_at > 0, F.get(lines, goal_at - 1))
    before = F.when(goal_at > 1, F.get(lines, goal_at - 2))
    last = F.when(F.size(lines) > 0, F.element_at(lines, -1))
    return (
        F.when(F.length(ask) >= 28, ask).when(F.length(goal) >= 40, goal)
        .otherwise(F.coalesce(before, goal, ask, last, subtopic))
    )


def answer_line(kind: Column, correct: Column, options: Column, boxes: Column) -> Column:
    """The answer by response kind; struct(text, cut)."""
    def choice(key):
        hit = F.get(F.filter(options, lambda o: o["key"] == key), F.lit(0))
        return F.when(hit.isNotNull(), F.concat(key, F.lit(". "), hit["text"])).otherwise(
            F.concat(key, F.lit(" — no such option in the bank")))
    choices = clip(F.array_join(F.transform(correct, choice), " · "), k.ANSWER_MAX)
    flat = F.transform(F.array_sort(boxes), lambda b: F.struct(b["box"].alias("box"), collapse(b["answer"]).alias("t")))
    parts = F.transform(flat, lambda b: F.struct(b["box"].alias("box"), clip_flat(b["t"], k.BOX_MAX).alias("c")))
    boxed = F.struct(
        F.array_join(F.transform(parts, lambda p: F.concat(p["box"].cast("string"), F.lit(". "), p["c"]["text"])), " · ").alias("text"),
        F.exists(flat, lambda b: F.length(b["t"]) > k.BOX_MAX).alias("cut"))
    self_graded = F.struct(F.lit("in the image — you graded this one yourself").alias("text"), F.lit(False).alias("cut"))
    return F.when(kind == "choice", choices).when(kind == "boxes", boxed).otherwise(self_graded)


def reason_body(explanation: Column) -> Column:
    """The explanation without its numbered slot lines, collapsed."""
    return collapse(F.array_join(F.filter(F.split(explanation, "\n"), lambda x: ~x.rlike(r"(?iU)^\s*Box \d+\s*:")), "\n"))


def first_sentence(flat: Column) -> Column:
    return F.regexp_extract(flat, r"(?U)^(.*?[.?!](?=\s|$)|.*)", 1)


def density_lines(text: Column) -> Column:
    """Handwritten lines: a blank line is one, others wrap at the line width."""
    wrapped = F.transform(F.split(text, "\n"), lambda x: F.when(collapse(x) == "", F.lit(1)).otherwise(
        F.ceil(F.length(x) / F.lit(k.CHARS_PER_LINE)).cast("int")))
    return F.aggregate(wrapped, F.lit(0), lambda acc, x: acc + x)


def sides(lines: Column) -> Column:
    return lines / F.lit(k.LINES_PER_SIDE)


def describe_filter(area: Column, subtopic: Column, type_label: Column, wrong_twice: Column, graded_only: Column,
                    due_only: Column, limit: Column) -> Column:
    set_ = lambda c: F.when(F.length(c) > 0, c)
    return F.concat_ws(
        " · ", set_(area), set_(subtopic), set_(type_label),
        F.when(wrong_twice, "wrong at least twice"), F.when(graded_only, "machine-graded only"),
        F.when(F.coalesce(due_only, F.lit(True)), "due only").otherwise("whole pool"),
        F.when(limit > 0, F.concat(F.lit("capped at "), limit.cast("string"))))
