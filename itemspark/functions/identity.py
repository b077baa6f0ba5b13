"""Content identity: what makes two items the same, independent of id and position."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Whitespace runs (Unicode) to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def content_hash(item_type: Column, stem: Column, options: Column | None = None,
                 boxes: Column | None = None, media: Column | None = None) -> Column:
    """First 16 hex digits of sha256 over type, stem, options, boxes and media digests.

    The answer key, explanation, references and flags stay out: correcting them keeps the identity.
    """
    parts = [F.coalesce(item_type, F.lit("")), F.coalesce(stem, F.lit(""))]
    if options is not None:
        parts.append(F.transform(options, lambda o: F.concat(o["key"], F.lit(":"), o["text"])))
    if boxes is not None:
        parts.append(F.transform(boxes, lambda b: F.concat(b["box"].cast("string"), F.lit(":"), b["answer"])))
    if media is not None:
        parts.append(media)
    return F.substring(F.sha2(F.lower(collapse(F.concat_ws("\x01", *parts))), 256), 1, 16)


def background_key(background: Column, chars: int = 200) -> Column:
    """Group key of a shared background: sha256 of its first normalised characters."""
    return F.substring(F.sha2(F.substring(F.lower(collapse(background)), 1, chars), 256), 1, 12)


def image_digest(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 12)
