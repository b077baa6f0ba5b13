"""A BPE vocabulary with byte fallback, read from a model file, and the pre-tokens its merges cannot leave."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np

BLANK = "▁"
BIG = np.int32(2**31 - 1)
SEGMENT = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


@dataclass(frozen=True)
class Vocabulary:
    """``names`` by id; ``order`` gives a mergeable piece's place in the merge order (lower goes first)."""

    names: list[str]
    order: dict[str, int]
    by_order: np.ndarray
    byte_ids: np.ndarray


@cache
def load(path: str) -> Vocabulary:
    """Reads the pieces and scores of a BPE model whose pieces start, but never go on, with a blank.

    The pre-tokens below rest on that and on line ends being no part of a piece; another model is refused.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [i for i in range(len(names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    for i in plain:
        if "\n" in names[i] or BLANK in names[i].lstrip(BLANK):
            raise ValueError(f"piece {names[i]!r} crosses pre-tokens")
    plain.sort(key=lambda i: (-model.get_score(i), i))
    if model.encode(" a  b ", out_type=str) != model.encode(" a", out_type=str) + [BLANK, BLANK + "b", BLANK]:
        raise ValueError("the model's normaliser changes blanks")
    return Vocabulary(names, {names[i]: k for k, i in enumerate(plain)}, np.array(plain, np.int32),
                      np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32))


def segments(text: str) -> list[str]:
    """The pre-tokens of a text: runs of blanks with what follows them, line ends on their own.

    No piece crosses them, so that each can be encoded by itself. Common texts, with single blanks between
    words, are split without a pattern.
    """
    if not text:
        return []
    if "  " in text or "\n " in text or " \n" in text or BLANK in text or text[0] in " \n" or text[-1] == " ":
        return SEGMENT.findall(BLANK + text.replace(" ", BLANK))
    if "\n" not in text:
        return (BLANK + text.replace(" ", f" {BLANK}")).split(" ")
    return [x for x in (BLANK + text.replace(" ", f" {BLANK}").replace("\n", " \n ")).split(" ") if x]
