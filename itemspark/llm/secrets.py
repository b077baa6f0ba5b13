"""Secret scans through a trigram inverted index.

Each rule's pattern is parsed into a Boolean query over trigrams it cannot match without: literal runs,
alternatives and small optional parts are multiplied out, and whatever is unbounded ends a run. Every batch of
documents is indexed once, for the trigrams that some rule asks for; a rule's postings are intersected and
united, and its pattern verifies the candidates. A rule without a mandatory trigram scans every document. The
index is in lower case, so it can only let too many documents through.

Null texts count as empty and have no spans; repeated rows are scanned each; columns other than the id and the
text are not looked at by ``scan`` and are kept by ``redacted``; an empty table gives an empty result. Texts
are scanned whole. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.llm.common import pieces, ship

#: Strings a run may be multiplied out to.
WIDEST = 48
SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` of a match must have; shorter matches are dropped. ``told``: the group that is the span."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0
    base: bool = False
    told: int = 0


# A key goes on to its END line, over anything but another BEGIN or END; where that line is missing, over its
# headers, its lines of base64, a shorter last one and a checksum. Line ends may be written as backslash n. Every part is possessive and
# stops at the next BEGIN, so that a text is read once.
_GAP = r"(?:\s|\\[nr])"
_KEY = (r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----"
        r"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----"
        rf"|(?:{_GAP}*+[A-Za-z][A-Za-z-]*+:\x20(?:[^\r\n\\-]|-(?!----))*+)*+(?:{_GAP}*+[A-Za-z0-9+/=]{{20,}}+)++(?:{_GAP}++[A-Za-z0-9+/=]++(?=[\s\\\"']|\Z)(?!\x20*[^\s\\\"']))?+(?:{_GAP}++=[A-Za-z0-9+/]{{4}}(?![A-Za-z0-9+/=]))?+)?+")
# Of a run of its characters, only the first eyJ can begin a token that a later one does not, so a run is read once.
_SIGNED = r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)"


# The base rules, in listed order, then rules for tokens of well-known public formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", False, 0, 16, True),  # a run of 16 and more is the longest run there
    Rule("private_key", _KEY),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("signed_token", _SIGNED, told=1),
)

#: A query: all of its clauses; a clause: one of its alternatives; an alternative: all of its trigrams.
Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """What every match of the pattern must contain; empty if nothing is mandatory."""
    query: Query = []

    def close(run: set[str]) -> None:
        found = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in found:
            query.append([x for x in found if not any(y < x for y in found)])

    def strings(items) -> set[str] | None:
        """All strings the items match, if they are few."""
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                part = {chr(arg).lower()}
            elif op is sre.IN and arg[0][0] is not sre.NEGATE and all(x is sre.LITERAL for x, _ in arg):
                part = {chr(x).lower() for _, x in arg}
            elif op is sre.SUBPATTERN:
                part = strings(arg[3])
            elif op is sre.BRANCH:
                parts = [strings(x) for x in arg[1]]
                part = None if None in parts else set().union(*parts)
            elif op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
                once = strings(arg[2])
                part = None
                if once is not None and len(once) ** arg[1] <= WIDEST:
                    part, power = set(), {""}
                    for k in range(arg[1] + 1):
                        part |= power if k >= arg[0] else set()
                        power = {x + y for x in power for y in once}
            else:
                part = None
            if part is None or len(part) * len(out) > WIDEST:
                return None
            out = {x + y for x in out for y in part}
        return out

    def walk(items) -> None:
        run = {""}
        for item in items:
            part = strings([item])
            if part is not None and len(part) * len(run) <= WIDEST:
                run = {x + y for x in run for y in part}
                continue
            close(run)
            run = part if part is not None else {""}
            op, arg = item
            if part is None and op is sre.SUBPATTERN:
                walk(arg[3])
            elif part is None and op is sre.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        close(run)

    walk(parser.parse(pattern))
    return query


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)), trigram_query(r.pattern)) for r in rules]
        wanted = sorted({t for _, _, q in self.rules for clause in q for way in clause for t in way if t.isascii()})
        self.number = {t: k + 1 for k, t in enumerate(wanted)}
        self.table = np.zeros(1 << 24, np.uint8 if len(wanted) < 256 else np.uint16)
        for t, k in self.number.items():
            a, b, c = t.encode()
            self.table[a << 16 | b << 8 | c] = k

    def postings(self, texts: list[str]) -> dict[int, np.ndarray]:
        """The documents of each wanted trigram, in order."""
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        data = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8)
        ends = np.cumsum([len(x) + 2 for x in raw])
        code = data[:-2].astype(np.int32) << 16
        code |= data[1:-1].astype(np.int32) << 8
        code |= data[2:]
        found = self.table[code]
        at = np.flatnonzero(found)
        pairs = np.unique(found[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
        cut = np.flatnonzero(np.r_[True, np.diff(pairs >> 32) != 0, True])
        return {int(pairs[a] >> 32): pairs[a:b] & 0xFFFFFFFF for a, b in zip(cut[:-1], cut[1:], strict=True)} if len(pairs) else {}

    def candidates(self, query: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        none = np.zeros(0, np.int64)
        left = np.arange(n)
        for clause in query:
            ways = []
            for way in clause:
                docs = left
                for t in sorted(way):
                    docs = np.intersect1d(docs, postings.get(self.number[t], none), assume_unique=True) if t.isascii() else docs
                ways.append(docs)
            left = np.unique(np.concatenate(ways))
        return left

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text (start, place of the rule, end), sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.postings(texts)
        for k, (rule, pattern, query) in enumerate(self.rules):
            for d in self.candidates(query, postings, len(texts)).tolist() if query else range(len(texts)):
                out[d] += [(m.start(rule.told), k, m.end(rule.told)) for m in pattern.finditer(texts[d]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for x in out:
            x.sort()
        return out


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the counts of the base kinds, the digest of the base spans, and all spans."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner()
        kinds, base = [r.kind for r in RULES], [r.base for r in RULES]
        for batch in pieces(batches, 1):
            found = find.spans([x or "" for x in batch.column(1).to_pylist()])
            counts = [[sum(k == want for _, k, _ in x) for x in found] for want in range(3)]
            told = [[f"{kinds[k]}:{a}:{b}" for a, k, b in x] for x in found]
            digests = [hashlib.sha256(",".join(t for t, (_, k, _) in zip(ts, x, strict=True) if base[k]).encode()).hexdigest() for ts, x in zip(told, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([",".join(t) for t in told], pa.string())],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def blanked(text: str, spans: list[tuple[int, int, int]], names: list[str]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first names the whole stretch."""
    out, done, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[done:start], f"[{names[kind]}]"]
        done, k = end, k + 1
    return "".join([*out, text[done:]])


def redacted(df: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, secrets in ``text`` replaced by their kind and ``n_chars`` counted anew.

    Rows without a secret, null texts included, stay as they are.
    """
    ship(df.sparkSession)
    at, count_at = df.columns.index(text), df.columns.index(n_chars) if n_chars in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = scanner()
        names = [r.kind for r in RULES]
        for batch in pieces(batches, at):
            texts = batch.column(at).to_pylist()
            found = find.spans([x or "" for x in texts])
            columns = list(batch.columns)
            if any(found):
                texts = [blanked(t, x, names) if x else t for t, x in zip(texts, found, strict=True)]
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if count_at is not None:
                    counts = [len(t) if x else n for t, x, n in zip(texts, found, columns[count_at].to_pylist(), strict=True)]
                    columns[count_at] = pa.array(counts, batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
