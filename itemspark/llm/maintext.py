"""Main text of web pages, with a suffix array over each host's pages.

A page is cut into blocks at its block-level tags; scripts, styles, forms and other machinery hold no text.
Markup gives each block a kind: it stands in an ``article`` or ``main``, or in a part tagged as a menu, header, footer,
sidebar, notice, advert or comment (by element, role, or a word of its class or id), or it is undecided. An ``article``
or ``main`` within a tagged or hidden part (a card of a related story) does not count. Where only classes and ids tag
the part, it may as well be the page's frame: if such elements hold more text than is undecided elsewhere, or if all
text of a page is tagged, classes and ids are disregarded there.

The token streams of a host's pages, all blocks of all pages, are concatenated and sorted as suffixes to a depth of
``RUN`` tokens. Runs are of ``RUN`` tokens and more, or of a whole block. A run is boilerplate outside main elements if
``PAGES`` distinct pages hold it there; within main elements, where copies and quotations repeat too, it takes more than
half of the host's pages and ``MOST`` at least, wherever they hold it, and then it is boilerplate anywhere. What a page
has beside boilerplate are its unique runs, and these decide:

* Of a page's main elements the blocks stay that hold a unique run, whole.
* Main elements without any are the page's frame if the unique runs of undecided blocks hold more text; else they stay.
* Of a page without a main element the unique runs of undecided blocks stay.

Tagged blocks are evidence of what repeats; markup then leaves them out, unique or not.

Hosts of more than ``PART`` pages or ``PART_BYTES`` of html are dealt into parts of about that size (of ``PART_PAGES``
pages, if these are longer), each with its own array. Every part tells how many of its pages hold each window of ``RUN``
tokens and each short block outside main elements, and which windows more than half of its pages hold: what most of the
host's pages hold is among these. These are then counted in every part. The sums over the parts, by 64-bit hash, decide
for the host. A page's rows are in one part, so the sums are exact.

Null and empty html give an empty text; a null url is a host of its own without a name. Repeated rows are
extracted each, and rows that share a page_id count as one page for the sharing; rows without an id count each.
Other columns play no part; an empty table gives an empty result. Pages are read whole.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from itemspark.llm.common import pieces, ship
from itemspark.session import work_dir

#: Tokens of a shared run (a power of two), pages that share it, pages and bytes of a host's part.
RUN, PAGES, PART, PART_BYTES = 8, 3, 2_000, 4 << 20
#: Pages of a part however long they are: most pages of fewer would hold much of what each holds.
PART_PAGES = 16
#: The fewest pages of which more than half make a run boilerplate within main elements.
MOST = 8

# Names of HTML, and words that name parts of pages.
SILENT = frozenset("script style noscript template head title svg math canvas iframe object select textarea button form dialog".split())
MAIN = frozenset(("article", "main"))
CHROME = frozenset("nav footer aside menu".split())
IN_HEAD = frozenset("base link meta".split())
OUTER = frozenset(("header",))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu navbar navigation breadcrumb breadcrumbs "
                   "cookie cookies consent gdpr notice notices newsletter subscribe popup modal comment comments disqus respond share sharing social related footer "
                   "masthead pagination pager toolbar").split())
OUTER_WORDS = frozenset(("header", "topbar"))

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)
    |<(script|style|noscript|template|textarea|title|iframe)\b[^>]*+>.*?(?:</\1\s*>|\Z)
    |<!\[CDATA\[.*?\]\]>
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<[!?/a-zA-Z][^>]*+>""", re.S | re.I | re.X)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?![-\w])", re.I)
PART_OF = re.compile(r"[^a-z]+")

TEXT, TAGGED, UNDECIDED = 0, 1, 2
#: What a started element changes.
PLAIN, IS_MAIN, IS_CHROME, IS_SILENT = 0, 1, 2, 3


def _kind(name: str, attributes: str, in_main: bool, by_words: bool) -> int:
    if name in SILENT:
        return IS_SILENT
    if name in MAIN:
        return IS_MAIN
    if name in CHROME or (name in OUTER and not in_main):
        return IS_CHROME
    if attributes and name not in ("body", "html"):
        if "hidden" in attributes or "display" in attributes:
            if UNSEEN.search(attributes) or HIDDEN.search(QUOTED.sub("", attributes)):
                return IS_SILENT
        for what, *values in NAMED.findall(attributes):
            value = "".join(values).lower()
            if what.lower() == "role":
                if value in ROLES:
                    return IS_CHROME
                if value in ("main", "article"):
                    return IS_MAIN
            elif by_words:
                words = PART_OF.split(value)
                if not WORDS.isdisjoint(words) or (not in_main and not OUTER_WORDS.isdisjoint(words)):
                    return IS_CHROME
    return PLAIN


def blocks(page: str) -> tuple[bool, list[tuple[int, str]]]:
    """Whether the page has a main element, and its blocks in order as (TEXT, TAGGED or UNDECIDED, text)."""
    has_main, found = _blocks(page, True)
    if not has_main and any(kind == TAGGED for kind, _ in found):
        # The second look: without what classes and ids say.
        size = lambda want, some: sum(len(t) for kind, t in some if kind == want)
        again = _blocks(page, False)
        if size(TEXT, again[1]) > size(UNDECIDED, found) or not size(UNDECIDED, found):
            return again
    return has_main, found


def _blocks(page: str, by_words: bool) -> tuple[bool, list[tuple[int, str]]]:
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    depth = [0, 0, 0, 0]
    has_main = False

    def close_block() -> None:
        if held:
            raw = "".join(held)
            held.clear()
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((TAGGED if depth[IS_CHROME] else TEXT if depth[IS_MAIN] else UNDECIDED, text))

    at = 0
    for m in TOKEN.finditer(page):
        start = m.start()
        if start > at and not depth[IS_SILENT]:
            held.append(page[at:start])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if name in INLINE and (not m.group(4) or name in VOID):
            if name == "br":
                held.append(" ")
            elif name not in VOID and not m.group(2):
                stack.append((name, PLAIN))
            elif m.group(2):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        if stack[k][1] == PLAIN:
                            del stack[k]
                        else:
                            close_block()
                            depth[stack[k][1]] -= 1
                            del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            continue
        attributes = m.group(4)
        if m.group(2):
            if name not in INLINE:
                close_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, kind in stack[k:]:
                        depth[kind] -= 1
                    del stack[k:]
                    break
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            depth[stack.pop()[1]] -= 1
        kind = _kind(name, attributes, depth[IS_MAIN] > 0, by_words)
        if name not in INLINE or kind:
            close_block()
        if name in VOID or attributes.rstrip().endswith("/") and name not in MAIN:
            continue
        if name in ("p", "li") and stack and stack[-1][0] == name:
            stack.pop()
        stack.append((name, kind))
        depth[kind] += 1
        has_main = has_main or (kind == IS_MAIN and not depth[IS_CHROME] and not depth[IS_SILENT])
    if not depth[IS_SILENT] and at < len(page):
        held.append(page[at:])
    close_block()
    return has_main, out


class Windows:
    """The windows of some blocks: the ``RUN`` tokens from each place of the concatenated streams.

    A block stands between a start mark and as many end marks as a run is long, so that a block shorter than a
    run is compared as a whole; other windows hold no mark. ``at``: the places where a window begins, ``block``:
    the block of each of these.
    """

    def __init__(self, streams: pa.ListArray):
        self.sizes = sizes = np.diff(streams.offsets.to_numpy()).astype(np.int64)
        tokens = streams.flatten().dictionary_encode()
        number = tokens.indices.to_numpy().astype(np.int64)
        self.tokens = tokens.dictionary
        total = len(number) + (RUN + 1) * len(streams)
        self.text = text = np.ones(total, np.int64)  # 1: the end mark
        self.begin = begin = np.cumsum(sizes + RUN + 1) - sizes - RUN  # each block's first token
        text[begin - 1] = 2
        text[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(len(number))] = number + 3
        left = np.repeat(begin + sizes, sizes + RUN + 1) - np.arange(total)  # tokens up to the block's end
        self.at = np.flatnonzero(((text == 2) & (left - 1 < RUN)) | ((text >= 3) & (left >= RUN)))
        self.block = np.repeat(np.arange(len(streams)), sizes + RUN + 1)[self.at]

    def ranks(self) -> np.ndarray:
        """Of every window its rank among the sorted suffixes: neighbours in the suffix array that share ``RUN`` tokens have the same."""
        rank, depth = self.text, 1
        while depth < RUN:
            pair = rank * (int(rank.max(initial=0)) + 1)
            pair[:-depth] += rank[depth:]
            order = np.argsort(pair)
            pair = pair[order]
            rank = np.empty_like(pair)
            rank[order] = np.cumsum(np.r_[False, pair[1:] != pair[:-1]][:len(pair)])
            depth *= 2
        return rank[self.at]

    def hashes(self) -> np.ndarray:
        """Of every window a hash, the same in every part."""
        value = np.array([xxhash.xxh64_intdigest(t, 1) for t in ("end", "start", *self.tokens.to_pylist())], np.uint64)
        value[:2] ^= np.uint64(0x9E3779B97F4A7C15)
        each = np.r_[value[self.text - 1], np.zeros(RUN, np.uint64)]
        out = np.zeros(len(self.text), np.uint64)
        for k in range(RUN):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += each[k:k + len(out)]
        return out[self.at].view(np.int64)

    def covered(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every place whether a ``shared`` window covers it, and of every block how many of its tokens are covered."""
        starts = self.at[shared]
        steps = np.zeros(len(self.text) + RUN + 1, np.int64)
        steps[starts] += 1
        steps[starts + RUN] -= 1
        cover = np.cumsum(steps)[:len(self.text)] > 0
        upto = np.r_[0, np.cumsum(cover)]
        return cover, upto[self.begin + self.sizes] - upto[self.begin]


def held(value: np.ndarray, page: np.ndarray, size: int) -> np.ndarray:
    """Of every number below ``size``, how many distinct pages hold it."""
    n = int(page.max(initial=0)) + 1
    pair = np.sort(value * n + page)
    return np.bincount(pair[np.r_[True, pair[1:] != pair[:-1]][:len(pair)]] // n, minlength=size)


def _among(value: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``value`` are among the ascending ``values``."""
    if not len(values):
        return np.zeros(len(value), bool)
    return values[np.minimum(np.searchsorted(values, value), len(values) - 1)] == value


def shared_runs(streams: list[list[str]], page: list[int]) -> list[np.ndarray]:
    """Of each block's tokens, which lie in a run that enough distinct pages share."""
    found = Windows(pa.array(streams, pa.list_(pa.string())))
    rank = found.ranks()
    cover, _ = found.covered(held(rank, np.asarray(page)[found.block], int(rank.max(initial=0)) + 1)[rank] >= PAGES)
    return [cover[b:b + n] for b, n in zip(found.begin.tolist(), found.sizes.tolist(), strict=True)]


class Part:
    """Pages of a host: every block of every page, its windows, their pages, and which stand outside main elements (``frame``)."""

    def __init__(self, rows: pa.Table):
        number: dict[object, int] = defaultdict(itertools.count().__next__)
        pages = [number[("row", k) if p is None else p] for k, p in enumerate(rows["page_id"].to_pylist())]
        self.pages = len(number)
        self.has_main, kinds = rows["has_main"].to_pylist(), rows["kinds"].to_pylist()
        self.many = np.array([len(k) for k in kinds], np.int64)
        self.kind = np.frombuffer("".join(kinds).encode(), np.uint8) - ord("0")
        lines = pc.split_pattern(pa.array(rows["text"].to_pylist(), pa.string()), "\n").flatten()
        self.blocks = lines.filter(pc.not_equal(lines, ""))  # no block is empty, but the text of a page without blocks
        self.found = Windows(pc.split_pattern(self.blocks, " "))
        self.page = np.repeat(np.asarray(pages, np.int64), self.many)[self.found.block]
        self.frame = (self.kind != TEXT)[self.found.block]

    def held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows' ranks; of every rank, how many pages hold it outside main elements, and how many anywhere."""
        rank = self.found.ranks()
        size = int(rank.max(initial=0)) + 1
        return rank, held(rank[self.frame], self.page[self.frame], size), held(rank, self.page, size)

    def texts(self, shared: np.ndarray, most: np.ndarray) -> list[str]:
        """The pages' texts. ``shared``, ``most``: the windows that are boilerplate outside main elements, and anywhere."""
        found, size, blocks, out, first = self.found, self.found.sizes, self.blocks.to_pylist(), [], 0
        cover, some = found.covered(shared | most)
        _, main = found.covered(most)
        inside, own, undecided = self.kind == TEXT, (self.kind == TEXT) & (main < size), (self.kind == UNDECIDED) & (some < size)

        def runs(k: int) -> str:
            return " ".join(itertools.compress(blocks[k].split(" "), ~cover[found.begin[k]:found.begin[k] + size[k]])) if some[k] else blocks[k]

        for has_main, many in zip(self.has_main, self.many.tolist(), strict=True):
            here, first = slice(first, first + many), first + many
            kept = inside[here] if has_main else np.zeros(many, bool)
            unique = kept & own[here]
            text = "\n".join(itertools.compress(blocks[here], unique if unique.any() else kept))
            if not has_main or (kept.any() and not unique.any()):
                outside = "\n".join(map(runs, (np.flatnonzero(undecided[here]) + here.start).tolist()))
                text = outside if len(outside) > len(text) else text
            out.append(text)
        return out


def _texts(rows: pa.Table, texts: list[str]) -> pa.Table:
    return pa.table({"page_id": rows["page_id"], "url": rows["url"], "text": pa.array(texts, pa.string())})


def host_texts(rows: pa.Table) -> pa.Table:
    """The texts of a host that is one part."""
    part = Part(rows)
    rank, frames, many = part.held()
    return _texts(rows, part.texts((frames >= PAGES)[rank], ((many >= MOST) & (2 * many > part.pages))[rank]))


def windows(rows: pa.Table) -> pa.Table:
    """One part of a host: how many of its pages hold each window outside main elements, and whether most of them hold it anywhere."""
    part = Part(rows)
    rank, frames, many = part.held()
    most = 2 * many > part.pages
    one = np.zeros(len(many), np.int64)  # a window of each rank
    one[rank] = np.arange(len(rank))
    told = np.flatnonzero((frames > 0) | most)
    hashes, n = part.found.hashes()[one[told]], len(told)
    return pa.table({"host": pa.array([rows["host"][0].as_py()] * n, pa.string()), "part": pa.array([rows["part"][0].as_py()] * n, pa.int64()),
                     "hash": pa.array(hashes, pa.int64()), "n": pa.array(frames[told], pa.int64()), "most": pa.array(most[told], pa.bool_())})


def counted(rows: pa.Table, told: pa.Table) -> pa.Table:
    """One part of a host: the told windows, with the number of its pages that hold anywhere what most pages of a part hold."""
    asked = told["hash"].to_numpy()
    many = np.zeros(len(asked), np.int64)
    most = np.flatnonzero(told["most"].to_numpy())
    if rows.num_rows and len(most):
        part, values = Part(rows), np.sort(asked[most])
        hashes = part.found.hashes()
        here = _among(hashes, values)
        many[most] = held(np.searchsorted(values, hashes[here]), part.page[here], len(values))[np.searchsorted(values, asked[most])]
    return told.append_column("n", pa.array(many, pa.int64()))


def part_texts(rows: pa.Table, told: pa.Table) -> pa.Table:
    """The texts of one part of a host. ``told``: the windows that are boilerplate on it, outside main elements or anywhere."""
    part = Part(rows)
    hashes, values = part.found.hashes(), told["hash"].to_numpy()
    shared, most = (np.sort(values[told[c].to_numpy()]) for c in ("shared", "most"))
    return _texts(rows, part.texts(_among(hashes, shared), _among(hashes, most)))


def extracted(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    spark = df.sparkSession
    ship(spark)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = df.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                      host.alias("host"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per page: whether it has a main element, a digit for each block's kind, a line for each block's text."""
        for batch in pieces(batches, 4):
            found = [blocks(body) for body in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([has_main for has_main, _ in found], pa.bool_()), pa.array(["".join(str(kind) for kind, _ in b) for _, b in found], pa.string()),
                 pa.array(["\n".join(text for _, text in b) for _, b in found], pa.string())], names=["host", "part", "page_id", "url", "has_main", "kinds", "text"])

    def dealt(some: DataFrame, part: Column) -> GroupedData:
        """The pages' blocks by part of their host. Pages are cut once: what follows twice or more shares the shuffle."""
        row = "host string, part bigint, page_id bigint, url string, has_main boolean, kinds string, text string"
        return some.select("host", part.cast("bigint").alias("part"), "page_id", "url", "html").mapInArrow(cut, row).groupBy("host", "part")

    # One in PART pages at most, or one in PART_BYTES of html, begins a further part, so this table stays small against the pages.
    sizes = pages.groupBy("host", "page_id").agg(F.count("*").alias("rows"), F.sum(F.octet_length("html")).alias("bytes")).groupBy("host").agg(
        F.sum(F.when(F.col("page_id").isNull(), F.col("rows")).otherwise(1)).alias("pages"), F.sum("bytes").alias("bytes"))
    folder = work_dir(spark, "maintext")
    by_bytes = F.least(F.ceil(F.col("bytes") / PART_BYTES), F.ceil(F.col("pages") / PART_PAGES))
    parts = F.greatest(F.ceil(F.col("pages") / PART), by_bytes).cast("bigint")
    sizes.select("host", "pages", parts.alias("parts")).where("parts > 1").write.parquet(f"{folder}/large")
    large = F.broadcast(spark.read.schema("host string, pages bigint, parts bigint").parquet(f"{folder}/large"))
    result = "page_id bigint, url string, text string"
    out = dealt(pages.join(large, "host", "left_anti"), F.lit(0)).applyInArrow(lambda rows: host_texts(rows), result)
    if not large.isEmpty():
        own = F.pmod(F.xxhash64(F.coalesce("page_id", F.monotonically_increasing_id())), F.col("parts"))
        many = dealt(pages.join(large, "host"), own)
        # A window has one row of each part at most. What the parts' frames share goes to those that told it, what most pages of a part hold to all parts.
        same = Window.partitionBy("host", "hash")
        found = many.applyInArrow(windows, "host string, part bigint, hash bigint, n bigint, most boolean").select(
            "host", "part", "hash", (F.sum("n").over(same) >= PAGES).alias("shared"), F.max("most").over(same).alias("most"), F.min("part").over(same).alias("first"))
        to = F.when(F.col("most"), F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).otherwise(F.array("part"))
        asked = found.where("shared or most").where("part = first or not most").join(large, "host").select("host", F.explode(to).alias("part"), "hash", "shared", "most")
        row = "host string, part bigint, hash bigint, shared boolean, most boolean"
        sums = many.cogroup(asked.groupBy("host", "part")).applyInArrow(counted, f"{row}, n bigint").groupBy("host", "hash").agg(
            F.bool_or("shared").alias("shared"), (F.bool_or("most") & (F.sum("n") >= MOST)).alias("most"), F.sum("n").alias("n"), F.collect_set("part").alias("held"))
        told = sums.join(large, "host").select("host", F.explode("held").alias("part"), "hash", "shared", (F.col("most") & (2 * F.col("n") > F.col("pages"))).alias("most"))
        out = out.unionByName(many.cogroup(told.where("shared or most").groupBy("host", "part")).applyInArrow(lambda rows, told: part_texts(rows, told), result))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
