"""WARC archives and the external merge of their capture indexes.

Writing: every page is one record, a response with its payload, or a revisit of the response with the same
payload (the largest page_id of the payload's group), whose HTTP header still states the payload's length.
Spark's text writer puts the records of a task, with the record end as its line end, into archives of at most
``RECORDS`` records.

Reading: every archive is parsed by its content lengths, payloads are digested again, and its index entries
are sorted by URL key and time: a run. Splitters of all keys cut each run into slices, and every range of keys
is one group, in which a loser tree merges the slices of all runs. Range by range, the groups are the capture
histories in global order (``range_no``, ``place``). A key as frequent as several ranges spreads over them.

A null html is an empty payload; payloads are grouped whatever their size. A null page_id is smaller than any
other: such a page is a revisit where its group has an id, else a response; rows that repeat the largest id
are responses all. A null url gives a record without a target and an empty URL key, a null time none. Control
characters in urls are percent-encoded. Other columns play no part; an empty table gives an empty result.
Payloads are kept and digested whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from itemspark.llm.common import ship
from itemspark.session import work_dir

#: Records of an archive, index entries of a range, and keys that splitters are chosen from.
RECORDS, RANGE_ROWS, SAMPLE = 20_000, 10_000, 100_000
END = "\r\n\r\n"
#: The alphabets of Spark's base-32 numbers and of RFC 4648.
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
         "url": pa.string(), "url_key": pa.string(), "captured_at": pa.string(), "archive": pa.string(), "offset": pa.int64()}
OUT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, url_key string, captured_at string, archive string, offset bigint"


def base32_sha1(payload: Column) -> Column:
    """Forty hexadecimal digits, five at a time, are four of base 32 each."""
    digest = F.upper(F.sha1(payload))
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]), DIGITS, LETTERS)


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query, in lower case; no scheme, port or fragment."""
    if not url:
        return ""
    rest = url.split("#", 1)[0].lower()
    rest = rest.split("://", 1)[-1]
    cut = min((k for k in (rest.find("/"), rest.find("?")) if k >= 0), default=len(rest))
    host = rest[:cut].rsplit("@", 1)[-1].split(":", 1)[0].removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){rest[cut:] or '/'}"


def _pages(df: DataFrame, page_id: str, url: str, html: str, at: str) -> DataFrame:
    """The operator's own columns, and a key that names a row, its id or else what it holds."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = df.select(F.col(page_id).cast("bigint").alias("page_id"), F.regexp_replace(F.col(url).cast("string"), r"[\x00-\x20\x7f]", "%20").alias("url"),
                     F.date_format(F.col(at).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    return rows.withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.concat_ws(" ", F.lit("none"), "digest", "url", "captured_at")))


def revisits(facts: DataFrame) -> DataFrame:
    """key and refers_to of every page that another of the same digest stands for.

    A digest's rows are salted by their key over as many parts as the session shuffles into, so that neither
    side of the join has a digest in one task.
    """
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = facts.select("key", "page_id", "digest", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("salt"))
    some = salted.groupBy("digest", "salt").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    whole = some.groupBy("digest").agg(F.max("last").alias("refers_to"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    whole = whole.where("n > 1 and refers_to is not null").select("digest", "refers_to", F.explode("salts").alias("salt"))
    return salted.join(whole, ["digest", "salt"]).where("page_id is null or page_id < refers_to").select("key", "refers_to").distinct()


def record(rows: DataFrame) -> Column:
    """The text of a record, without its end."""
    size = F.octet_length("payload").cast("string")
    again = F.col("refers_to").isNotNull()
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    body = F.when(again, "").otherwise(F.col("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    length = (F.octet_length(http) + F.octet_length(body)).cast("string")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    head = [F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", F.coalesce(urn("page_id"), F.lit("<urn:page:>"))),
            line("WARC-Date", F.col("captured_at")), line("WARC-Target-URI", F.col("url")), line("WARC-Refers-To", urn("refers_to")),
            line("WARC-Profile", F.when(again, PROFILE)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            F.lit("Content-Type: application/http;msgtype=response\r\n"), line("Content-Length", length), F.lit("\r\n")]
    return F.concat(*head, http, body)


def write(rows: DataFrame, repeated: DataFrame, folder: str) -> None:
    marked = rows.join(repeated.hint("shuffle_hash"), "key", "left")
    marked.select(record(marked).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)


def parsed(data: bytes, archive: str) -> Iterator[dict]:
    """The index entries of an archive, in its order. Records are told apart by their lengths alone."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:head_end].decode().split("\r\n")[1:])
        begin = head_end + 4
        end = begin + int(head["Content-Length"])
        http_end = data.index(b"\r\n\r\n", begin, end)
        revisit = head["WARC-Type"] == "revisit"
        if revisit:
            http = dict(x.split(": ", 1) for x in data[begin:http_end].decode().split("\r\n")[1:])
            size, digest = int(http["Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
        else:
            payload = memoryview(data)[http_end + 4:end]
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if head["WARC-Payload-Digest"] != f"sha1:{digest}":
                raise ValueError(f"{archive}: the payload at {at} is not the one that was written")
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"{archive}: the record at {at} does not end where it says")
        number = lambda name: int(x) if (x := head.get(name, "").removeprefix("<urn:page:").rstrip(">")) else None
        target = head.get("WARC-Target-URI")
        yield {"page_id": number("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number("WARC-Refers-To"),
               "url": target, "url_key": url_key(target), "captured_at": head.get("WARC-Date"), "archive": archive, "offset": at}
        at = end + 4


Key = tuple[str, str, bool, int]


def order_key(key: str, at: str | None, page_id: int | None) -> Key:
    return key, at or "", page_id is not None, page_id or 0


class LoserTree:
    """Merges sorted sequences: an inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list[Key]]):
        self.runs, self.at, n = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(1, n)
        up: dict[int, int] = {n + k: k for k in range(n)}
        for node in range(n - 1, 0, -1):
            a, b = up[2 * node], up[2 * node + 1]
            up[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = up.get(1, 0)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's next goes before run b's; a run at its end goes last."""
        if self.at[a] == len(self.runs[a]):
            return False
        if self.at[b] == len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or x == y and a < b

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it), in order."""
        n, total = len(self.runs), sum(map(len, self.runs))
        for _ in range(total):
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            node = (run + n) >> 1
            while node:
                if self._before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node >>= 1
            self.winner = run


def splitters(facts: DataFrame, rows: int) -> list[Key]:
    """Keys that cut all captures into ranges of about ``RANGE_ROWS``, by a bounded sample."""
    ranges = max(1, ceil(rows / RANGE_ROWS))
    if ranges == 1:
        return []
    sample = facts.orderBy(F.xxhash64("key")).limit(min(SAMPLE, 200 * ranges)).select("url", "captured_at", "page_id").collect()
    keys = sorted(order_key(url_key(r[0]), r[1], r[2]) for r in sample)
    return [keys[k * len(keys) // ranges] for k in range(1, ranges)]


def runs(archives: DataFrame, cuts: list[Key]) -> DataFrame:
    """Each archive's sorted entries, cut by range: one row per archive and range, of lists."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                archive = path.as_py().rsplit("/", 1)[-1]
                entries = list(parsed(gzip.decompress(content.as_buffer()), archive))
                keyed = sorted(((order_key(e["url_key"], e["captured_at"], e["page_id"]), k) for k, e in enumerate(entries)))
                slices: dict[int, list[dict]] = {}
                for key, k in keyed:
                    low, high = bisect_left(cuts, key), bisect_right(cuts, key)
                    slices.setdefault(low + zlib.crc32(archive.encode()) % (high - low + 1), []).append(entries[k])
                if slices:
                    columns = [pa.array([[e[name] for e in part] for part in slices.values()], pa.list_(kind)) for name, kind in ENTRY.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int32()), *columns], names=["range_no", *ENTRY])

    fields = ", ".join(f"{x.rsplit(' ', 1)[0]} array<{x.rsplit(' ', 1)[1]}>" for x in OUT.split(", "))
    return archives.select("path", "content").mapInArrow(read, f"range_no int, {fields}")


def merge(slices: pa.Table) -> pa.Table:
    """One range: the slices of all runs as one history."""
    lists = {name: slices[name].to_pylist() for name in ENTRY}
    keys = [[order_key(*x) for x in zip(*parts, strict=True)] for parts in zip(lists["url_key"], lists["captured_at"], lists["page_id"], strict=True)]
    order = list(LoserTree(keys))
    columns = {name: pa.array([lists[name][run][k] for run, k in order], kind) for name, kind in ENTRY.items()}
    number = slices["range_no"][0].as_py()
    return pa.table({**columns, "range_no": pa.array([number] * len(order), pa.int32()), "place": pa.array(range(len(order)), pa.int64())})


def captures(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", at: str = "captured_at") -> DataFrame:
    """Writes the pages as archives, reads these, and returns the merged index, one row per page."""
    spark = df.sparkSession
    ship(spark)
    folder = work_dir(spark, "warc")
    rows = _pages(df, page_id, url, html, at)
    rows.select("key", "page_id", "digest", "url", "captured_at").write.parquet(f"{folder}/facts")
    facts = spark.read.parquet(f"{folder}/facts")
    revisits(facts).write.parquet(f"{folder}/revisits")
    write(rows, spark.read.parquet(f"{folder}/revisits"), f"{folder}/archives")
    cuts = splitters(facts, facts.count())
    archives = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "part-*").load(f"{folder}/archives")
    return runs(archives, cuts).groupBy("range_no").applyInArrow(merge, f"{OUT}, range_no int, place bigint")
