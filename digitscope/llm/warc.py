"""WARC archives of pages, and their capture index merged from sorted runs.

Writing: payloads that occur more than once are stored once, by the response of the largest page id; the
others become revisit records that refer to it. Records are text, so Spark's text writer with the record
separator as its line separator writes valid archives to any file system.

Index: every archive file read back gives a run of captures, sorted where it was read. Ranges of (URL key,
timestamp) are dealt to tasks, and each task merges its slices of all runs with a loser tree: partition
after partition, the result is the globally ordered capture history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from digitscope.llm.shared import parts, stored

# Payloads of fewer bytes are always stored.
LEAST_REVISIT = 1000
# Records of an archive file and bytes of their URLs and payloads at most (a larger record stands alone), and captures that one task merges.
FILE_RECORDS, FILE_BYTES, MERGED = 1000, 1 << 27, 200_000
# Seconds over which default timestamps are spread: years of four digits for any page id.
SPAN = 1 << 31
# Separators and the profile of revisits by digest.
LINE, END = "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURES = ("url_key string, timestamp string, page_id bigint, url string, record_type string, refers_to bigint, "
            "payload_bytes bigint, payload_digest string, file string, offset bigint, length bigint")


def url_key(url: str | None) -> str:
    """Sort key of a URL: host names reversed, without scheme, ``www``, default port and fragment."""
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)([^#]*)", url or "")
    host, path = found.group(1).rpartition("@")[2].lower(), found.group(2)
    host = re.sub(r"^www\d*\.", "", re.sub(r":(80|443)?$", "", host))
    return ",".join(reversed(host.split("."))) + ")" + (path if path.startswith("/") else "/" + path)


class LoserTree:
    """K-way merge of sorted runs: inner nodes keep the loser of each match, so the next item costs log2(k) matches."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.size = max(1, len(self.runs))
        self.heads = [next(r, None) for r in self.runs] or [None]
        self.losers = [-1] * self.size
        self.winner = self._play(1) if self.size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _play(self, node: int) -> int:
        """Winner of a node's matches; leaf i is node ``size + i``."""
        order, winners = [node], {}
        for at in order:
            if at < self.size:
                order += [2 * at, 2 * at + 1]
        for at in reversed(order):
            if at >= self.size:
                winners[at] = at - self.size
            else:
                a, b = winners.pop(2 * at), winners.pop(2 * at + 1)
                winners[at], self.losers[at] = (a, b) if self._before(a, b) else (b, a)
        return winners[node]

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.size) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def _revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, same, refers_to)`` of the pages whose payload a larger page id holds too."""
    keys = stored(pages.select("page_id", F.sha2("payload", 256).alias("same"), F.octet_length("payload").alias("bytes"))
                  .where((F.col("bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "same"))
    last = stored(keys.groupBy("same").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("same", "refers_to"))
    return stored(keys.join(last, "same").where("page_id < refers_to").distinct())


def _record(page: DataFrame) -> Column:
    """One record, without the separator that ends it."""
    def name(page_id: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))

    payload, again = F.col("payload"), F.col("refers_to").isNotNull()
    http = F.concat_ws(LINE, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                       F.concat(F.lit("Content-Length: "), F.octet_length(payload)), F.lit(""), F.lit(""))
    http = F.concat(http, F.when(again, F.lit("")).otherwise(payload))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    head = F.concat_ws(
        LINE, F.lit("WARC/1.1"), F.when(again, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))), F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.sha1(payload)),
        F.when(again, F.concat(F.lit("WARC-Profile: " + PROFILE + LINE + "WARC-Refers-To: "), name(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(http)), F.lit(""), F.lit(""))
    return F.concat(head, http)


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", time: Column | None = None) -> None:
    """Write one record per page into archive files in ``folder``.

    Among equal payloads of at least 1000 bytes the largest page id is the response and the others revisit
    it. A null html is an empty payload and a null url an empty one; a null id is always a response, and rows
    repeated with the largest id all are. ``time`` gives the capture's timestamp; by default one second per page id,
    round a circle of ``SPAN`` seconds.

    A file is read back as one value, so it holds at most ``FILE_RECORDS`` records and about ``FILE_BYTES`` bytes: records go
    by size into files of 1000, 100, 10 records or one, each size in a write of its own where the table has such records.
    """
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce(F.col(page_id).cast("bigint"), F.lit(0)), F.lit(SPAN))) if time is None else time
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"),
                        F.date_format(F.coalesce(at, F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    revisits = _revisits(rows)
    rows = rows.withColumn("same", F.sha2("payload", 256)).join(revisits, ["page_id", "same"], "left")
    size = F.octet_length("payload") + F.octet_length(F.coalesce("url", F.lit("")))
    largest = pages.select(F.octet_length(F.coalesce(F.col(html), F.lit(""))).alias("payload"), F.octet_length(F.coalesce(F.col(url), F.lit(""))).alias("url")) \
        .agg(F.max(F.col("payload").cast("bigint") + F.col("url"))).first()[0] or 0
    records, least = FILE_RECORDS, -1
    while records:
        most = FILE_BYTES // records if records > 1 else largest
        chosen = rows if least < 0 and largest <= most else rows.where((size > least) & (size <= most))
        chosen.select(_record(rows).alias("value")).write.mode("error" if least < 0 else "append") \
            .option("lineSep", END).option("maxRecordsPerFile", records).text(folder)
        if largest <= most:
            break
        records, least = max(1, records // 10), most


def _page(name: bytes) -> int | None:
    number = name.strip().removeprefix(b"<urn:page:").removesuffix(b">")
    return int(number) if number else None


def parse(data: bytes, file: str) -> Iterator[tuple]:
    """The captures of an archive file, in its order. Payloads are checked against their digests."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].split(b"\r\n")
        if version != b"WARC/1.1":
            raise ValueError(f"{file}: no record at {at}")
        head = dict(line.split(b": ", 1) if b": " in line else (line.rstrip(b":"), b"") for line in lines)
        start, size = stop + 4, int(head[b"Content-Length"])
        body = data.index(b"\r\n\r\n", start) + 4
        http = dict(line.split(b": ", 1) for line in data[start:body - 4].split(b"\r\n")[1:])
        digest, kind = head[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode(), head[b"WARC-Type"].decode()
        payload = int(http[b"Content-Length"])
        if kind == "response":
            payload = start + size - body
            if hashlib.sha1(memoryview(data)[body:start + size]).hexdigest() != digest:
                raise ValueError(f"{file}: the payload at {at} does not have its digest")
        url = head[b"WARC-Target-URI"].decode()
        end = start + size + 4
        yield (url_key(url), head[b"WARC-Date"].decode(), _page(head[b"WARC-Record-ID"]), url, kind,
               _page(head[b"WARC-Refers-To"]) if b"WARC-Refers-To" in head else None, payload, digest, file, at, end - at)
        at = end


def _order(capture: tuple) -> tuple:
    """Place of a capture in the history: URL key, timestamp, then where it is stored."""
    return capture[0], capture[1], capture[8], capture[9]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_ARROW = pa.schema([("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archive files in ``folder``; those of a file stand together, sorted, numbered by ``seq``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = sorted(parse(content.as_py(), path.as_py()), key=_order)
                out = _batch(rows, _ARROW)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(range(len(rows)), pa.int64())], [*_ARROW.names, "seq"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(run, CAPTURES + ", seq bigint")


def history(spark: SparkSession, folder: str) -> DataFrame:
    """All captures of the archives in ``folder``, ordered by URL key and timestamp over the whole result.

    Partitions are ranges of the order and each is in order itself, so writing them gives one ordered index;
    captures of one URL may span partitions. A partition holds about ``MERGED`` captures at most.
    """
    captures = stored(runs(spark, folder))
    ranges = max(1, parts(spark), -(-captures.count() // MERGED))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in _ARROW.names), strict=True):
                found.setdefault(row[8], []).append(row)
        rows = []
        for _, row in LoserTree(((_order(r), r) for r in found[f]) for f in sorted(found)):
            rows.append(row)
            if len(rows) == 10_000:
                yield _batch(rows, _ARROW)
                rows = []
        if rows:
            yield _batch(rows, _ARROW)

    return (captures.repartitionByRange(ranges, "url_key", "timestamp", "file", "offset").sortWithinPartitions("file", "seq")
            .mapInArrow(merge, CAPTURES))
