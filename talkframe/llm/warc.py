"""WARC archives: writing, reading, and a merged index of captures.

Writing: one record for each page.  Of records with equal payloads of at least
``min_bytes`` bytes the largest page id keeps its payload (``response``), the
others become ``revisit`` records that refer to it.  A record's block is an
HTTP response; a revisit's block ends after the HTTP header, which still states
the length of the payload.  Archives are gzip text files of bounded record
counts that Spark writes and reads by any path it knows.

Reading streams every archive through Spark's text reader, piece by piece between
empty lines, puts the records together by the lengths they state and checks the
digest of each payload that is stored.  A task holds one record and one Arrow batch of
pieces (``BATCH_BYTES``, or one piece if that is longer), whatever the archive's size.

Index: the captures of each archive, sorted by URL key and time, are a run.
Runs are dealt to key ranges and every range merges its pieces of all runs with
a loser tree, so the ranges in order are the capture history of every URL.

Cases: a null payload is empty, a null URL is the empty URI; a null page id
becomes the record id ``null`` and never wins over a number; rows with equal
page id and payload are both responses if the id is the winner's; payloads may
hold any bytes, record separators included.  Control characters, spaces and
percent signs of a URL are percent-encoded in the header and decoded back.  An empty
table gives no captures; of the input only the named columns are read, so others
cannot clash.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.tables import stored

CRLF = "\r\n"
_BLANK = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = ("run string, seq bigint, url_key string, time string, page_id bigint, record_type string, refers_to bigint, "
           "payload_bytes bigint, payload_digest string, url string, offset bigint, length bigint")
_ORDER = ("url_key", "time", "page_id")


def typed(pages: DataFrame, min_bytes: int = 1000, key: str = "page_id", url: str = "url", payload: str = "html",
          time: str | None = None) -> DataFrame:
    """(page_id, url, time, payload, digest, size, winner): winner null for payloads without a twin."""
    when = F.col(time).cast("timestamp") if time else F.timestamp_seconds(
        F.lit(1577836800) + F.pmod(F.coalesce(F.col(key), F.lit(0)), F.lit(315360000)))
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), body.alias("payload"),
                        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("bigint").alias("size"))
    twins = (rows.where(F.col("size") >= min_bytes).groupBy("digest", "size")
             .agg(F.max("page_id").alias("winner"), F.count("*").alias("c")).where("c > 1").drop("c"))
    return rows.join(twins, ["digest", "size"], "left")


def _encoded(url):
    for c in ["%", *map(chr, range(33)), "\x7f"]:
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return url


def write(pages: DataFrame, path: str, records_per_file: int = 500, **how) -> None:
    """Write the archives of ``pages`` under ``path``."""
    rows = typed(pages, **how)
    revisit = F.coalesce(F.col("winner") != F.col("page_id"), F.col("winner").isNotNull())
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("size").cast("string"), F.lit(CRLF * 2))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "), urn("page_id"), F.lit(f"{CRLF}WARC-Date: "), F.col("time"),
        F.lit(f"{CRLF}WARC-Target-URI: "), _encoded(F.col("url")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), urn("winner"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), block.cast("string"), F.lit(CRLF * 2))
    record = F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")))
    # a record ends with two line breaks, which is what separates lines here
    (rows.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


#: Bytes of an Arrow batch of pieces that a task reads.
BATCH_BYTES = 16 << 20


def inflated(data: bytes, block: int = 1 << 16):
    """The content of a gzip file, block by block."""
    inflate, at = zlib.decompressobj(31), 0
    while at < len(data):
        yield inflate.decompress(data[at:at + block])
        at += block
        while inflate.eof and inflate.unused_data:
            rest, inflate = inflate.unused_data, zlib.decompressobj(31)
            yield inflate.decompress(rest)


class _Stream:
    """The bytes of blocks that come one by one."""

    def __init__(self, blocks):
        self.blocks, self.buffer, self.offset = iter(blocks), bytearray(), 0

    def _more(self) -> bool:
        for block in self.blocks:
            self.buffer += block
            return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (i := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        self.offset += len(out)
        return out


def records(blocks):
    """(offset, length, WARC header, block) of the records of one archive, given in blocks of bytes."""
    s = _Stream(blocks)
    while True:
        at = s.offset
        head = s.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode().split(CRLF)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at byte {at}: {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:] if x)
        block = s.take(int(fields["Content-Length"]))
        if s.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield at, s.offset - at, fields, block


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: ``com,example)/a?b``."""
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return url
    labels = [x for x in host.split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    shown = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(labels)) + shown + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def _page(urn: str) -> int | None:
    x = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "null" else int(x)


def _capture(run: str, at: int, length: int, fields: dict, block: bytes) -> dict:
    cut = block.index(b"\r\n\r\n") + 4
    http = dict(x.split(": ", 1) for x in block[:cut].decode().split(CRLF)[1:] if x)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        payload = memoryview(block)[cut:]
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{run}: the payload at byte {at} does not match its digest")
    else:
        size = int(http["Content-Length"])
    url = unquote(fields["WARC-Target-URI"])
    refers = fields.get("WARC-Refers-To")
    return {"run": run, "url_key": url_key(url), "time": fields["WARC-Date"], "page_id": _page(fields["WARC-Record-ID"]),
            "record_type": fields["WARC-Type"], "refers_to": _page(refers) if refers else None, "payload_bytes": size,
            "payload_digest": digest, "url": url, "offset": at, "length": length}


def _sort_key(c: dict):
    return c["url_key"], c["time"], c["page_id"] is not None, c["page_id"] or 0


_ARROW = pa.schema([("run", pa.string()), ("seq", pa.int64()), ("url_key", pa.string()), ("time", pa.string()),
                    ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string()),
                    ("offset", pa.int64()), ("length", pa.int64())])


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of every archive under ``path``: one locally sorted run for each archive."""
    def parse(batches):
        rows = ((name, piece) for b in batches for name, piece in zip(b.column(0).to_pylist(), b.column(1)))
        for name, pieces in groupby(rows, key=lambda x: x[0]):  # a gzip file is read by one task, from its start
            found = sorted((_capture(name, *r) for r in records(p.as_py() + _BLANK for _, p in pieces)), key=_sort_key)
            yield pa.RecordBatch.from_pylist([c | {"seq": i} for i, c in enumerate(found)], schema=_ARROW)

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    files = (spark.read.option("lineSep", CRLF * 2).option("pathGlobFilter", "*.gz").text(path)
             .select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece")))
    return stored(files.mapInArrow(parse, CAPTURE), "warc-runs")


class LoserTree:
    """Tournament of sorted streams: ``inner[i]`` holds the loser of node i's match."""

    def __init__(self, streams, key):
        self.streams, self.key = [iter(s) for s in streams], key
        self.k = len(self.streams)
        self.head = [self._next(i) for i in range(self.k)]
        self.inner = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i, building=True)

    def _next(self, i):
        for row in self.streams[i]:
            return self.key(row), row
        return None

    def _beats(self, a, b) -> bool:
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None
        return (self.head[a][0], a) <= (self.head[b][0], b)

    def _play(self, i, building=False):
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if building and self.inner[node] < 0:
                self.inner[node] = winner
                return
            if self._beats(self.inner[node], winner):
                self.inner[node], winner = winner, self.inner[node]
            node //= 2
        self.inner[0] = winner

    def __iter__(self):
        while self.k and self.head[self.inner[0]] is not None:
            i = self.inner[0]
            yield self.head[i][1]
            self.head[i] = self._next(i)
            self._play(i)


def _merged(batches):
    """The pieces of all runs in this key range, merged; one range is in memory."""
    pieces: dict[str, list] = {}
    for b in batches:
        for row in b.to_pylist():
            pieces.setdefault(row["run"], []).append(row)
    held = []
    for row in LoserTree([pieces[r] for r in sorted(pieces)], _sort_key):
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def history(captures: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """Captures in global order of URL key, time and page id (ranges in partition order)."""
    ranges = max(1, -(-captures.count() // rows_per_range))
    dealt = captures.repartitionByRange(ranges, *_ORDER).sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(_merged, CAPTURE)


def round_trip(pages: DataFrame, path: str, **how) -> DataFrame:
    """Write ``pages`` under ``path``, read the archives back and merge their index."""
    write(pages, path, **how)
    return history(runs(pages.sparkSession, path))
