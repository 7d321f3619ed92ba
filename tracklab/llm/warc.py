"""WARC archives: written from pages, read back, and assembled into one nested row per capture.

Every page becomes three WARC/1.1 records: the response (or a revisit), the request and a metadata record; the last two name the
first by WARC-Concurrent-To. Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the smallest id is
the response and the others are revisits: headers and digest without the payload, which names the response's address.

Files are gzip streams of records. Records are packed into rows of about ``CHUNK`` bytes and a file holds at most
``CHUNKS`` of them, so that a file fits a task whatever the partition holds; Spark writes and reads the files, so any store
will do. A reader unpacks a file piece by piece and finds records by their lengths, so that payloads may hold anything.

Assembly: requests name their response, metadata records their response or the request. A metadata record that names a
request is led on through it; then all records of a capture meet by the identifier of its response.

Defined results: a null or empty payload has no bytes and is always a response; rows that repeat the smallest id of their
payload are all responses; a null id is the largest, and all are responses where every id is null; a missing address is
empty, and characters that headers cannot hold are percent-encoded; an empty table writes no record and reads back empty;
records without a partner make a capture of their own with the missing parts null or empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklab.llm.common import new_path, written

LEAST_REVISIT = 100
CHUNK = 2 << 20
CHUNKS = 16
#: Pages carry no time of their own.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"

RECORD = "record_id string, type string, concurrent_to string, target_uri string, date string, refers_to_uri string, payload_bytes long, payload_digest string, intact boolean, fields map<string,string>"
_ARROW = pa.schema(
    [
        *[(c, pa.string()) for c in ("record_id", "type", "concurrent_to", "target_uri", "date", "refers_to_uri")],
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("intact", pa.bool_()),
        ("fields", pa.map_(pa.string(), pa.string())),
    ]
)


def with_origin(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, first_id, first_url): the page that a revisit names, null for a response.

    First pages are found from digests and ids alone; only those of payloads that occur more than once are joined, from a
    written table, so that Spark can split a payload that very many pages share.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long_rows = rows.where(F.octet_length("payload") >= least).select("digest", "page_id", "url")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = long_rows.groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = written(firsts.select(F.col("digest").alias("of"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "first-pages")
    later = F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))
    own = ["page_id", "url", "payload", "digest"]
    joined = rows.join(firsts, F.col("digest") == F.col("of"), "left")
    return joined.select(*own, *[F.when(later, F.col(c)).alias(c) for c in ("first_id", "first_url")])


def header_safe(value: str) -> str:
    """An address as one header value: blanks, controls and non-ASCII characters percent-encoded."""
    return quote(value, safe="".join(chr(c) for c in range(0x21, 0x7F)))


def _record(kind: str, name: str, date: str, content: str, block: str, **fields: str) -> str:
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nContent-Type: {content}\r\nContent-Length: {len(block.encode())}"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items()]
    return "\r\n".join(head) + END + block


def capture_records(place: str, page_id: int | None, url: str, payload: str, digest: str, first_id: int | None, first_url: str | None, date: str = DATE) -> list[str]:
    """The records of one page; ``place`` makes their identifiers unique."""
    name = {}
    for part in ("response", "request", "metadata"):
        h = hashlib.md5(f"{place}:{part}".encode()).hexdigest()
        name[part] = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
    address = header_safe(url)
    try:
        parts = urlsplit(address)
        host, path = parts.netloc, (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        host, path = "", "/"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload.encode())}{END}"
    by_digest, common = {"WARC_Payload_Digest": f"sha256:{digest}"}, {"WARC_Target_URI": address}
    own = f"page-id: {'' if page_id is None else page_id}\r\n"
    if first_url is None:
        head = _record("response", name["response"], date, "application/http; msgtype=response", http + payload, **common, **by_digest)
    else:
        refers = {"WARC_Profile": PROFILE, "WARC_Refers_To_Target_URI": header_safe(first_url), "WARC_Refers_To_Date": date}
        head = _record("revisit", name["response"], date, "application/http; msgtype=response", http, **common, **by_digest, **refers)
        own += f"refers-to-page: {first_id}\r\n"
    beside = {**common, "WARC_Concurrent_To": f"<urn:uuid:{name['response']}>"}
    asked = _record("request", name["request"], date, "application/http; msgtype=request", f"GET {path} HTTP/1.1\r\nHost: {host}{END}", **beside)
    return [head, asked, _record("metadata", name["metadata"], date, "application/warc-fields", own, **beside)]


def write_archives(pages: DataFrame, path: str | None = None, least: int = LEAST_REVISIT, date: str = DATE, chunk: int = CHUNK, chunks: int = CHUNKS) -> str:
    """Write (page_id, url, html) as archives and return their folder."""
    path = path or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for row in zip(*[(v.as_py() for v in column) for column in batch.columns]):
                for record in capture_records(f"{task}:{n}:{row[0]}:{row[3]}", *row, date=date):
                    held.append(record)
                    size += len(record)
                n += 1
                if size >= chunk:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(held)])], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held)])], names=["value"])

    packed = with_origin(pages, least).mapInArrow(run, "value string")
    packed.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", chunks).text(path)
    return path


class _Stream:
    """Bytes of a gzip stream (one or many members), unpacked as they are asked for."""

    STEP = 1 << 18

    def __init__(self, data: bytes):
        self.data, self.at, self.unpack, self.held = memoryview(data), 0, zlib.decompressobj(31), bytearray()

    def fill(self) -> bool:
        if self.unpack.eof:
            rest = self.unpack.unused_data
            self.at -= len(rest)
            self.unpack = zlib.decompressobj(31)
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + self.STEP]
        self.at += len(piece)
        self.held += self.unpack.decompress(piece)
        return True

    def head(self) -> bytes | None:
        """Header lines up to the blank line, without the line ends that close the record before."""
        seen = 0
        while True:
            while self.held[:2] == b"\r\n":
                del self.held[:2]
                seen = 0
            at = self.held.find(b"\r\n\r\n", max(0, seen - 3))
            if at >= 0 and self.held[:1] != b"\r":
                found = bytes(self.held[:at])
                del self.held[: at + 4]
                return found
            seen = len(self.held)
            if not self.fill():
                if self.held.strip():
                    raise ValueError("archive ends inside a record's header")
                return None

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.fill():
                raise ValueError("archive ends inside a record")
        found = bytes(self.held[:n])
        del self.held[:n]
        return found


def _lines(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n"))
    return {k.strip().lower(): v.strip() for k, colon, v in pairs if colon}


def parse(data: bytes, payloads: bool = False) -> Iterator[dict]:
    """The records of one file in order. Digest and length of a payload are taken from its bytes, of a revisit from its headers."""
    stream = _Stream(data)
    while (head := stream.head()) is not None:
        if not head.startswith(b"WARC/"):
            raise ValueError("not the start of a record")
        named = _lines(head)
        block, kind = stream.take(int(named["content-length"])), named["warc-type"].lower()
        bare = lambda name: named[name].strip("<>") if name in named else None
        row = dict.fromkeys(_ARROW.names) | {"record_id": bare("warc-record-id"), "type": kind, "concurrent_to": bare("warc-concurrent-to"), "target_uri": named.get("warc-target-uri"), "date": named.get("warc-date"), "refers_to_uri": named.get("warc-refers-to-target-uri")}
        if kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            said = named.get("warc-payload-digest", "").removeprefix("sha256:") or None
            fields = _lines(http)
            if kind == "response":
                digest = hashlib.sha256(body).hexdigest()
                row |= {"payload_bytes": len(body), "payload_digest": digest, "intact": said in (None, digest)}
                if payloads:
                    row["payload"] = body
            else:
                row |= {"payload_bytes": int(fields["content-length"]) if "content-length" in fields else None, "payload_digest": said}
            row["fields"] = list(fields.items())
        elif kind == "request":
            first, _, rest = block.partition(b"\r\n")
            row["fields"] = [("request", first.decode("utf-8", "replace")), *_lines(rest).items()]
        else:
            row["fields"] = list(_lines(block).items())
        yield row


def read_records(spark: SparkSession, path: str, payloads: bool = False, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of all archives below ``path``; with ``payloads`` also the payload of responses, as bytes."""
    schema = _ARROW.append(pa.field("payload", pa.binary())) if payloads else _ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in parse(content.as_py(), payloads):
                    held.append(row)
                    size += 500 + len(row.get("payload") or b"")
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD + (", payload binary" if payloads else ""))


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, head, requests, metadata): one row per capture; ``head`` is the response or revisit.

    ``records`` is read twice; hand over a written table where parsing is dear.
    """
    held = [c for c in records.columns if c != "concurrent_to"]
    part = F.struct(*held).alias("part")
    heads = records.where(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.lit("head").alias("role"), part)
    requests = records.where("type = 'request'")
    asked = requests.select(F.coalesce("concurrent_to", "record_id").alias("capture_id"), F.lit("requests").alias("role"), part)
    leads = requests.where("concurrent_to is not null").select(F.col("record_id").alias("request_id"), F.col("concurrent_to").alias("led_to"))
    noted = records.where("type = 'metadata'").join(leads, F.col("concurrent_to") == F.col("request_id"), "left")
    noted = noted.select(F.coalesce("led_to", "concurrent_to", "record_id").alias("capture_id"), F.lit("metadata").alias("role"), part)
    of = lambda role: F.when(F.col("role") == role, F.col("part"))
    by_name = lambda c: F.array_sort(F.collect_list(of(c)), lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0))
    met = heads.unionByName(asked).unionByName(noted).groupBy("capture_id")
    return met.agg(F.first(of("head"), ignorenulls=True).alias("head"), by_name("requests").alias("requests"), by_name("metadata").alias("metadata"))
