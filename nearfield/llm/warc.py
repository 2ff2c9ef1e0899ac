"""WARC archives and transaction assembly.

write_archive() makes three records a page: the request, the response (or a revisit of an earlier response with the same
payload), and metadata with the page's id, the last two naming the response's record through WARC-Concurrent-To.
Archives are written by Spark's text writer, so they go to any store; each file is WARC 1.0 in one gzip stream of FILE_BYTES
or so. read_records() reads such files, those with a gzip member for each record, and plain ones; it inflates piece by piece and
cuts records by Content-Length, so a task holds a compressed file and one record. assemble() brings the records of a capture together through their
concurrent-to identifiers: one aggregation, one nested row a capture. resolve() gives revisits the payload that they name by
digest (profile identical-payload-digest).

Revisits: of pages with equal payloads of at least LEAST_REVISIT bytes, that with the least page_id is the response.

Defined cases: null html is an empty payload, null url an empty one; a null page_id is written as empty and read as null, and
comes last in order; rows with one page_id and payload are captures of their own, all responses where theirs is the least;
line ends in urls are removed; a record or gzip member cut short, or a wrong digest, raises ValueError; zero bytes after the
last gzip member are padding.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import cut, scratch_path

LEAST_REVISIT = 100
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BATCH_RECORDS = 500
FILE_BYTES = 128 << 20
MOST_RECORDS = 4000
PIECE = 1 << 20
RECORDS = "record_id string, type string, concurrent_to string, target_uri string, date string, digest string, page_id long, payload_bytes long, payload_digest string, http_status int, payload binary"


def _record(kind: str, record_id: Column, concurrent: Column | None, url: Column, date: str, content_type: str, extra: list[Column | str], block: Column) -> Column:
    head: list = [f"WARC/1.0{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <urn:uuid:", record_id, f">{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: ", url]
    if concurrent is not None:
        head += [f"{CRLF}WARC-Concurrent-To: <urn:uuid:", concurrent, ">"]
    parts = [*head, *extra, f"{CRLF}Content-Type: {content_type}{CRLF}Content-Length: ", F.octet_length(block).cast("string"), CRLF + CRLF, block]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _uuid(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archive pages(page_id, url, html) under path."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("row", F.monotonically_increasing_id())
    many = rows.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(many.select("digest", "origin"), "digest", "left")
    is_first = F.col("origin").isNull() | F.col("page_id").eqNullSafe(F.col("origin"))
    url, digest = F.col("url"), F.col("digest")
    ids = {k: _uuid(k, F.col("page_id"), digest, F.col("row")) for k in ("response", "request", "metadata")}
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF + CRLF))
    payload = [f"{CRLF}WARC-Payload-Digest: sha256:", digest]
    response = _record("response", ids["response"], None, url, date, "application/http; msgtype=response", payload, F.concat(http, "html"))
    revisit = _record("revisit", ids["response"], None, url, date, "application/http; msgtype=response", [*payload, f"{CRLF}WARC-Profile: {PROFILE}"], http)
    asked = F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    request = _record("request", ids["request"], ids["response"], url, date, "application/http; msgtype=request", [], asked)
    about = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record("metadata", ids["metadata"], ids["response"], url, date, "application/warc-fields", [], about)
    end = CRLF + CRLF
    whole = F.concat(request, F.lit(end), F.when(is_first, response).otherwise(revisit), F.lit(end), metadata)
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    most = int(max(1, min(MOST_RECORDS, FILE_BYTES // (1000 + mean))))
    rows.select(whole.alias("value")).write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def inflate(data) -> Iterator[bytes]:
    """The content of a file in pieces of bounded size: that of all its gzip members one after the other, or as it is."""
    view, at = memoryview(data), 0
    if bytes(view[:2]) != b"\x1f\x8b":
        for at in range(0, len(view), PIECE):
            yield bytes(view[at : at + PIECE])
        return
    while at < len(view):
        if view[at] == 0:
            at += 1
            continue
        member, tail = zlib.decompressobj(31), b""
        while not member.eof:
            if not tail:
                tail = bytes(view[at : at + PIECE])
                at += len(tail)
            piece = member.decompress(tail, PIECE)
            if not piece and not tail and not member.eof:
                raise ValueError("a gzip member is cut short")
            tail = member.unconsumed_tail
            if piece:
                yield piece
        at -= len(member.unused_data)


class _Stream:
    """Pieces read as one run of bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is passed over; None if there is no mark."""
        searched = 0
        while (found := self.held.find(mark, searched)) < 0:
            searched = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                return None
        return self.take(found + len(mark))[:found]


def parse(data, payloads: bool = True) -> Iterator[tuple]:
    """The records of an archive's file, as rows of RECORDS."""
    stream = _Stream(inflate(data))
    while stream.held or stream.more():
        top = stream.until(b"\r\n\r\n")
        if top is None or not top.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = {}
        for line in top.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.decode().lower()] = value.strip().decode("utf-8", "surrogateescape")
        block = stream.take(int(head["content-length"]))
        if len(block) < int(head["content-length"]):
            raise ValueError("a record is cut short")
        stream.take(4)
        kind = head["warc-type"]
        page_id = size = found = status = payload = None
        digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            status = int(http.split(b" ", 2)[1])
            if kind == "response":
                size, found = len(payload), hashlib.sha256(payload).hexdigest()
                if digest is not None and digest != found:
                    raise ValueError("a payload differs from its digest")
            else:
                payload = None
        elif kind == "metadata":
            fields = dict(line.split(b": ", 1) for line in block.split(b"\r\n") if b": " in line)
            page_id = int(fields[b"page_id"]) if fields.get(b"page_id") else None
        yield head["warc-record-id"], kind, head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-date"), digest, page_id, size, found, status, payload if payloads else None


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records under path; without payloads their sizes and digests are still those of the archived bytes."""
    kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for r in parse(content.as_buffer(), payloads):
                    rows.append(r)
                    held += len(r[-1] or b"")
                    if len(rows) >= BATCH_RECORDS or held >= FILE_BYTES // 4:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: capture_id and the nested request, response and metadata records, null where there is none."""
    fields = [c for c in records.columns if c != "concurrent_to"]
    own = F.struct(*fields)
    capture = F.coalesce("concurrent_to", "record_id")

    def of(*kinds: str) -> Column:
        return F.min_by(F.when(F.col("type").isin(*kinds), own), F.when(F.col("type").isin(*kinds), F.col("record_id")))

    return records.groupBy(capture.alias("capture_id")).agg(of("request").alias("request"), of("response", "revisit").alias("response"), of("metadata").alias("metadata"))


def resolve(captures: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each capture; revisits found by payload digest."""
    flat = cut(captures.select("metadata.page_id", "response.payload_bytes", F.coalesce("response.payload_digest", "response.digest").alias("payload_digest"), F.col("response.type").alias("record_type")), "captures")
    revisits = flat.filter("record_type = 'revisit'").select("page_id", "payload_digest", "record_type")
    origins = flat.filter("record_type = 'response'").groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    found = revisits.join(origins.join(revisits.select("payload_digest").distinct(), "payload_digest", "left_semi"), "payload_digest", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return flat.filter("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")).union(found.select(*columns, "refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive all pages in the shared folder, read the archives back, and give one row a page."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    return resolve(assemble(read_records(spark, path, payloads=False)))
