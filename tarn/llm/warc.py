"""WARC archives: a writer, and a salvage reader.

Each record is a gzip member of its own. A task joins members to files of bounded size and Spark's text writer stores them
as they are, one row a file; its line separator is an empty member, so that each file is a valid archive. Payloads
that repeat are stored once: the record with the largest page id is the response, the others are revisits that refer to it.

The reader checks every record (version line, length, closing lines, block digest) and every gzip member. After a
failed check it searches for the next version line, or the next member that opens, goes on from there, and reports
the bytes between as a quarantined gap. It decompresses piece by piece and holds one record at a time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import map_batches, materialize, new_path

#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 1000
#: A file is closed at this many bytes; a larger record has a file of its own.
FILE_BYTES = 16 << 20
#: What is decompressed at once.
PIECE = 1 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")
#: No version line is longer: so many last bytes may be the beginning of one.
_LONGEST_VERSION = 32
_URN = "<urn:x-page:"


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def page_records(df: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, refers_to, record): the text of one record per row. Null payload: empty; null ids stay apart as ``null``."""
    pages = df.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(payload_column).cast("string"), F.lit("")).alias("payload"))
    pages = pages.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    keys = materialize(pages.filter(F.col("bytes") >= least).select("page_id", "bytes", "digest"), "payload-keys")
    many = keys.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # only pages that repeat another's payload, with the id they refer to; ids are unique after the distinct
    later = keys.join(many, ["digest", "bytes"]).filter("page_id < first or page_id is null").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    pages = pages.join(later.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to"), F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit(_URN), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    pages = pages.withColumn("block", block)
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", urn(F.col("page_id"))),
        F.when(F.col("url").isNotNull(), _header("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20]", "%20"))).otherwise(F.lit("")),
        _header("WARC-Date", F.lit(DATE)),
        F.when(revisit, F.concat(_header("WARC-Refers-To", urn(F.col("refers_to"))), _header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("X-Payload-Length", F.col("bytes").cast("string")),
        _header("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    return pages.select("page_id", "refers_to", record.alias("record"))


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for record in batch.column(0):
                held.append(member(record.as_buffer().to_pybytes() + END))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["file"])

    # a cast to string leaves bytes as they are, and so does the text writer
    rows = map_batches(records.select("record"), files, "file binary").select(F.col("file").cast("string"))
    rows.write.option("lineSep", member(b"").decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


@dataclass
class Found:
    """A record, or a quarantined gap (``kind="gap"``, why in ``error``). Offsets are in the file, or in its decompressed stream."""

    kind: str
    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    error: str = ""


def members(data: bytes) -> Iterator[tuple[bytes, bool, Found | None]]:
    """What gzip members hold, piece by piece: (bytes, whether a member begins, the gap after it if it fails)."""
    at = 0
    while at < len(data):
        opened, to, error, first = zlib.decompressobj(31), at, "", True
        try:
            if data[at : at + 3] != MEMBER:
                raise zlib.error("no gzip member")
            while not opened.eof and to < len(data):
                chunk = data[to : to + PIECE]
                to += len(chunk)
                while chunk and not opened.eof:
                    if out := opened.decompress(chunk, PIECE):
                        yield out, first, None
                        first = False
                    chunk = opened.unconsumed_tail
            if not opened.eof:
                error = "member cut short"
        except zlib.error as e:
            error = str(e)
        if not error:
            at = to - len(opened.unused_data)
            continue
        after = at + 1
        while (after := data.find(MEMBER, after)) >= 0 and not _opens(data, after):
            after += 1
        after = len(data) if after < 0 else after
        yield b"", False, Found("gap", at, after, error=error)
        at = after


def _opens(data: bytes, at: int) -> bool:
    opened = zlib.decompressobj(31)
    try:
        return bool(opened.decompress(data[at : at + 4096], 64)) or opened.eof
    except zlib.error:
        return False


class Records:
    """The valid records of a plain stream that comes in pieces, and the gaps between them."""

    def __init__(self) -> None:
        self.held, self.base = bytearray(), 0  # what is not settled yet, and where it begins
        self.lost: int | None = None
        self.why = ""

    def feed(self, piece: bytes, last: bool = False) -> Iterator[Found]:
        self.held += piece
        at = 0
        while at < len(self.held):
            found = self._record(at, last)
            if found is None:  # the end has not come yet
                break
            if isinstance(found, Found):
                if self.lost is not None:
                    yield Found("gap", self.lost, found.start, error=self.why)
                    self.lost = None
                yield found
                at = found.end - self.base
                continue
            if self.lost is None:
                self.lost, self.why = self.base + at, found
            m = _VERSION.search(self.held, at + 1)
            at = m.start() if m else len(self.held) if last else max(at + 1, len(self.held) - _LONGEST_VERSION)
        self.base += at
        del self.held[:at]

    def close(self) -> Iterator[Found]:
        yield from self.feed(b"", last=True)
        if self.lost is not None:
            yield Found("gap", self.lost, self.base, error=self.why)
            self.lost = None

    def _record(self, at: int, last: bool) -> Found | str | None:
        """The record that begins here, what is wrong with it, or None if that cannot be told before more comes."""
        stream = self.held
        if not (m := _VERSION.match(stream, at)):
            return "no version line" if last or len(stream) - at >= _LONGEST_VERSION else None
        headers, a = {}, m.end()
        while True:  # line by line: what does not end is given up at the first line that is no header
            stop = stream.find(b"\r\n", a)
            if stop < 0:
                return "headers do not end" if last else None
            line, a = bytes(stream[a:stop]), stop + 2
            if not line:
                break
            name, colon, value = line.partition(b":")
            if not colon:
                return "broken header"
            headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        length = headers.get("content-length", "")
        if not length.isdecimal() or len(length) > 18:
            return "no length"
        b = a + int(length)
        if b + len(END) > len(stream) and not last:
            return None
        if stream[b : b + len(END)] != END:
            return "record does not close"
        block = bytes(stream[a:b])
        digest = headers.get("warc-block-digest", "")
        if digest.startswith("sha1:") and hashlib.sha1(block).hexdigest() != digest[5:].lower():
            return "block digest differs"
        return Found(headers.get("warc-type", ""), self.base + at, self.base + b + len(END), headers, block)


def records(stream: bytes) -> Iterator[Found]:
    reader = Records()
    yield from reader.feed(stream, last=True)
    yield from reader.close()


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of one archive, compressed or not. Records may run on through members, unless the next one begins with a record."""
    if data[:2] != MEMBER[:2]:
        yield from records(data)
        return
    reader = Records()
    for plain, first, gap in members(data):
        if gap or first and reader.held and _VERSION.match(plain):
            yield from reader.close()
        yield from reader.feed(plain)
        if gap:
            yield gap
    yield from reader.close()


def _number(urn: str) -> int | None:
    x = urn.removeprefix(_URN).removesuffix(">")
    return int(x) if re.fullmatch("-?[0-9]+", x) else None


SCHEMA = "archive string, start long, end long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, error string"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record or gap (``record_type = 'gap'``) of the archives under ``path``; with ``payloads``, also the bytes.

    Length and digest of a response are those of the payload as read; a revisit's are what its record states.
    """

    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * payloads)
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["payload"] * payloads

    def described(archive: str, f: Found) -> tuple:
        h = f.headers
        body = f.block.partition(END)[2] if f.kind == "response" else None
        stated = h.get("x-payload-length", "")
        size = len(body) if body is not None else int(stated) if stated.isdecimal() else None
        digest = hashlib.sha1(body).hexdigest() if body is not None else h.get("warc-payload-digest", "").removeprefix("sha1:") or None
        error = f.error or ("payload digest differs" if body is not None and h.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}" else None)
        return archive, f.start, f.end, f.kind, _number(h.get("warc-record-id", "")), h.get("warc-target-uri"), size, digest, _number(h.get("warc-refers-to", "")), error, *[body] * payloads

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out: list[tuple] = []
                held = 0
                found = (described(archive, f) for f in salvage(content.as_buffer().to_pybytes()))
                for row in chain(found, [None]):
                    if row is not None:
                        out.append(row)
                        held += len(row[-1] or b"") if payloads else 0
                    if out and (row is None or len(out) == 1000 or held >= PIECE):
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, held = [], 0

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return map_batches(files.select("path", "content"), rows, SCHEMA + ", payload binary" * payloads)


def archive_pages(df: DataFrame, path: str | None = None, gaps: str | None = None, **columns: str) -> DataFrame:
    """Write ``df`` (page_id, url, html) as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Quarantined gaps, if there are any, are logged as a table at ``gaps`` (by default ``path`` with ``-gaps``). Null html is an
    empty payload, a null url has no target line, a null id reads back as null; rows that repeat a page
    wholly are all responses if theirs is the largest id of their payload. Other columns are ignored. An
    empty table writes and gives nothing.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(page_records(df, **columns), path)
    found = materialize(read_archives(spark, path), "warc-found")
    lost = found.filter("record_type = 'gap'").select("archive", "start", "end", "error")
    if not lost.isEmpty():
        lost.write.parquet(gaps or f"{path}-gaps")
    return found.filter("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
