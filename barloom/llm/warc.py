"""WARC archives: written by Spark as gzip members, read back by a reader that salvages damaged files.

Writing: records are built in Arrow batches and leave through Spark's text writer, whose line end is the last byte of
every member (always zero), so files go through the commit protocol to any file system Spark knows.
Reading: whole archives arrive by the ``binaryFile`` source, so an archive is below 2 GB (``write_archives`` aims at 8 MB); members are
inflated piece by piece, in time proportional to the archive and with one record at a time in memory. Where a member or record
fails its checks the reader looks for the next valid member or version line, goes on there and reports the byte gap: in the file,
and in the inflated bytes of a member of which other records are good, also of one that is damaged or cut off itself.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import left_join_hot

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
#: An archive's size aimed at, in bytes of payload.
ARCHIVE_BYTES = 8 << 20
#: A member that holds nothing: its last byte is zero whatever came before.
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()
RECORDS = "kind string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long, length long, inner_offset long, inner_length long, checked boolean, reason string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20]+", "%20", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of page ``first`` with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    lines = [
        VERSION.decode(),
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + END + block + END


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that ends with a zero byte: its last four bytes are the size, below 2^24 for all but huge records."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and, for pages whose payload another page with a smaller id has, that page's id (``first``).

    Payloads are compared by SHA-1. A payload that a third of all pages share is counted before the shuffle and joined
    as a hot key. Rows that carry the smallest page_id are responses, so repeated rows are; pages without an id revisit
    one that has an id, or are responses.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"))
    long_enough = F.octet_length("html") >= least
    firsts = rows.filter(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = pages.count()
    joined = left_join_hot(rows, firsts, "digest", "n", total, F.xxhash64("page_id", "url"))
    other = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))) & long_enough
    return joined.withColumn("first", F.when(other, F.col("first"))).drop("n")


def write_archives(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per row as archives of about ``archive_bytes`` of payload each under ``path``.

    Null html is an empty payload, a null url leaves the target line out; no rows give a folder without records.
    """
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + 600)).first()[0] or 600

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")), strict=True)
            out = [member(record(p, u, h.encode(), base64.b32encode(bytes.fromhex(d)).decode(), f))[:-1] for p, u, h, d, f in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    members = with_roles(pages, least).mapInArrow(build, "value binary")
    files = members.select(F.col("value").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", max(1, int(archive_bytes / mean)))
    files.text(path)


#: Bytes that are inflated at once: the first piece, doubled up to the largest.
PIECES = (1 << 12, 1 << 16)
#: A record's head is no longer than this.
HEAD = 1 << 20
VERSION_LINE = re.compile(rb"WARC/1\.\d\r\n")


@dataclass
class Gap:
    """Bytes that were passed over; ``inner`` and ``inner_length`` are set for those inside the inflated member at ``offset``."""

    offset: int
    length: int
    reason: str
    inner: int | None = None
    inner_length: int | None = None


@dataclass
class Record:
    """A record with its place in the file: of its member where it is alone in one, and else its place inside the member too."""

    offset: int
    length: int | None
    headers: dict[str, str]
    block: bytes
    inner: int | None = None

    @property
    def checked(self) -> bool:
        """Whether the record has a digest of its block, which then holds; one without may come from damaged bytes."""
        return self.headers.get("warc-block-digest", "").startswith("sha1:")

    @property
    def payload(self) -> bytes:
        head, cut, body = self.block.partition(END)
        return body if cut and head.startswith(b"HTTP/") else self.block

    @property
    def payload_bytes(self) -> int:
        """Of the full payload; a revisit has it in its HTTP head."""
        if self.headers.get("warc-type") == "revisit":
            m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", self.block.partition(END)[0])
            return int(m[1]) if m else 0
        return len(self.payload)


class Damaged(ValueError):
    pass


def parse_record(data: bytes, at: int) -> tuple[Record, int]:
    """The record that starts at ``at`` and the place behind it; Damaged if a check fails."""
    if not re.match(rb"WARC/1\.\d\r\n", data[at : at + 16]):
        raise Damaged("no version line")
    end = data.find(END, at)
    if end < 0:
        raise Damaged("head without end")
    headers: dict[str, str] = {}
    for line in bytes(data[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise Damaged("no content length")
    start = end + len(END)
    stop = start + int(headers["content-length"])
    if data[stop : stop + 4] != END:
        raise Damaged("record end not where its length says")
    found = Record(at, stop + 4 - at, headers, data[start:stop])
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and base32_sha1(found.block) != said[5:]:
        raise Damaged("block digest differs")
    said = headers.get("warc-payload-digest", "")
    if said.startswith("sha1:") and headers.get("warc-type") != "revisit" and base32_sha1(found.payload) != said[5:]:
        raise Damaged("payload digest differs")
    return found, stop + 4


class _Member:
    """The gzip member at a place of an archive, inflated piece by piece."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.place, self.size = memoryview(data), at, at, PIECES[0]
        self.unpack, self.ended, self.error = zlib.decompressobj(31), False, None

    def pull(self) -> bytes:
        """The next inflated bytes; none at the end. Before an error all comes that could still be inflated."""
        while not self.ended:
            piece = self.data[self.place : self.place + self.size]
            if not piece:
                self.ended, self.error = True, "member without end"
                break
            try:
                out = self.unpack.decompress(piece)
            except zlib.error as e:
                self.ended, self.error = True, f"member fails: {e}"
                return self._until_error(piece)
            self.place += len(piece)
            self.size = min(2 * self.size, PIECES[1])
            if self.unpack.eof:
                self.ended = True
                self.place -= len(self.unpack.unused_data)
            if out:
                return out
        return b""

    def _until_error(self, piece: memoryview) -> bytes:
        again, out = zlib.decompressobj(31), []
        for a in range(self.at, self.place, PIECES[1]):
            again.decompress(self.data[a : min(a + PIECES[1], self.place)])
        try:
            for i in range(len(piece)):
                out.append(again.decompress(piece[i : i + 1]))
        except zlib.error:
            pass
        return b"".join(out)


def _needed(buffer: bytearray) -> int:
    """Bytes from which on it can be told whether a record is at the start."""
    if len(buffer) < 16:
        return 16
    if not VERSION_LINE.match(buffer):
        return 0
    end = buffer.find(END, 0, HEAD)
    if end < 0:
        return len(buffer) + 1 if len(buffer) < HEAD else 0
    said = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*\r\n", buffer[: end + 2])
    return end + 2 * len(END) + int(said[1]) if said else 0


def _inside(member: _Member) -> Iterator[Record | Gap]:
    """Records of a member and gaps of its inflated bytes, each as soon as it is known; they have no length yet."""
    buffer, base, bad, reason = bytearray(), 0, None, ""
    while True:
        while len(buffer) < _needed(buffer) and not member.ended:
            buffer += member.pull()
        if not buffer:
            if member.ended:
                break
            buffer += member.pull()
            continue
        try:
            found, stop = parse_record(buffer, 0)
        except Damaged as e:
            if bad is None:
                bad, reason = base, str(e)
            next_line = VERSION_LINE.search(buffer, 1)
            stop = next_line.start() if next_line else len(buffer) if member.ended else max(0, len(buffer) - 15)
            if not stop:
                buffer += member.pull()
        else:
            if bad is not None:
                yield Gap(member.at, 0, reason, bad, base - bad)
                bad = None
            yield Record(member.at, None, found.headers, bytes(found.block), base)
        del buffer[:stop]
        base += stop
    if bad is not None:
        yield Gap(member.at, 0, reason, bad, base - bad)
    if member.error:
        yield Gap(member.at, 0, member.error, base, None)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records of an archive, compressed or plain, and gaps where checks fail.

    After a failure the next place is tried where a member or a version line may begin, until one is valid; the bytes
    in between are one gap. A member is valid if it can be inflated whole and its records pass, or if any record in it
    passes; then what fails are gaps inside it. An empty archive has neither.
    """
    at, bad, reason = 0, None, ""
    begins = re.compile(rb"\x1f\x8b\x08|WARC/1\.\d\r\n")
    while at < len(data):
        if data.startswith(MAGIC, at):
            member = _Member(data, at)
            held, valid, inner, sure = [], False, [], at
            for x in _inside(member):
                if isinstance(x, Gap):
                    inner.append(x)
                    continue
                if not valid and bad is not None:
                    yield Gap(bad, at - bad, reason)
                    bad = None
                if valid:  # not alone in its member
                    yield from held
                    held = []
                valid, sure = True, max(sure, member.place - member.size)
                held.append(x)
            if member.error is None and not inner or valid:
                if bad is not None:
                    yield Gap(bad, at - bad, reason)
                    bad = None
                after = member.place
                if member.error:  # the next member may begin before the place where inflating failed
                    found = data.find(MAGIC, max(at + 1, sure))
                    after = found if found >= 0 else len(data)
                for x in held:
                    alone = x.inner == 0
                    yield Record(at, after - at if alone else None, x.headers, x.block, None if alone else x.inner)
                for x in inner:
                    yield Gap(at, after - at, x.reason, x.inner, x.inner_length)
                at = after
                continue
            problem = inner[0].reason if member.error is None else member.error
        else:
            try:
                one, after = parse_record(data, at)
            except Damaged as e:
                problem = str(e)
            else:
                if bad is not None:
                    yield Gap(bad, at - bad, reason)
                    bad = None
                yield one
                at = after
                continue
        if bad is None:
            bad, reason = at, problem
        m = begins.search(data, at + 1)
        at = m.start() if m else len(data)
    if bad is not None:
        yield Gap(bad, len(data) - bad, reason)


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records (kind ``record``) and quarantined byte ranges (kind ``gap``: offset, length, reason) of all archives.

    ``length`` is null for a record that shares its member; it and a gap inside a member have their place in the inflated bytes in
    ``inner_offset``, and ``inner_length`` is null for a member whose rest cannot be inflated. ``checked`` tells whether a record had a
    digest that held. Archives below 2 GB each;
    empty files and folders give no rows, empty payloads are records, equal records all come back.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for x in salvage(content.as_py() or b""):
                    if isinstance(x, Gap):
                        rows.append({"file": name, "kind": "gap", "offset": x.offset, "length": x.length, "inner_offset": x.inner, "inner_length": x.inner_length, "reason": x.reason})
                        continue
                    h = x.headers
                    row = {"file": name, "kind": "record", "page_id": _page(h.get("warc-record-id")), "url": h.get("warc-target-uri"), "record_type": h.get("warc-type"), "refers_to": _page(h.get("warc-refers-to")), "payload_bytes": x.payload_bytes, "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"), "offset": x.offset, "length": x.length, "inner_offset": x.inner, "checked": x.checked}
                    rows.append(row | ({"payload": x.payload} if payload else {}))
                    held += len(x.block) if payload else 0
                    if len(rows) >= 4096 or held > 32 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = "file string, " + RECORDS + ", payload binary" * payload
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in fields.split(", ")])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, fields)


def round_trip(pages: DataFrame, path: str, least: int = 0) -> DataFrame:
    """Write ``pages`` as archives under ``path`` and read them back: one row per page."""
    write_archives(pages, path, least)
    records = read_archives(pages.sparkSession, path).filter(F.col("kind") == "record")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
