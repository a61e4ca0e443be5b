"""WARC records in ZIP packages, read back by range without extraction.

A package is a ZIP archive with two stored (uncompressed) members: the WARC
file, each record a gzip member of its own as usual, and its index, one line
for each record (sorted by URL key) with the record's place in the WARC file.  The reader parses the end record,
the ZIP64 locator and end record, the central directory and its ZIP64 extra
fields on its own, finds the members' data through their local headers, and
then reads single records by byte range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_read, open_write, scratch, slices, stage

WARC_MEMBER = "archive/data.warc.gz"
LEVEL = 2
INDEX_MEMBER = "indexes/index.cdxj"
PACKAGE_BYTES = 256 << 20
STAMP = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path, without spaces: the index's sort key."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url or ""
    return f"{host}){parts.path}" + (f"?{parts.query}" if parts.query else "")


def _clean(value: str) -> str:
    return "".join(c for c in value if c >= " ")


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, parts)))}>"


def record_bytes(kind: str, url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, place: str = "") -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP headers only.

    A response's id comes from its page_id and digest, so that revisits can
    name it; a revisit's, and that of a page without page_id, from its place.
    """
    own = record_id("page", page_id, digest) if kind == "response" and page_id is not None else record_id("place", place)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}",
        f"WARC-Date: {STAMP}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += [
            f"WARC-Refers-To: {record_id('page', refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    warc = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), body


class PackageWriter:
    """One ZIP package, streamed out: the WARC member first, then its index."""

    def __init__(self, uri: str, zip64: bool = True):
        self.uri, self.raw = uri, open_write(uri)
        self.zip = zipfile.ZipFile(io.BufferedWriter(_Sink(self.raw)), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(WARC_MEMBER, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=zip64)
        self.at, self.lines = 0, []

    def add(self, kind: str, url: str | None, page_id: int | None, payload: bytes, refers_to: int | None) -> None:
        digest = digest32(payload)
        data = gzip.compress(record_bytes(kind, url, page_id, payload, digest, refers_to, f"{self.uri}:{self.at}"), LEVEL, mtime=0)
        self.member.write(data)
        self.lines.append(f"{_clean(url_key(url)).replace(' ', '%20')} {json.dumps({'url': url, 'page_id': page_id, 'type': kind, 'digest': digest, 'offset': self.at, 'length': len(data)})}")
        self.at += len(data)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER, (2024, 1, 1, 0, 0, 0)), "\n".join(sorted(self.lines)))
        self.zip.close()
        self.zip.fp and self.zip.fp.close()
        self.raw.close()


class _Sink(io.RawIOBase):
    """Lets zipfile write to an append-only stream."""

    def __init__(self, out: pa.NativeFile):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


class PackageReader:
    """Central directory of a ZIP file and ranges of its stored members."""

    def __init__(self, uri: str):
        self.file = open_read(uri)
        self.size = self.file.size()
        self.members: dict[str, tuple[int, int, int]] = {}  # local header, size, method
        self._directory()

    def _directory(self) -> None:
        tail_at = max(0, self.size - 65_557)
        tail = self.file.read_at(self.size - tail_at, tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no ZIP end record")
        count, size, at = struct.unpack_from("<HII", tail, end + 10)
        if 0xFFFF in (count,) or 0xFFFFFFFF in (size, at):
            locator = end - 20
            if locator < 0 or tail[locator : locator + 4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            (place,) = struct.unpack_from("<Q", tail, locator + 8)
            record = self.file.read_at(56, place)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            count, size, at = struct.unpack_from("<QQQ", record, 32)
        data, p = self.file.read_at(size, at), 0
        for _ in range(count):
            if data[p : p + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", data, p + 10)[0]
            packed, plain, name_n, extra_n, note_n = struct.unpack_from("<IIHHH", data, p + 20)
            (header,) = struct.unpack_from("<I", data, p + 42)
            name = data[p + 46 : p + 46 + name_n].decode("utf-8")
            extra, e = data[p + 46 + name_n : p + 46 + name_n + extra_n], 0
            while e + 4 <= len(extra):
                tag, n = struct.unpack_from("<HH", extra, e)
                if tag == 1:
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                e += 4 + n
            self.members[name] = (header, packed, method)
            p += 46 + name_n + extra_n + note_n

    def locate(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many they are."""
        header, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed")
        local = self.file.read_at(30, header)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        name_n, extra_n = struct.unpack_from("<HH", local, 26)
        return header + 30 + name_n + extra_n, size

    def index(self) -> list[dict]:
        at, size = self.locate(INDEX_MEMBER)
        lines = self.file.read_at(size, at).decode("utf-8").split("\n") if size else []
        return [json.loads(line.split(" ", 1)[1]) for line in lines]  # a key has no space

    def records(self, entries: list[dict]) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
        """The records of index entries, each by a range read."""
        start, _ = self.locate(WARC_MEMBER)
        for x in entries:
            yield parse_record(gzip.decompress(self.file.read_at(x["length"], start + x["offset"])))

    def close(self) -> None:
        self.file.close()


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with ``refers_to``: null for responses.

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with
    the smallest page_id are responses and the others refer to it.  Only
    digests are gathered; the html meets them in one join on the digest, whose
    other side has a row for each repeated payload, so a hot payload's rows
    can be split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("same", F.sha2("html", 256))
    repeated = rows.where(F.octet_length("html") >= min_bytes).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(repeated, "same", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to")
    )


def write_packages(pages: DataFrame, min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``pages`` as packages; the manifest (uri, n_records) commits them."""
    base = scratch(pages.sparkSession, "warc")

    def run(batches):
        part, writer = TaskContext.get().partitionId(), None

        def done():
            writer.close()
            return pa.RecordBatch.from_pydict({"uri": [writer.uri], "n_records": pa.array([len(writer.lines)], pa.int64())})

        for batch in slices(batches):
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if writer is None:
                    writer = PackageWriter(f"{base}/part-{part:06d}-{uuid.uuid4().hex}.wacz")
                writer.add("response" if refers_to is None else "revisit", url, page_id, html.encode("utf-8", "replace"), refers_to)
                if writer.at >= package_bytes:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    return stage(mark_revisits(pages, min_bytes).mapInArrow(run, "uri string, n_records long"), "warc-manifest")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_packages(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of a manifest's packages, through index and range reads.

    Digest and size are taken from a response's own payload and, where the
    record holds none, from a revisit's headers.
    """
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def number(text: str | None) -> int | None:
        return int(text) if text else None

    def rows(uri: str):
        reader = PackageReader(uri)
        entries = sorted(reader.index(), key=lambda x: x["offset"])
        for x, (warc, http, body) in zip(entries, reader.records(entries)):
            kind = warc["WARC-Type"]
            size, digest = (int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha1:")) if kind == "revisit" else (len(body), digest32(body))
            yield number(warc["WARC-Page-ID"]), x["url"], size, digest, kind, number(warc.get("WARC-Refers-To-Page-ID")), body if payloads and kind == "response" else None
        reader.close()

    def run(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                held = []
                for row in rows(uri):
                    held.append(row)
                    if len(held) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    files = manifest.select("uri").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "uri")
    return files.mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame, min_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """pages(page_id, url, html, ...) written as packages and read back.

    One row for each row of ``pages``.  A null html is empty.  Rows repeating
    the smallest page_id of equal payloads are all responses; a row without a
    page_id revisits the smallest, or is a response where no row has one.
    Other columns are ignored; an empty table gives an empty result.
    """
    return read_packages(write_packages(pages, min_bytes), payloads)
