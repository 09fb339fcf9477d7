"""WARC records in ZIP packages: written by tasks, read back by ranges.

A package holds two stored members, ``archive/data.warc.gz`` (every record is a gzip
member of its own) and ``indexes/index.tsv`` (one line per record: page, offset and
length within the first).  The reader finds the central directory from the end of the
file, with ZIP64 fields where they are used, locates the stored members and reads
single records by their ranges; nothing is unpacked.

Packages end with a one-byte comment, a newline, so that Spark's text writer can write
them: any store, with the commit protocol of Spark's writers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siterank.llm.binary import open_range
from siterank.llm.tables import slices
from siterank.session import materialize

DATA, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def name_of(page_id) -> str:
    return "" if page_id is None else str(page_id)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member; a revisit carries the HTTP head of its payload only."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:page:{name_of(page_id)}>")
    if url:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head.append(f"WARC-Date: {date}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, 1, mtime=0)


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def head_fields(lines: list[bytes]) -> dict[str, str]:
    pairs = [line.decode("utf-8", "replace").partition(":") for line in lines[1:]]
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse_record(raw: bytes) -> Record:
    """A record from its gzip member (or from plain bytes)."""
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = head_fields(head.split(b"\r\n"))
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, head_fields(http.split(b"\r\n")), payload)


def package(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP file of stored members with ZIP64 directories and a newline as comment."""
    out, entries, at = [], [], 0
    for name, data in members:
        label, crc, size = name.encode(), zlib.crc32(data), len(data)
        extra = struct.pack("<HHQQ", 1, 16, size, size)
        out += [LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 33, crc, FULL32, FULL32, len(label), 20), label, extra, data]
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
        entries.append(
            ENTRY
            + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 33, crc, FULL32, FULL32, len(label), 28, 0, 0, 0, 0, FULL32)
            + label
            + extra
        )
        at += 30 + len(label) + 20 + size
    directory, n = b"".join(entries), len(members)
    out += [
        directory,
        END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), at),
        LOCATOR + struct.pack("<IQI", 0, at + len(directory), 1),
        END + struct.pack("<HHHHIIH", 0, 0, FULL16, FULL16, FULL32, FULL32, 1) + b"\n",
    ]
    return b"".join(out)


class Package:
    """A ZIP file read by ranges; ``source`` can seek and read."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        self.size = source.tell()
        self.members = self._directory()

    def read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(size)
        if len(data) != size:
            raise ValueError("the archive ends too early")
        return data

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """Name to (method, offset of the local header, stored size) of every member."""
        tail_at = max(0, self.size - 22 - FULL16)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(END)
        # A comment may hold the mark of the end itself: only one that fits the length counts.
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("not a ZIP archive")
        count, size, start = struct.unpack_from("<HII", tail, at + 10)
        if count == FULL16 or size == FULL32 or start == FULL32:
            locator_at = tail_at + at - 20
            locator = self.read(locator_at, 20) if locator_at >= 0 else b""
            if locator[:4] == LOCATOR:
                end64 = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end64[:4] != END64:
                    raise ValueError("the ZIP64 directory is not where it should be")
                count, size, start = struct.unpack_from("<QQQ", end64, 32)
        data, at, members = self.read(start, size), 0, {}
        for _ in range(count):
            if data[at : at + 4] != ENTRY:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, plain, name_size, extra_size, note_size = struct.unpack_from("<IIHHH", data, at + 20)
            offset = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + name_size].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + name_size : at + 46 + name_size + extra_size]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<HH", extra)
                if kind == 1:
                    # Only the fields that are full in the entry are here, in this order.
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    plain = next(values) if plain == FULL32 else plain
                    packed = next(values) if packed == FULL32 else packed
                    offset = next(values) if offset == FULL32 else offset
                extra = extra[4 + length :]
            members[name] = (method, offset, packed)
            at += 46 + name_size + extra_size + note_size
        return members

    def stored(self, name: str) -> tuple[int, int]:
        """Offset and size of the bytes of a stored member."""
        method, offset, size = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed, it cannot be read by ranges")
        head = self.read(offset, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        name_size, extra_size = struct.unpack_from("<HH", head, 26)
        return offset + 30 + name_size + extra_size, size

    def index(self) -> list[tuple[str, int, int]]:
        """Page, offset and length of every record, as the index member lists them."""
        at, size = self.stored(INDEX)
        lines = self.read(at, size).decode().splitlines()
        return [(page, int(offset), int(length)) for page, offset, length in (x.split("\t") for x in lines)]

    def records(self, entries: list[tuple[str, int, int]] | None = None) -> Iterator[Record]:
        """The records of the given index entries (default: all), each by its own range."""
        at, _ = self.stored(DATA)
        for _, offset, length in self.index() if entries is None else entries:
            yield parse_record(self.read(at + offset, length))


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``_digest`` (SHA-1 in hex) and ``_refers_to``, null for a response.

    Of equal payloads of at least ``least_bytes`` the row with the smallest page id is
    the response, null ids last; of equal rows one.  Digests are grouped on narrow
    pre-aggregated rows; the payloads move once, by digest and page, so a payload that
    a third of the pages share is spread over all tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.withColumn("_digest", F.sha1(payload)).withColumn("_page", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    large = rows.filter(F.octet_length(payload) >= least_bytes)
    by_page = large.groupBy("_digest", "_page").agg(F.first("page_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    # Nulls are larger than any id here.
    smallest = F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_page")))
    first = by_page.groupBy("_digest").agg(smallest["_page"].alias("_first"), F.sum("_n").alias("_all"))
    shared = materialize(
        by_page.select("_digest", "_page")
        .join(first.filter("_all > 1"), "_digest")
        .select("_digest", "_page", "_first")
    )
    number = F.row_number().over(Window.partitionBy("_digest", "_page").orderBy("url"))
    return (
        rows.join(shared, ["_digest", "_page"], "left")
        .withColumn("_nth", number)
        .withColumn("_refers_to", F.when((F.col("_first") != F.col("_page")) | (F.col("_nth") > 1), F.col("_first")))
        .drop("_first", "_nth", "_page")
    )


def write_packages(
    pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", goal: int = 16 << 20
) -> None:
    """One record per row of ``(page_id, url, html)``, in packages of about ``goal`` bytes.

    A null html is an empty payload.  A task holds one package at a time.
    """

    def packages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data: list[bytes] = []
        index: list[str] = []
        size = 0

        def flush():
            nonlocal data, index, size
            packed = package([(DATA, b"".join(data)), (INDEX, "".join(index).encode())])
            data, index, size = [], [], 0
            return pd.DataFrame({"value": [packed[:-1]]})  # the writer ends it

        for frame in slices(frames, "html", 4 << 20):
            frame = frame.astype(object).where(frame.notna(), None)
            for page_id, url, html, digest, refers_to in zip(*[frame[c] for c in columns]):
                made = record(page_id, url, (html or "").encode(), base32(digest), refers_to, date)
                index.append(f"{name_of(page_id)}\t{size}\t{len(made)}\n")
                data.append(made)
                size += len(made)
                if size >= goal:
                    yield flush()
        if data:
            yield flush()

    columns = ["page_id", "url", "html", "_digest", "_refers_to"]
    rows = with_revisits(pages, least_bytes).select(F.col("page_id").cast("string").alias("page_id"), *columns[1:])
    (
        rows.mapInPandas(packages, "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )


def page_number(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the packages below ``path``; digests of payloads are verified."""
    listed = spark.read.format("binaryFile").load(path).select("path")
    listed = listed.repartition(spark.sparkContext.defaultParallelism, "path")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["path"]:
                with open_range(name) as source:
                    found = [row_of(r) for r in Package(source).records()]
                yield pd.DataFrame(found, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    def row_of(r: Record) -> tuple:
        kind = r.headers["warc-type"]
        digest = r.headers["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and base32(hashlib.sha1(r.payload).hexdigest()) != digest:
            raise ValueError("a payload does not have its digest")
        refers = r.headers.get("warc-refers-to")
        return (
            page_number(r.headers["warc-record-id"]),
            int(r.http["content-length"]),
            digest,
            kind,
            page_number(refers) if refers else None,
        )

    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return listed.mapInPandas(rows, schema)
