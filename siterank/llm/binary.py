"""Token ids as binary files with Elias-Fano encoded document boundaries.

A file holds one array of ids and, for the documents in it, two monotone sequences
in Elias-Fano form: the document ids and the offsets at which the documents begin.
A sequence of n values below u takes about n * (2 + log2(u / n)) bits, and ``select``
finds one value through sampled positions without a table of 64-bit offsets.

Layout, all numbers little-endian::

    8s magic | u8 bytes per id | u64 file number | u64 documents | u64 of them without
    document id | i64 smallest document id | u64 ids | u64 length of each of the two
    sequences | sequence of document ids | sequence of offsets | ids | newline

The newline is there so that Spark's own text writer can write the file, to any
store Spark can write to, with its commit protocol: a lost task leaves no part of a
file behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siterank.llm.tables import slices

MAGIC = b"IDSEF\x00\x00\x01"
HEAD = struct.Struct("<8sBQQQqQQQ")
SEQUENCE = struct.Struct("<QQB")
#: One in so many values has the place of its upper bit stored.
SAMPLE = 256


def elias_fano(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of unsigned 64-bit values, encoded."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    upper = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(upper[-1]) + 1 if n else 0, np.uint8)
    bits[upper] = 1
    lower = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    return b"".join(
        [
            SEQUENCE.pack(n, len(bits), low),
            upper[::SAMPLE].astype("<u8").tobytes(),
            np.packbits(lower.astype(np.uint8).ravel(), bitorder="little").tobytes(),
            np.packbits(bits, bitorder="little").tobytes(),
        ]
    )


class EliasFano:
    """Reader of an encoded sequence; it keeps only the encoded bytes."""

    def __init__(self, data: bytes):
        self.n, bits, self.low = SEQUENCE.unpack_from(data)
        samples = -(-self.n // SAMPLE)
        at = SEQUENCE.size
        self.samples = np.frombuffer(data, "<u8", samples, at)
        at += 8 * samples
        size = -(-self.n * self.low // 8)
        self.lower = np.frombuffer(data, np.uint8, size, at)
        self.upper = np.frombuffer(data, np.uint8, -(-bits // 8), at + size)

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int, j: int) -> np.ndarray:
        first = i * self.low
        bits = np.unpackbits(self.lower[first // 8 : -(-j * self.low // 8)], bitorder="little")
        bits = bits[first % 8 :][: (j - i) * self.low].reshape(j - i, self.low).astype(np.uint64)
        return (bits << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value ``i``: from the last sample before it, one block of upper bits is scanned."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = i // SAMPLE
        start = int(self.samples[k])
        end = int(self.samples[k + 1]) if k + 1 < len(self.samples) else len(self.upper) * 8
        bits = np.unpackbits(self.upper[start // 8 : -(-end // 8)], bitorder="little")
        place = start // 8 * 8 + int(np.flatnonzero(bits[start % 8 :])[i % SAMPLE]) + start % 8
        return (place - i << self.low) | int(self._low(i, i + 1)[0])

    def values(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[: self.n]
        upper = (places - np.arange(self.n)).astype(np.uint64)
        return (upper << np.uint64(self.low)) | self._low(0, self.n)


def file_bytes(number: int, doc_ids: list[int | None], tokens: list[bytes], width: int) -> bytes:
    """One file: documents in order, those without id first, ids in ``width`` bytes each."""
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    offsets = np.concatenate([[0], np.cumsum([len(t) // width for t in tokens])]).astype(np.uint64)
    ids = elias_fano(known.astype(np.uint64) - np.uint64(base & (1 << 64) - 1))
    bounds = elias_fano(offsets)
    head = HEAD.pack(
        MAGIC, width, number, len(doc_ids), len(doc_ids) - len(known), base, int(offsets[-1]), len(ids), len(bounds)
    )
    return b"".join([head, ids, bounds, *tokens, b"\n"])


class TokenFile:
    """A file of ids read by ranges: the head and the two sequences at once, ids as asked for."""

    def __init__(self, source):
        self.source = source
        head = HEAD.unpack(self.read(0, HEAD.size))
        if head[0] != MAGIC:
            raise ValueError("not a file of token ids")
        _, self.width, self.number, self.n_docs, self.n_nulls, base, self.n_ids, a, b = head
        self.bounds = EliasFano(self.read(HEAD.size + a, b))
        self.ids_at = HEAD.size + a + b
        steps = EliasFano(self.read(HEAD.size, a)).values()
        known = (steps + np.uint64(base & (1 << 64) - 1)).astype(np.int64)
        self.doc_ids: list[int | None] = [None] * self.n_nulls + known.tolist()

    def read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def document(self, i: int) -> np.ndarray:
        """The ids of document ``i`` alone, found with two selects and one ranged read."""
        start, end = self.bounds.select(i), self.bounds.select(i + 1)
        data = self.read(self.ids_at + start * self.width, (end - start) * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype(np.uint32)


def open_range(path: str):
    """A seekable file of any store that Arrow knows by its address."""
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def write_token_files(
    docs: DataFrame,
    path: str,
    make_encoder: Callable[[], Callable[[list[str]], list[bytes]]],
    width: int,
    file_bytes_goal: int = 16 << 20,
) -> None:
    """Encode ``(doc_id, text)`` and write the ids in ascending order of document id.

    The rows are range-partitioned by id, so partitions are numbered in order; a task
    cuts its sorted rows into files of about ``file_bytes_goal`` and holds one file at
    a time.  ``make_encoder`` is called once per task and returns a function from texts
    to ids in ``width`` little-endian bytes each.  Null texts count as empty, null ids
    come first; equal ids keep no order among themselves.
    """

    def files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, made = make_encoder(), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        tokens: list[bytes] = []
        held = 0

        def flush():
            nonlocal doc_ids, tokens, held, made
            data = file_bytes((part << 32) + made, doc_ids, tokens, width)
            doc_ids, tokens, held, made = [], [], 0, made + 1
            return pd.DataFrame({"value": [data[:-1]]})  # the writer ends it

        for frame in slices(frames, "text", 4 << 20):
            for doc_id, ids in zip(frame["doc_id"].tolist(), encode(frame["text"].tolist())):
                doc_ids.append(None if doc_id is None or doc_id != doc_id else int(doc_id))
                tokens.append(ids)
                held += len(ids)
                if held >= file_bytes_goal:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("decimal(20,0)").cast("string").alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
        .select(F.col("id").alias("doc_id"), "text")
    )
    (
        ordered.mapInPandas(files, "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    Files are listed by Spark without their content and read by ranges in the tasks.
    ``start`` adds what all files of lower number hold.
    """
    listed = spark.read.format("binaryFile").load(path).select("path")
    listed = listed.repartition(spark.sparkContext.defaultParallelism, "path")

    def documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["path"]:
                with open_range(name) as source:
                    file = TokenFile(source)
                    bounds = file.bounds.values().astype(np.int64)
                    data = file.read(file.ids_at, file.n_ids * file.width)
                ids = np.frombuffer(data, f"<u{file.width}").astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pd.DataFrame(
                    {
                        "file": file.number,
                        "doc_id": pd.array(file.doc_ids, "Int64"),
                        "at": bounds[:-1],
                        "n_tokens": np.diff(bounds),
                        "ids_crc32": sums,
                        "file_ids": file.n_ids,
                    }
                )

    schema = "file long, doc_id long, at long, n_tokens long, ids_crc32 long, file_ids long"
    return listed.mapInPandas(documents, schema)


def with_starts(read: DataFrame) -> DataFrame:
    """Global offsets: one row per file is summed up in order and joined to its documents."""
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        read.groupBy("file")
        .agg(F.first("file_ids").alias("file_ids"))
        .select("file", F.coalesce(F.sum("file_ids").over(earlier), F.lit(0)).alias("base"))
    )
    return read.join(bases, "file").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
