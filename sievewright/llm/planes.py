"""Token ids on disk: bit- or byte-plane shuffled chunks under zstandard.

A file holds a run of documents in ascending doc_id order::

    magic | chunk planes ... | document table | JSON footer | footer length | magic

A chunk is ``chunk`` consecutive ids (the last one may be shorter).  Its ids
are split into planes: in ``byte`` mode plane k holds byte k of each id, in
``bit`` mode bit k of each id, eight ids to a byte.  Each plane is compressed
by zstandard alone; a plane of zeros takes no bytes.  The footer's chunk index
has each chunk's place, its id count and its planes' sizes, so any range of
ids is read by decompressing only the chunks that hold it.  The document table
has doc_ids and token counts.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_read, open_write, scratch, stage
from .tokens import END_ID, default_path, encoder

MAGIC = b"SVPLANE1"
CHUNK = 65_536
FILE_IDS = 64_000_000
NO_ID = -(1 << 63)


def split_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Planes of an id block, lowest first; zero planes are empty."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        planes = np.ascontiguousarray(octets.T)
    else:
        planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in planes]


def join_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    """The ids of :func:`split_planes`."""
    width = n if mode == "byte" else -(-n // 8)
    full = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(width, np.uint8) for p in planes])
    if mode == "byte":
        return np.ascontiguousarray(full.T).view("<u4").ravel()
    bits = np.unpackbits(full, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()


class PlaneWriter:
    """Writes one file; :meth:`add` takes documents in order."""

    def __init__(self, uri: str, mode: str = "byte", chunk: int = CHUNK, level: int = 1):
        if mode not in ("bit", "byte"):
            raise ValueError(f"unknown plane mode: {mode}")
        self.uri, self.mode, self.chunk = uri, mode, chunk
        self.file = open_write(uri)
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.index, self.docs, self.counts = [], [], []
        self.wait, self.waiting, self.total = [], 0, 0
        self.at = self.file.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self.total += len(ids)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.chunk:
            ids = np.concatenate(self.wait)
            whole = len(ids) // self.chunk * self.chunk
            for i in range(0, whole, self.chunk):
                self._put(ids[i : i + self.chunk])
            self.wait, self.waiting = [ids[whole:].copy()], len(ids) - whole

    def _put(self, ids: np.ndarray) -> None:
        packed = [self.zstd.compress(p) if p else b"" for p in split_planes(ids, self.mode)]
        self.index.append([self.at, len(ids), [len(p) for p in packed]])
        for p in packed:
            self.at += self.file.write(p)

    def close(self) -> None:
        if self.waiting:
            self._put(np.concatenate(self.wait))
        table = self.zstd.compress(np.array(self.docs, "<i8").tobytes() + np.array(self.counts, "<i8").tobytes())
        footer = json.dumps({"mode": self.mode, "chunk": self.chunk, "index": self.index, "docs": [self.at, len(self.docs), len(table)], "ids": self.total}).encode()
        self.file.write(table)
        self.file.write(footer)
        self.file.write(struct.pack("<Q", len(footer)) + MAGIC)
        self.file.close()


class PlaneReader:
    """Random access to one file."""

    def __init__(self, uri: str):
        self.file = open_read(uri)
        size = self.file.size()
        length, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"not a plane file: {uri}")
        self.footer = json.loads(self.file.read_at(length, size - 16 - length))
        self.zstd = zstandard.ZstdDecompressor()
        self.starts = np.cumsum([0] + [n for _, n, _ in self.footer["index"]])

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        at, n, size = self.footer["docs"]
        both = np.frombuffer(self.zstd.decompress(self.file.read_at(size, at)), "<i8")
        return both[:n], both[n:]

    def read_chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.footer["index"][k]
        packed, planes, p = self.file.read_at(sum(sizes), at), [], 0
        for size in sizes:
            planes.append(self.zstd.decompress(packed[p : p + size]) if size else b"")
            p += size
        return join_planes(planes, n, self.footer["mode"])

    def read(self, start: int, length: int) -> np.ndarray:
        """Ids start..start+length of the file."""
        first = int(np.searchsorted(self.starts, start, "right")) - 1
        parts, k = [], first
        while k < len(self.footer["index"]) and self.starts[k] < start + length:
            parts.append(self.read_chunk(k))
            k += 1
        ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        skip = start - int(self.starts[first])
        return ids[skip : skip + length]

    def close(self) -> None:
        self.file.close()


def _ranges(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """``rows`` with ``_range``, ascending with doc_id, and how many ranges there are.

    The bounds are quantiles of doc_id, from a scan of that column alone;
    nulls share the first range.
    """
    wanted = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, wanted)), 100 * parts).alias("q")).first().q if wanted else None
    bounds = sorted({float(x) for x in found or []})
    if not bounds:
        return rows.withColumn("_range", F.lit(0)), 1
    splits = [float("-inf"), *bounds, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_key", outputCol="_range", handleInvalid="keep")
    dealt = cut.transform(rows.withColumn("_key", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))).drop("_key")
    return dealt.withColumn("_range", F.col("_range").cast("int")), len(splits) - 1


def write_planes(docs: DataFrame, tokenizer: str | None = None, mode: str = "byte", chunk: int = CHUNK, file_ids: int = FILE_IDS, parts: int | None = None) -> DataFrame:
    """Tokenize and write ``docs`` in ascending doc_id order; the manifest.

    The manifest (part int, file int, uri string, n_docs long, n_ids long) is
    the commit: a lost or repeated task leaves files that no manifest row
    names.  Documents are dealt by doc_id ranges; of equal doc_ids, texts
    decide the order.  A null doc_id comes first, a null text is empty.
    """
    spark = docs.sparkSession
    base, path = scratch(spark, "planes"), tokenizer or default_path()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        part, count, writer = TaskContext.get().partitionId(), 0, None
        encode = encoder(path, END_ID)
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.each(batch.column("text"))):
                if writer is None:
                    writer = PlaneWriter(f"{base}/part-{part:06d}-{count:04d}-{uuid.uuid4().hex}.planes", mode, chunk)
                writer.add(doc_id, ids)
                if writer.total >= file_ids:
                    writer.close()
                    yield _entry(part, count, writer)
                    writer, count = None, count + 1
        if writer is not None:
            writer.close()
            yield _entry(part, count, writer)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt, parts = _ranges(rows, parts)
    ordered = dealt.repartitionById(parts, "_range").drop("_range").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return stage(ordered.mapInArrow(run, "part int, file int, uri string, n_docs long, n_ids long"), "planes-manifest")


def _entry(part: int, count: int, w: PlaneWriter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([count], pa.int32()), "uri": [w.uri], "n_docs": [len(w.docs)], "n_ids": [w.total]})


def read_planes(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from a manifest's files.

    ``start`` counts the ids of all documents before one: a running sum over
    the manifest, which has a row for each file of FILE_IDS ids.
    """
    from pyspark.sql import Window

    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))

    def run(batches):
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist()):
                reader = PlaneReader(uri)
                ids, counts = reader.documents()
                starts = np.cumsum(counts) - counts
                for k in range(0, len(ids), 4096):
                    low, size = int(starts[k]), int(counts[k : k + 4096].sum())
                    block = reader.read(low, size).astype("<u4", copy=False)
                    at = starts[k : k + 4096] - low
                    crc = [zlib.crc32(block[i : i + n]) for i, n in zip(at.tolist(), counts[k : k + 4096].tolist())]
                    own = ids[k : k + 4096]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own, mask=own == NO_ID), "start": starts[k : k + 4096] + first, "n_tokens": counts[k : k + 4096], "ids_crc32": pa.array(crc, pa.int64())})
                reader.close()

    return placed.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` as plane files and return what the files hold.

    One row for each row of ``docs``; nulls, ties and empty texts as in
    :func:`write_planes`.  Other columns are ignored; an empty table gives an
    empty result.
    """
    return read_planes(write_planes(docs, **options))
