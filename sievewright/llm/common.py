"""Shared helpers of the training-data operators.

Everything an operator keeps between two jobs goes to the folder named by
``spark.checkpoint.dir``, which the driver and all executors share.  Tables
are written by Spark's own writers; binary files go through ``pyarrow.fs``,
which resolves the same URI on every executor.
"""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash.

    A temporary folder is made only where the setting is empty and the master
    is local; on a cluster an empty setting is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sievewright-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one run's data in the shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no later read needs."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def _resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri.partition("://")[2]
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def create_dir(uri: str) -> None:
    store, path = _resolve(uri)
    store.create_dir(path, recursive=True)


def open_write(uri: str) -> pa.NativeFile:
    store, path = _resolve(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def open_read(uri: str) -> pa.NativeFile:
    """A random-access file."""
    store, path = _resolve(uri)
    return store.open_input_file(path)


def put_arrays(uri: str, /, **arrays: np.ndarray) -> None:
    """Write named arrays as one file."""
    held = io.BytesIO()
    np.savez(held, **arrays)
    with open_write(uri) as out:
        out.write(held.getbuffer())


def get_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of :func:`put_arrays`."""
    with open_read(uri) as file:
        held = np.load(io.BytesIO(file.read()))
        return {k: held[k] for k in held.files}


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "replace")


_held: list = []


def held_by_worker(cached):
    """Register a cached function whose values other operators needn't keep in memory."""
    _held.append(cached)
    return cached


def release() -> None:
    """Drop what other operators left in this Python worker; workers are reused."""
    for cached in _held:
        cached.cache_clear()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own counsel


def slices(batches, rows: int = 500, most: int = 16 << 20):
    """Arrow batches in pieces of few rows, and of ``most`` bytes if they have two rows or more: only those become Python objects at once."""
    for batch in batches:
        todo = [batch.slice(low, rows) for low in range(0, batch.num_rows, rows)][::-1]
        while todo:
            piece = todo.pop()
            half = piece.num_rows // 2
            if half and piece.nbytes > most:
                todo += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece
