"""Media columns: Netpbm and BMP decoding, area resizing, NPY tiles, hashes.

A media column holds a picture's file bytes.  ``decode`` turns Netpbm (P1 to
P6) and uncompressed 8- and 24-bit BMP into numpy arrays; ``area_resize``
averages source areas by an integral image, with fractional borders, so its
cost doesn't depend on the scale; ``npy_bytes`` stores a tile as an NPY file;
``difference_hash`` compares neighbouring cells of a 9 x 8 reduction.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, utf8

WIDTH = 64
TILE = 16
STRIP = 4096


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP, rows from the bottom up."""
    height, width = samples.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    start = 54 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def _samples(data: bytes, kind, count: int, at: int) -> np.ndarray:
    """``count`` samples from byte ``at`` on; none if none are wanted."""
    return np.frombuffer(data, kind, count, at) if count else np.zeros(0, kind)


_HEAD = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        found = _HEAD.match(data, at)
        if not found:
            raise ValueError("broken Netpbm header")
        numbers.append(int(found[1]))
        at = found.end()
    width, height = numbers[:2]
    top = numbers[2] if len(numbers) > 2 else 1
    planes = 3 if kind in (3, 6) else 1
    n = width * height * planes
    if not 0 < top < 65_536:
        raise ValueError("maxval is 1 to 65535")
    if n > 8 * len(data):  # no form has more than eight samples a byte
        raise ValueError("short Netpbm body")
    if kind <= 3:
        body = re.sub(rb"#[^\n]*", b" ", data[at:])
        values = [c - 48 for c in body if c in b"01"] if kind == 1 else [int(x) for x in body.split()]
        flat = np.array(values[:n], np.int64) if max(values[:n], default=0) <= top else None
    elif kind == 4:
        stride = -(-width // 8)
        rows = _samples(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        flat = np.unpackbits(rows, axis=1, count=width).ravel()
    else:
        flat = _samples(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if flat is None or (flat.size and flat.max() > top):
        raise ValueError("a sample over maxval")
    if flat.size < n:
        raise ValueError("short Netpbm body")
    if kind in (1, 4):
        return ((1 - flat) * 255).astype(np.uint8).reshape(height, width)
    flat = flat if top == 255 else (flat.astype(np.float64) * 255 / top).round()
    return flat.astype(np.uint8).reshape((height, width, 3) if planes == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    (start,) = struct.unpack_from("<I", data, 10)
    size, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if packing or bits not in (8, 24):
        raise ValueError("only uncompressed 8- and 24-bit BMP")
    if width < 0:
        raise ValueError("negative BMP width")
    down, height = height < 0, abs(height)
    stride = -(-width * bits // 32) * 4
    if stride * height > len(data) or not 40 <= size <= start - 14:
        raise ValueError("broken BMP header")
    rows = _samples(data, np.uint8, stride * height, start).reshape(height, stride)
    rows = rows if down else rows[::-1]
    if bits == 24:
        return np.ascontiguousarray(rows[:, : width * 3].reshape(height, width, 3)[:, :, ::-1])
    colours = (start - 14 - size) // 4
    palette = _samples(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if rows.size and rows[:, :width].max(initial=0) >= colours:
        raise ValueError("a colour outside the palette")
    if (palette == palette[:, :1]).all():
        return palette[:, 0][rows[:, :width]]
    return palette[rows[:, :width]]


def decode(data: bytes) -> np.ndarray:
    """Picture bytes to uint8 samples, (height, width) or (height, width, 3)."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas of the source, as float64, by an integral image.

    Only the image's rows at the areas' borders are kept, and STRIP rows are
    summed at once, so memory doesn't grow with the picture's height.
    """
    tall, wide = samples.shape[:2]

    def borders_of(size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        """cells + 1 even, fractional borders: the whole part and the fraction."""
        at = np.arange(cells + 1) * size / cells
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, at - low

    low, part = borders_of(tall, height)
    wanted = np.unique(np.concatenate([low, low + 1]))
    total, above = np.zeros((len(wanted), wide + 1)), np.zeros(wide)  # the integral image's rows at borders
    for top in range(0, tall, STRIP):
        strip = samples[top : top + STRIP]
        sums = np.cumsum(strip.mean(2) if strip.ndim == 3 else strip, 0, dtype=np.float64) + above
        inside = (wanted > top) & (wanted <= top + len(strip))
        total[inside, 1:] = sums[wanted[inside] - top - 1]
        above = sums[-1]
    np.cumsum(total[:, 1:], 1, out=total[:, 1:])
    rows = total[np.searchsorted(wanted, low)] * (1 - part)[:, None] + total[np.searchsorted(wanted, low + 1)] * part[:, None]
    low, part = borders_of(wide, width)
    borders = rows[:, low] * (1 - part) + rows[:, low + 1] * part
    area = (tall / height) * (wide / width)
    return np.diff(np.diff(borders, axis=0), axis=1) / area


def npy_bytes(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, samples, allow_pickle=False)
    return out.getvalue()


def difference_hash(samples: np.ndarray) -> str:
    """16 hexadecimal digits: is each cell brighter than its right neighbour."""
    cells = area_resize(samples, 8, 9).round(6)
    return np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes().hex()


def tile(samples: np.ndarray, size: int = TILE) -> bytes:
    return npy_bytes(np.clip(area_resize(samples, size, size).round(), 0, 255).astype(np.uint8))


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes with bytes 0 up to a positive multiple of 64."""
    data = utf8(text)
    return data + b"\0" * (-len(data) % WIDTH if data else WIDTH)


def store_texts(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """docs(doc_id, text, ...) -> written table (doc_id, n_bytes, media binary).

    A row for each row; a null text is empty, and an empty one has a row of 64
    samples 0.  Null and repeated doc_ids pass through, other columns don't;
    an empty table gives an empty one.
    """
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            media = [encode(np.frombuffer(payload_of(t), np.uint8).reshape(-1, WIDTH)) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array([len(utf8(t)) for t in texts], pa.int64()), "media": pa.array(media, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(rows.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def read_media(media: DataFrame) -> DataFrame:
    """Decode stored media (doc_id, n_bytes, media) and compute features.

    ``feature`` is the difference hash, ``tile`` an NPY file of TILE x TILE
    grey samples.  Bytes that are no picture, and null media, give nulls.
    """

    def features(data: bytes | None) -> tuple:
        try:
            samples = decode(data or b"")
        except (ValueError, struct.error):  # decode() raises no other errors
            return (None,) * 7
        payload = samples.tobytes()
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(),
            difference_hash(samples) if samples.size else None, tile(samples) if samples.size else None,
        )

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(batches):
        for batch in slices(batches):
            found = list(zip(*map(features, batch.column("media").to_pylist()))) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(found, kinds))], names)

    return media.mapInArrow(run, FEATURES)


def text_media(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """Store whole texts as pictures and return what the stored bytes hold.

    One row for each row of ``docs``.  A null or empty text is 64 bytes 0.
    Null and repeated doc_ids pass through; other columns are ignored; an
    empty table gives an empty result.
    """
    return read_media(store_texts(docs, form))
