"""Hierarchical multi-length packing of token ids into sequences.

Each task packs the documents of its input partition as they stream by, so
no text or id is shuffled and memory is bounded by ``pool`` tokens:

* a document's full windows of the longest tier become sequences of their own;
* the rest is routed to the shortest tier that holds it and waits in a pool;
* a full pool is packed, longest tier first: a window is opened by the longest
  piece of its tier, and its gap is filled by the longest pieces of shorter
  tiers that fit; a gap that none fits is closed by cutting a piece, so the
  window ends exactly at its length;
* what can't fill a window of one tier forms windows of the next shorter
  tiers, each a power of two; only a partition's last few ids are padded;
* sequences of one tier are dealt into step groups of ``step`` tokens, in
  serpentine order of attention cost (the sum of squared piece lengths), so
  the steps of a pool take about equal time.

Tiers are powers of two.  The same partition always gives the same result,
which is what a repeated task needs.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import END_ID, default_path, encoder

TIERS = (1024, 512, 256, 128)
POOL = 2_000_000
STEP = 16_384
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier int, step_id long"


class Packer:
    """Packs one stream of documents; sequences come out of :meth:`rows`."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, pool: int = POOL, step: int = STEP):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
            raise ValueError("tiers: powers of two, longest first")
        self.tiers, self.pool, self.step = tiers, pool, step
        self.next_sequence = self.next_step = base
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.pieces: list[tuple[int, int, int]] = []  # length, document, start
        self.done: dict[int, list[list[tuple[int, int, int]]]] = {t: [] for t in tiers}
        self.waiting = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        top, k = self.tiers[0], len(self.docs)
        self.docs.append((doc_id, ids))
        whole = len(ids) // top * top
        self.done[top] += [[(top, k, i)] for i in range(0, whole, top)]
        if whole < len(ids):
            self.pieces.append((len(ids) - whole, k, whole))
        self.waiting += len(ids)
        if self.waiting >= self.pool:
            self.flush(False)

    def flush(self, last: bool) -> None:
        """Pack the pool; what doesn't fill a window waits on unless ``last``."""
        left = sorted(self.pieces)  # ascending: the longest is at the end
        for tier, shorter in zip(self.tiers, (*self.tiers[1:], 0)):
            total = sum(p[0] for p in left)
            while left and total >= tier and shorter < left[-1][0] <= tier:
                total -= tier
                window, gap = [left.pop()], 0
                gap = tier - window[0][0]
                while gap:
                    at = bisect_right(left, (gap, len(self.docs), 0))
                    if at:
                        piece = left.pop(at - 1)
                    else:
                        length, k, start = left.pop(0)
                        piece = (gap, k, start)
                        insort(left, (length - gap, k, start + gap))
                    window.append(piece)
                    gap -= piece[0]
                self.done[tier].append(window)
        if last:
            total = sum(p[0] for p in left)
            for tier in self.tiers:
                while total >= tier:
                    left = self._fill(tier, left)
                    total -= tier
            if left:
                self.done.setdefault(0, []).append(left)
            left = []
        self._emit()
        keep = sorted({k for _, k, _ in left})
        place = {k: i for i, k in enumerate(keep)}
        self.docs = [self.docs[k] for k in keep]
        self.pieces = [(n, place[k], s) for n, k, s in left]
        self.waiting = sum(p[0] for p in left)

    def _fill(self, tier: int, left: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        window, gap = [], tier
        while gap:
            length, k, start = left.pop()
            take = min(length, gap)
            window.append((take, k, start))
            gap -= take
            if take < length:
                left.append((length - take, k, start + take))
        self.done[tier].append(window)
        return left

    def _emit(self) -> None:
        for tier, windows in self.done.items():
            per = max(1, self.step // (tier or self.tiers[0]))
            windows.sort(key=lambda w: -sum(p[0] * p[0] for p in w))
            steps = -(-len(windows) // per)
            for i, window in enumerate(windows):
                lap, seat = divmod(i, steps)
                step = self.next_step + (seat if lap % 2 == 0 else steps - 1 - seat)
                offset, size = 0, sum(p[0] for p in window)
                for length, k, start in window:
                    doc_id, ids = self.docs[k]
                    self.out.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), self.next_sequence, offset, size, tier or self.tiers[0], step))
                    offset += length
                self.next_sequence += 1
            self.next_step += steps
        self.done = {t: [] for t in self.tiers}

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, pool: int = POOL, step: int = STEP) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each piece.

    Every id of every row, the end id included, lies in exactly one piece.  A
    null text is empty (its end id alone); a null doc_id stays null; rows that
    repeat a doc_id are packed as separate documents.  ``sequence_id`` and
    ``step_id`` are unique over the result, with gaps between partitions.
    ``tier`` is the window length that the sequence is padded to.  Other columns are
    ignored; an empty table gives an empty result.
    """
    path = tokenizer or default_path()
    types = [pa.int64()] * 8 + [pa.int32(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches):
        packer = Packer(TaskContext.get().partitionId() << 40, tiers, pool, step)
        encode = encoder(path, END_ID)
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode.each(batch.column("text"))):
                packer.add(doc_id, ids)
                if len(packer.out) >= 20_000:
                    yield table(packer.rows())
        packer.flush(True)
        if packer.out:
            yield table(packer.rows())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
