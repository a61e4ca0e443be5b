"""Order-preserving deduplication.

Row i is accepted if no earlier accepted row conflicts with it: the first
maximal independent set of a conflict graph in input order.  The graph's edges
are built by equi-joins, and rounds decide rows whose earlier neighbours are
decided.  Every round is written to the checkpoint folder.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import reads_alike
from ..functions.text import comparison_text



def first_by(rows: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """The first row of each key in input order; with map-side combination."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in rows.columns])


def accept_greedily(rows: DataFrame, edges: DataFrame, order: str = "ord") -> DataFrame:
    """Accepted rows.  edges(hi, lo): row hi conflicts with the earlier row lo.

    Rows without an edge are accepted at once.  A round settles at least the
    earliest open rows, so a chain of any length comes to its end.
    """
    edges = edges.where("hi > lo").distinct()
    rejected, open_edges = None, edges.checkpoint()
    while not open_edges.isEmpty():
        waiting = open_edges.select(F.col("hi").alias("id")).distinct()
        # earlier rows with no open edge of their own are accepted: what conflicts with them is out
        free = open_edges.join(waiting, open_edges.lo == waiting.id, "left_anti")
        out = free.select(F.col("hi").alias("id")).distinct().checkpoint()
        rejected = out if rejected is None else rejected.unionByName(out)
        left = open_edges.join(out, open_edges.hi == out.id, "left_anti")
        open_edges = left.join(out, left.lo == out.id, "left_anti").checkpoint()
    return rows if rejected is None else rows.join(rejected.select(F.col("id").alias(order)), order, "left_anti")


def accept_by_keys(rows: DataFrame, keys, order: str = "ord") -> DataFrame:
    """Accepted rows where equal values of any key conflict; null keys don't.

    A round accepts the rows that are first among the undecided in all their
    keys and rejects those that share a key with them.  It groups by key and
    never pairs rows, so a hot key costs its rows, not their square.
    """
    bare = rows.select(F.col(order).alias("o"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    undecided, accepted = bare.checkpoint(), None
    while not undecided.isEmpty():
        marked = undecided
        for i in range(len(keys)):
            head = undecided.groupBy(f"k{i}").agg(F.min("o").alias(f"m{i}"))
            marked = marked.join(head, f"k{i}", "left")
        first = [F.col(f"k{i}").isNull() | (F.col("o") == F.col(f"m{i}")) for i in range(len(keys))]
        new = marked.where(F.expr("true") if not first else _all(first)).select("o", *[f"k{i}" for i in range(len(keys))]).checkpoint()
        accepted = new.select("o") if accepted is None else accepted.unionByName(new.select("o"))
        undecided = undecided.join(new.select("o"), "o", "left_anti")
        for i in range(len(keys)):
            undecided = undecided.join(new.select(f"k{i}").where(F.col(f"k{i}").isNotNull()).distinct(), f"k{i}", "left_anti")
        undecided = undecided.select(bare.columns).checkpoint()
    return rows.limit(0) if accepted is None else rows.join(accepted.select(F.col("o").alias(order)), order, "left_semi").select(rows.columns)


def _all(conditions):
    return reduce(lambda a, b: a & b, conditions)


def exact_deduplicate(rows: DataFrame, url: str = "canonical_url", content: str = "content_hash", order: str = "ord") -> DataFrame:
    """Keep a row unless its URL or its content hash was already accepted."""
    return accept_by_keys(rows, (url, content), order)


#: Counts of characters a text, bits of its q-gram sketch and of its shorter one, and rows that are compared with a block at once.
LETTERS, BITS, SHORT, ROWS = 32, 1 << 14, 1 << 12, 64


def _least(q: int, threshold: float, whole):
    """q-grams that texts of ``whole`` characters together share at least if they are alike (see :func:`candidate_pairs`)."""
    return threshold * whole / 2 - ((q - 1) * ((1 - threshold) * whole + 1) if q > 1 else 0)


def _sketch(text: str, q: int) -> tuple[bytes, bytes, int]:
    """Counts of characters by code, the bits of its q-grams (with their number if repeated), and how many grams share a bit."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = np.bincount(codes % LETTERS, minlength=LETTERS)
    size = max(0, len(codes) - q + 1)
    grams = np.zeros(size, dtype=np.uint64)
    for i in range(q):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + size]
    grams.sort()
    place = np.arange(size, dtype=np.uint64)
    first = np.maximum.accumulate(np.where(np.r_[True, grams[1:] != grams[:-1]][:size], place, 0).astype(np.uint64)) if size else place
    named = (grams + (place - first) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
    named = (named ^ (named >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
    bits = np.zeros(BITS, dtype=bool)
    bits[named % np.uint64(BITS)] = True
    return letters.clip(0, 255).astype(np.uint8).tobytes(), np.packbits(bits).tobytes(), size - int(bits.sum())


def _sketches(file: str) -> dict[str, np.ndarray]:
    store, path = pafs.FileSystem.from_uri(file)
    with store.open_input_file(path) as source:
        rows = pq.ParquetFile(source).read()
    wide = {c: np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=kind).reshape(rows.num_rows, -1) for c, kind in (("letters", np.uint8), ("bits", np.uint64))}
    return _shortened(wide | {c: np.array(rows.column(c)) for c in ("o", "n", "lost")})


def _shortened(block: dict) -> dict:
    """``block`` with shorter sketches, made by folding the bits, the grams that share a bit there, and the counts of each character in a row."""
    short = np.bitwise_or.reduce(block["bits"].reshape(len(block["n"]), BITS // SHORT, SHORT // 64), axis=1)
    folded = np.bitwise_count(block["bits"]).sum(axis=1, dtype=np.int64) - np.bitwise_count(short).sum(axis=1, dtype=np.int64)
    return block | {"short": short, "short lost": block["lost"] + folded, "counts": np.ascontiguousarray(block["letters"].T.astype(np.int16))}


def _meet(one: dict, two: dict, same: bool, threshold: float, q: int, most: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of two blocks' rows that no bound rules out.

    Sums of counts with signs differ no more than the counts do: rows are
    sorted by such a sum, one that tells languages apart, and only rows with
    sums near enough are compared.  Counts of characters come first, in pieces
    that stay in the processor's cache, then short sketches, then long ones.
    """
    signs = np.where(np.linalg.eigh(np.atleast_2d(np.cov(one["counts"])))[1][:, -1] < 0, -1, 1) if len(one["n"]) > 1 else np.ones(LETTERS)
    sums, others = signs @ one["counts"], signs @ two["counts"]
    here, there = np.argsort(sums), np.argsort(others)
    sums, others, n, m = sums[here], others[there], one["n"][here], two["n"][there]
    used = [(x[here], y[there]) for x, y in zip(one["counts"], two["counts"]) if x.any() or y.any()]
    apart, step, found = np.empty(ROWS * len(n), dtype=np.int16), np.empty(ROWS * len(n), dtype=np.int16), []
    for top in range(0, len(m), ROWS):
        rows = slice(top, min(top + ROWS, len(m)))
        longest = int(n.max()) + int(m[rows].max())
        far = longest - 2 * _least(1, threshold, longest) + 1e-6
        near = slice(*np.searchsorted(sums, (others[rows][0] - far, others[rows][-1] + far)))
        shape = (rows.stop - rows.start, near.stop - near.start)
        total, difference = (x[: shape[0] * shape[1]].reshape(shape) for x in (apart, step))
        total[:] = 0
        for x, y in used:
            np.subtract(x[None, near], y[rows, None], out=difference)
            np.abs(difference, out=difference)
            np.add(total, difference, out=total)
        whole = n[None, near] + m[rows, None]
        right, left = np.nonzero(total <= whole - 2 * _least(1, threshold, whole) + 1e-6)
        left, right = here[left + near.start], there[right + top]
        if same:
            left, right = left[left < right], right[left < right]
        for low in range(0, len(left), most):
            i, k = left[low : low + most], right[low : low + most]
            for bits, lost in (("short", "short lost"), ("bits", "lost")):
                common = np.bitwise_count(one[bits][i] & two[bits][k]).sum(axis=1, dtype=np.uint16) + np.minimum(one[lost][i], two[lost][k])
                kept = common >= _least(q, threshold, one["n"][i] + two["n"][k]) - 1e-6
                i, k = i[kept], k[kept]
            found.append((i, k))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *(i for i, _ in found)]), np.concatenate([none, *(k for _, k in found)])


def candidate_pairs(sized: DataFrame, threshold: float = 0.92, block: int = 4096) -> DataFrame:
    """(hi, lo) of rows(o, t, n) whose distinct texts may be alike: none is missed.

    A pair of similarity t has matching blocks of t * T / 2 characters, T being
    both lengths, and (1 - t) * T characters outside them, which bounds the
    number of blocks.  So it shares t * T / 2 characters, counted by code, and
    t * T / 2 - (q - 1) * ((1 - t) * T + 1) q-grams at least.  Grams that share
    a bit of a sketch are added to what two sketches have in common, so these
    bounds are upper ones.  Texts are written once, in blocks by length, and
    blocks meet whose lengths allow the similarity: all such pairs of texts are
    looked at, by a few byte operations each.
    """
    from ..sources.store import scratch  # which needs unique_violations from here

    spark = sized.sparkSession
    q = next(k for k in (5, 4, 3, 2, 1) if k == 1 or threshold / 2 - (k - 1) * (1 - threshold) > 0.1)
    reach = (2 - threshold) / threshold  # the longest partner's length over one's own
    ranges: list[list[int]] = []  # shortest, longest, rows
    for n, rows in sorted(map(tuple, sized.groupBy("n").count().collect())):
        if ranges and ranges[-1][2] + rows <= block:
            ranges[-1][1:] = [n, ranges[-1][2] + rows]
        else:
            ranges.append([n, n, rows])
    if not ranges:
        return sized.select(F.col("o").alias("hi"), F.col("o").alias("lo"))
    dealt = spark.createDataFrame([(i, low, high, -(-rows // block)) for i, (low, high, rows) in enumerate(ranges)], "range int, low int, high int, parts int")

    def draw(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                letters, bits, lost = zip(*(_sketch(t, q) for t in part.column("t").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("o"), part.column("n"), pa.array(letters, pa.binary()), pa.array(bits, pa.binary()), pa.array(lost, pa.int32())], ["o", "n", "letters", "bits", "lost"])

    path = scratch(spark, "sketches")
    drawn = sized.select(F.col("o").cast("long").alias("o"), "n", "t").repartition(_tasks(spark), "o").mapInArrow(draw, "o long, n int, letters binary, bits binary, lost int")
    dealt = drawn.join(F.broadcast(dealt), (F.col("n") >= F.col("low")) & (F.col("n") <= F.col("high"))).withColumn("part", F.pmod(F.xxhash64("o"), "parts"))
    dealt.select("o", "n", "letters", "bits", "lost", "range", "part").repartition("range", "part").write.partitionBy("range", "part").parquet(path)
    files = sorted((int(re.search(r"range=(\d+)", f)[1]), f) for f in spark.read.parquet(path).inputFiles())
    pairs = [(a, b) for i, (x, a) in enumerate(files) for y, b in files[i:] if ranges[y][0] <= ranges[x][1] * reach + 1e-6]

    def compare(batches):
        held, last = None, None
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                held, last = (held, last) if a == last else (_sketches(a), a)
                other = held if a == b else _sketches(b)
                left, right = _meet(held, other, a == b, threshold, q)
                one, two = held["o"][left], other["o"][right]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two)), pa.array(held["n"][left] > BITS // 16)], ["hi", "lo", "full"])

    parts = min(len(pairs), max(_tasks(spark), len(pairs) // 32))
    found = spark.createDataFrame(pairs, "a string, b string").repartitionByRange(parts, "a", "b").mapInArrow(compare, "hi long, lo long, full boolean").checkpoint()
    # long texts fill their sketches: their grams are counted
    return found.where("not full").select("hi", "lo").unionByName(_alike(found.where("full"), sized, threshold, 0.0, bounds_only=True))


def _tasks(spark) -> int:
    """How many tasks work on few but costly rows, which Spark would put together by their size."""
    return spark.sparkContext.defaultParallelism * 4


def _sized(rows: DataFrame, text: str, order: str) -> DataFrame:
    return rows.select(F.col(order).alias("o"), F.col(text).alias("t"), F.length(text).alias("n")).where("n > 0")


def _alike(pairs: DataFrame, sized: DataFrame, threshold: float, containment: float, bounds_only: bool = False) -> DataFrame:
    """The candidates (hi, lo) that read alike, or that the matcher's own bounds don't rule out."""
    left, right = (sized.select(F.col("o").alias(o), F.col("t").alias(t)) for o, t in (("hi", "later"), ("lo", "earlier")))
    texts = pairs.join(left, "hi").join(right, "lo").repartition(_tasks(pairs.sparkSession), "hi", "lo")
    # a deterministic filter would be pushed below the repartition, into a join's few tasks
    return texts.where(reads_alike(threshold, containment, bounds_only).asNondeterministic()("later", "earlier")).select("hi", "lo")


def similar_pairs(rows: DataFrame, threshold: float = 0.92, containment: float = 0.45, text: str = "compared", order: str = "ord") -> DataFrame:
    """(hi, lo) of all pairs of distinct texts that read alike, exactly; see :func:`candidate_pairs`."""
    sized = _sized(rows, text, order).checkpoint()
    return _alike(candidate_pairs(sized, threshold), sized, threshold, containment)


def fuzzy_deduplicate(rows: DataFrame, threshold: float = 0.92, containment: float = 0.45, title: str = "title", abstract: str = "abstract", order: str = "ord") -> DataFrame:
    """Keep a row unless it reads like an earlier accepted one.

    Rows are compared by title and 500 characters of abstract, as (later row,
    earlier row).  A round accepts the rows with no open candidate before them
    and hands only pairs with an accepted row to the matcher: of a group of
    like texts the matcher sees about one pair a text.  Candidates that aren't
    alike would make a round a row, so a round that leaves most pairs open is
    the last of this kind: the matcher sees the rest at once, and later rounds
    have pairs that read alike only.
    """
    compared = rows.withColumn("compared", comparison_text(F.col(title), F.col(abstract)))
    once = first_by(compared.select("compared", order), "compared", order=order).checkpoint()  # equal texts: only the first can stay
    sized = _sized(once, "compared", order)
    rejected, open_pairs, matched = None, candidate_pairs(sized, threshold).checkpoint(), False
    many = open_pairs.count()
    while many:
        waiting = open_pairs.select(F.col("hi").alias("id")).distinct()
        free = open_pairs.join(waiting, open_pairs.lo == waiting.id, "left_anti")
        out = (free if matched else _alike(free, sized, threshold, containment)).select(F.col("hi").alias("id")).distinct().checkpoint()
        rejected = out if rejected is None else rejected.unionByName(out)
        left = open_pairs.join(waiting, open_pairs.lo == waiting.id, "left_semi")
        left = left.join(out, left.hi == out.id, "left_anti")
        open_pairs = left.join(out, left.lo == out.id, "left_anti").checkpoint()
        before, many = many, open_pairs.count()
        if not matched and many > before / 2:
            open_pairs, matched = _alike(open_pairs, sized, threshold, containment).checkpoint(), True
            many = open_pairs.count()
    kept = once if rejected is None else once.join(rejected.select(F.col("id").alias(order)), order, "left_anti")
    return rows.join(kept.select(order), order, "left_semi")


def unique_violations(rows: DataFrame, keys) -> DataFrame:
    """(key, value, n) of values that a unique key holds more than once."""
    parts = [rows.groupBy(F.col(k).cast("string").alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(k).alias("key"), "value", "n") for k in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_round(rows: DataFrame) -> DataFrame:
    """Of each (query, chunk) the best score; the earlier round on ties."""
    return rows.groupBy("query_id", "chunk_id").agg(F.max(F.struct("score", (-F.col("round")).alias("r"))).alias("b")).select("query_id", "chunk_id", F.col("b.score").alias("score"), (-F.col("b.r")).alias("round"))
