"""SimHash near-duplicates by tiled exact comparison.

1. Every whole text gets a fingerprint: of 64 bits (:func:`fingerprints`), or
   of 256 bits over its set of shingles (:func:`keep_one`).
2. Distinct fingerprints fall into bands by the population counts of their two
   halves; a band is dealt into blocks of about ``block`` fingerprints.  Two
   fingerprints within ``radius`` bits have halves whose population counts
   differ by ``radius`` at most in sum, so only blocks of such neighbouring
   bands are paired.  A block is written once to the shared folder, and only
   the names of a pair's two blocks are shuffled.
3. One task compares one pair of blocks after another, tile against tile, by
   numpy exclusive-or and bit counts.  Tiles whose population-count bounds (of
   four words) are farther apart than the radius are skipped.  A pair gives a
   spanning forest of its links, so a dense cluster of n fingerprints gives
   fewer than n edges and loses no connection.
4. The links' connected components name the groups.

:func:`keep_one` pairs its wide fingerprints by bands of least hashes instead
of tiles, so its work grows with the texts and their likeness and not with
the square of the texts.  A link must also have an exact Jaccard similarity
of its two whole shingle sets.  Sets lie in the shared folder, written by the
task that makes them; a comparing task reads those of fingerprints within the
radius that nothing has connected yet.

The driver sees the histogram of population counts alone, whose size doesn't
depend on the data.  Equal fingerprints, or sets, are one node, so exact
copies, however many, are compared once.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from .common import discard, get_arrays, held_by_worker, open_read, open_write, put_arrays, release, scratch, slices, stage, utf8
from .components import Forest, connected_components

RADIUS = 3
SHINGLE = 3
BLOCK = 8_192
TILE = 512
#: Of :func:`keep_one`: words of a shingle, least similarity, 64-bit words of a fingerprint, and the radius.  A bit of
#: two sets of that similarity differs with a probability of 3/16 at most (four shingles of five; less for larger sets),
#: so of 256 bits 48 are expected and 80 are five standard deviations off; unlike texts differ in 128.
SET_SHINGLE = 5
SIMILAR = (4, 5)
WIDE = 4
WIDE_RADIUS = 80
#: Bands of least hashes, and hashes of a band: sets of similarity 0.8 have no band in common with a probability of
#: (1 - 0.8 ** 4) ** 28, four in ten million.
BANDS, BAND = 28, 4

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_HIGH = ~np.uint64((1 << 24) - 1)
_LEAST = np.random.default_rng(43).integers(0, 1 << 31, BANDS * BAND, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ODD = (np.random.default_rng(42).integers(0, 1 << 63, 16 + WIDE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Of hashes (m, w) of 64-bit words: the w words whose bits are set in over half of the rows."""
    octets = hashes.astype("<u8", copy=False).view(np.uint8).reshape(len(hashes), -1)
    width = octets.shape[1]
    counts = np.bincount((octets + np.arange(width) * 256).ravel(), minlength=width * 256).reshape(width, 256)
    return np.packbits((counts @ _BITS).ravel() * 2 > len(hashes), bitorder="little").view("<u8")


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text; null or wordless: 0.

    Words are runs without ASCII white space, A-Z in lower case.  Each shingle
    of ``shingle`` words, repeats included, is hashed by XXH64 with seed 42; a
    bit is 1 if over half of the hashes have it.
    """
    words = utf8(text).lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    hashes = np.fromiter(map(digest, map(b" ".join, zip(*(words[i:] for i in range(shingle)))), repeat(42)), np.uint64)
    return int(majority(hashes[:, None])[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp long); one row for each row."""

    def run(batches):
        release()
        for batch in slices(batches):
            fps = np.fromiter((simhash(t, shingle) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def shingle_set(text: str | None, size: int = SET_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles, 40 bits each; none if wordless.

    Words are those of :func:`simhash`; a text of ``size`` words or fewer is
    one shingle.
    """
    words = utf8(text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i : i + n]) * _ODD[i % 16]
        out ^= out >> np.uint64(29)
    return np.unique(out & _HIGH)


def wide_print(members: np.ndarray) -> np.ndarray:
    """The 256-bit fingerprint of a set, as WIDE words; zero for the empty set."""
    if not len(members):
        return np.zeros(WIDE, np.uint64)
    mixed = (members ^ (members >> np.uint64(33)))[:, None] * _ODD[16:]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[0]
    return majority(mixed ^ (mixed >> np.uint64(32)))


def band_keys(members: np.ndarray) -> np.ndarray:
    """Names of a set's bands, BANDS signed longs; none for the empty set.  A band is BAND least hashes of the set."""
    if not len(members):
        return np.empty(0, np.int64)
    mixed = (((members ^ (members >> np.uint64(33))) * _ODD[1]) >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND, 0xFFFFFFFF, np.uint32)
    for low in range(0, len(mixed), 512):
        np.minimum(least, (_LEAST[:, None] * mixed[low : low + 512]).min(1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND).T.astype(np.uint64):
        out = (out ^ column) * _ODD[2]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def node_of(members: np.ndarray) -> int:
    """The signed 64-bit name of a set; of the empty set: 0."""
    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), 42)).view(np.int64)) if len(members) else 0


def similar_sets(a: np.ndarray, b: np.ndarray, similar: tuple[int, int]) -> bool:
    """Is the Jaccard similarity of two sorted sets ``similar`` or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * similar[1] >= (len(a) + len(b) - both) * similar[0]


class Block:
    """Fingerprints (n, w), their nodes and, if sets are to be compared, the sets' places."""

    def __init__(self, prints: np.ndarray, node: np.ndarray, uris=(), uri: np.ndarray | None = None, at: np.ndarray | None = None, n: np.ndarray | None = None):
        words = np.bitwise_count(prints.view("<u2") if prints.shape[1] == 1 else prints).astype(np.int64)
        order = np.lexsort(words.T[::-1])
        words = words[order]
        self.prints, self.node = prints[order], node[order]
        self.uris, self.uri, self.at, self.n = uris, *(None if x is None else x[order] for x in (uri, at, n))
        self.cuts = [(i, min(i + TILE, len(order))) for i in range(0, len(order), TILE)]
        self.low = np.array([words[i:j].min(0) for i, j in self.cuts])
        self.high = np.array([words[i:j].max(0) for i, j in self.cuts])

    def members(self, i: int) -> np.ndarray:
        return _read_set(str(self.uris[self.uri[i]]), int(self.at[i]), int(self.n[i]))


@held_by_worker
@functools.lru_cache(maxsize=32)
def _open_sets(uri: str):
    return open_read(uri)


@held_by_worker
@functools.lru_cache(maxsize=64)
def _read_set(uri: str, at: int, n: int) -> np.ndarray:
    octets = np.zeros((n, 8), np.uint8)
    octets[:, 3:] = np.frombuffer(_open_sets(uri).read_at(5 * n, at), np.uint8).reshape(n, 5)
    return octets.view("<u8").ravel()


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each of a (m, w) and each of b (n, w)."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, a.shape[1]):
        out = np.add(out, np.bitwise_count(a[:, None, k] ^ b[None, :, k]), dtype=np.uint16)
    return out


def link_blocks(one: Block, two: Block | None, radius: int = RADIUS, similar: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (node, node) within ``one``, or between it and ``two``."""
    same = two is None
    other = one if same else two
    shift = 0 if same else len(one.node)
    trees = Forest(shift + len(other.node))
    us, vs = [], []

    def join(x: np.ndarray, y: np.ndarray) -> None:
        new = trees.join_all(x, y + shift)
        us.append(one.node[x[new]])
        vs.append(other.node[y[new]])

    def join_similar(x: np.ndarray, y: np.ndarray) -> None:
        """Join the similar ones: in each turn a spanning forest of what is still apart is compared."""
        n, m = one.n[x].astype(np.int64), other.n[y].astype(np.int64)
        fits = np.minimum(n, m) * similar[1] >= np.maximum(n, m) * similar[0]
        x, y = x[fits], y[fits]
        while len(x):
            p, q = trees.roots(x.copy()), trees.roots(y + shift)
            open_ = p != q
            x, y, p, q = x[open_], y[open_], p[open_], q[open_]
            if not len(x):
                break
            names, place = np.unique(np.concatenate([p, q]), return_inverse=True)
            tried = Forest(len(names)).join_all(place[: len(p)], place[len(p) :])
            hit = [similar_sets(one.members(i), other.members(k), similar) for i, k in zip(x[tried].tolist(), y[tried].tolist())]
            join(x[tried][hit], y[tried][hit])
            x, y = np.delete(x, tried), np.delete(y, tried)

    for s, (i, j) in enumerate(one.cuts):
        apart = np.maximum(np.maximum(other.low - one.high[s], one.low[s] - other.high), 0).sum(1)
        for t in np.flatnonzero(apart <= radius):
            if same and t < s:
                continue
            k, m = other.cuts[t]
            x, y = np.nonzero(_distance(one.prints[i:j], other.prints[k:m]) <= radius)
            if same and s == t:
                x, y = x[x < y], y[x < y]
            if len(x):
                (join if similar is None else join_similar)(x + i, y + k)
    return np.concatenate([np.empty(0, np.int64), *us]), np.concatenate([np.empty(0, np.int64), *vs])


def _layout(histogram: dict[tuple[int, int], int], block: int, radius: int) -> tuple[int, dict[tuple[int, int], int]]:
    """How many counts a band spans in each half, and the blocks of each band.

    Bands are as narrow as lets them fill a quarter of a block on average, but
    a quarter of the radius at least; this settles how much is compared, never
    what is linked.
    """
    width, total = max(1, radius // 4), sum(histogram.values())
    while True:
        bands = Counter()
        for (a, b), n in histogram.items():
            bands[a // width, b // width] += n
        if len(bands) < 2 or len(bands) * block <= 4 * total:
            return width, {k: -(-n // block) for k, n in bands.items()}
        width *= 2


def _offsets(radius: int, width: int) -> list[tuple[int, int]]:
    """One of each pair of opposite band offsets that the radius can span, (0, 0) first."""
    def gap(d: int) -> int:
        return max(0, (abs(d) - 1) * width + 1) if d else 0

    reach = range(-(radius // width) - 1, radius // width + 2)
    near = [(a, b) for a in reach for b in reach if gap(a) + gap(b) <= radius]
    return [(0, 0)] + [d for d in near if d > (0, 0)]


def links(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK, similar: tuple[int, int] | None = None) -> DataFrame:
    """nodes(node long, p0 long, ...) without repeats -> (u, v) spanning links of nodes.

    p0, p1, ... are a fingerprint's words, one or an even number.  With
    ``similar``, ``nodes`` also has its sets' places: uri, at and n.
    """
    spark = nodes.sparkSession
    base = scratch(spark, "simhash-blocks")
    words = sorted((c for c in nodes.columns if c[0] == "p" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    if len(words) == 1:
        halves = F.bit_count(F.shiftrightunsigned("p0", 32)), F.bit_count(F.col("p0").bitwiseAND(F.lit(0xFFFFFFFF)))
    else:
        middle = len(words) // 2
        halves = [functools.reduce(lambda x, y: x + y, [F.bit_count(c) for c in part]) for part in (words[:middle], words[middle:])]
    banded = nodes.select("*", *(h.cast("int").alias(c) for h, c in zip(halves, "ab")))
    width, counts = _layout({(r.a, r.b): r.n for r in banded.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}, block, radius)
    many = [x for (a, b), n in counts.items() if n > 1 for x in (a * 512 + b, n)]
    a, b = (F.floor(F.col(c) / width).cast("int") for c in "ab")
    dealt = banded.withColumns({"a": a, "b": b})
    parts = F.coalesce(F.try_element_at(F.create_map(*map(F.lit, many)), F.col("a") * 512 + F.col("b")), F.lit(1)) if many else F.lit(1)
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("node"), parts).cast("int"))

    def deal(key, table):
        uri = f"{base}/{uuid.uuid4().hex}.npz"
        held = {"prints": np.stack([table.column(c).to_numpy() for c in words], 1).view(np.uint64), "node": table.column("node").to_numpy()}
        if similar is not None:
            uris, own = np.unique(np.array(table.column("uri").to_pylist(), str), return_inverse=True)
            held |= {"uris": uris, "uri": own, "at": table.column("at").to_numpy(), "n": table.column("n").to_numpy()}
        put_arrays(uri, **held)
        return pa.table({"a": [key[0].as_py()], "b": [key[1].as_py()], "s": [key[2].as_py()], "block": [uri]}, pa.schema([("a", pa.int32()), ("b", pa.int32()), ("s", pa.int32()), ("block", pa.string())]))

    written = stage(dealt.groupBy("a", "b", "s").applyInArrow(deal, "a int, b int, s int, block string"), "simhash-deal")
    return compare_blocks(written, _offsets(radius, width), Block, lambda one, two: link_blocks(one, two, radius, similar))


def compare_blocks(written: DataFrame, offsets: list[tuple[int, int]], load: Callable, compare: Callable) -> DataFrame:
    """written(a, b, s, block): blocks s of bands (a, b) -> (u, v) of all pairs of blocks of bands ``offsets`` apart."""
    near = written.withColumn("d", F.explode(F.array(*(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b")) for x, y in offsets))))
    near = near.select((F.col("a") + F.col("d.a")).alias("a"), (F.col("b") + F.col("d.b")).alias("b"), F.col("s").alias("t"), F.col("block").alias("one"), ((F.col("d.a") == 0) & (F.col("d.b") == 0)).alias("own"))
    pairs = stage(near.join(written, ["a", "b"]).where("not own or t <= s").select("one", F.col("block").alias("two")), "block-pairs")

    def run(batches):
        release()
        at, block = None, None
        for batch in batches:
            for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
                if one != at:
                    at, block = one, load(**get_arrays(one))
                u, v = compare(block, None if one == two else load(**get_arrays(two)))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        release()

    n = pairs.count()
    parts = max(1, min(n, int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))), min(n // 8, 20_000))
    return pairs.repartition(parts, "one", "two").sortWithinPartitions("one").mapInArrow(run, "u long, v long")


def link_unlike(rows: dict[str, np.ndarray], one: np.ndarray, two: np.ndarray, radius: int, similar: tuple[int, int], most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (node, node) between places ``one`` and ``two`` of ``rows`` that have unlike roots.

    Sets are read in slices of about ``most`` members; one set is then
    intersected with all its candidates of a slice at once.
    """
    names, group = np.unique(rows["root"], return_inverse=True)
    trees, us, vs = Forest(len(names)), [], []

    def members(k: int) -> np.ndarray:
        return _read_set(str(rows["uri"][k]), int(rows["at"][k]), int(rows["n"][k]))

    def compare(left: np.ndarray, right: np.ndarray) -> None:
        sizes = rows["n"][right]
        sets = [members(k) for k in right.tolist()]
        known, ids = np.unique(np.concatenate(sets), return_inverse=True)
        ids = np.split(ids, np.cumsum(sizes)[:-1])
        step = max(1, (4 << 20) // len(right))
        for low in range(0, len(left), step):
            part = left[low : low + step]
            n = rows["n"][part][:, None]
            fits = (group[part][:, None] != group[right]) & (np.minimum(n, sizes) * similar[1] >= np.maximum(n, sizes) * similar[0])
            fits &= _distance(rows["prints"][part], rows["prints"][right]) <= radius
            for i in np.flatnonzero(fits.any(1)).tolist():
                x, near = int(part[i]), np.flatnonzero(fits[i])
                near = near[trees.roots(group[right[near]]) != trees.roots(group[[x]])]
                if not len(near):
                    continue
                own = members(x)
                place = np.searchsorted(known, own)
                place[place == len(known)] = 0
                held = np.zeros(len(known), np.int64)
                held[place[known[place] == own]] = 1
                both = np.add.reduceat(held[np.concatenate([ids[k] for k in near.tolist()])], np.cumsum(sizes[near]) - sizes[near])
                near = right[near[both * similar[1] >= (len(own) + sizes[near] - both) * similar[0]]]
                near = near[trees.join_all(np.full(len(near), group[x]), group[near])]
                us.append(np.full(len(near), rows["node"][x]))
                vs.append(rows["node"][near])

    own = group[one] == np.bincount(group).argmax()
    for left, right in ((one[~own], two), (one[own], two[group[two] != np.bincount(group).argmax()])):
        right = right[rows["n"][right] > 0]  # the empty set is like no other
        if len(left) and len(right):
            for piece in np.split(right, np.flatnonzero(np.diff(np.cumsum(rows["n"][right]) // most)) + 1):
                compare(left, piece)
    return np.concatenate([np.empty(0, np.int64), *us]), np.concatenate([np.empty(0, np.int64), *vs])


def set_links(nodes: DataFrame, radius: int = WIDE_RADIUS, similar: tuple[int, int] = SIMILAR, block: int = BLOCK) -> DataFrame:
    """nodes(node, p0.., uri, at, n, keys) without repeats -> (u, v) links that connect all similar sets that share a band.

    1. Every set is compared with the smallest node of each of its bands.
    2. Bands that still hold unlike components are compared whole, pairs of
       one component left out, in pairs of pieces of about ``block`` sets.
    """
    words = [f"p{k}" for k in range(WIDE)]
    band = Window.partitionBy("key")
    keyed = nodes.select("node", F.explode("keys").alias("key")).withColumns({"lead": F.min("node").over(band), "size": F.count("*").over(band)})
    shared = stage(keyed.where("size > 1"), "simhash-bands")
    place = nodes.drop("keys")
    side = lambda k: place.select(*(F.col(c).alias(f"{c}_{k}") for c in place.columns))
    apart = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{c}_1").bitwiseXOR(F.col(f"{c}_2"))) for c in words])
    fits = F.least("n_1", "n_2") * similar[1] >= F.greatest("n_1", "n_2") * similar[0]
    stars = shared.where("lead <> node").select(F.col("lead").alias("node_1"), F.col("node").alias("node_2")).distinct()
    stars = stars.join(side(1), "node_1").join(side(2), "node_2").where((apart <= radius) & fits)

    def judge(batches):
        release()
        for batch in batches:
            a, b = (zip(*(batch.column(f"{c}_{k}").to_pylist() for c in ("uri", "at", "n"))) for k in (1, 2))
            hit = pa.array([similar_sets(_read_set(*x), _read_set(*y), similar) for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node_1"), batch.column("node_2")], ["u", "v"]).filter(hit)
        release()

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stage(stars.repartition(parts, "node_1").sortWithinPartitions("node_1").mapInArrow(judge, "u long, v long"), "simhash-stars")
    root = connected_components(found).select("node", "root")
    unlike = shared.where("size > 2").join(root, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    unlike = unlike.withColumns({"low": F.min("root").over(band), "high": F.max("root").over(band)}).where("low <> high").join(place, "node")
    pieces = F.ceil(F.col("size") / block).cast("int")
    dealt = unlike.withColumns({"pieces": pieces, "s": F.pmod(F.xxhash64("node"), pieces).cast("int")}).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = dealt.withColumns({"one": F.least("s", "t"), "two": F.greatest("s", "t")}).drop("t", "pieces", "size", "low", "high")

    def compare(key, table):
        rows = {c: table.column(c).to_numpy() for c in ("node", "root", "at", "n", "s")} | {"uri": table.column("uri").to_numpy(zero_copy_only=False)}
        rows["prints"] = np.stack([table.column(c).to_numpy() for c in words], 1).view(np.uint64)
        u, v = link_unlike(rows, *(np.flatnonzero(rows["s"] == k.as_py()) for k in key[1:]), radius, similar)
        return pa.table({"u": u, "v": v})

    return found.unionByName(stage(dealt.groupBy("key", "one", "two").applyInArrow(compare, "u long, v long"), "simhash-unlike"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fingerprint, component_id), a row for each row.

    ``component_id`` is the smallest doc_id that links reach; null only where
    no row of the component has a doc_id.  Null and empty texts have the
    fingerprint zero and are linked like others.  Rows that repeat a doc_id
    are separate nodes.  Other columns of ``docs`` are ignored.  An empty
    table gives an empty result.
    """
    marked = stage(fingerprints(docs, shingle), "simhash")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    member = connected_components(stage(links(distinct.select(F.col("fp").alias("node"), F.col("fp").alias("p0")), radius, block), "simhash-links"))
    joined = member.join(distinct, member.node == distinct.fp).select("root", "fp", "rep")
    root = joined.groupBy("root").agg(F.min("rep").alias("component"))
    grouped = joined.select("root", "fp").join(root, "root").select("fp", "component")
    label = distinct.join(grouped, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_sets(docs: DataFrame, shingle: int, base: str) -> DataFrame:
    """(row struct of the columns of docs, doc_id, place, node, p0.., uri, at, n, keys), written; sets go to files in ``base``."""
    places = ["node", *(f"p{k}" for k in range(WIDE)), "uri", "at", "n", "keys"]

    def run(batches):
        release()
        uri, seen, end = f"{base}/{uuid.uuid4().hex}.sets", {}, 0
        out = open_write(uri)
        for batch in slices(batches):
            found = []
            for text in batch.column("text").to_pylist():
                members = shingle_set(text, shingle)
                node = node_of(members)
                if node not in seen:
                    seen[node] = (node, *wide_print(members).view(np.int64).tolist(), uri, end, len(members), band_keys(members).tolist())
                    end += out.write(members.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes())  # the upper 40 bits
                found.append(seen[node])
            kinds = [pa.int64()] * (1 + WIDE) + [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", "place")), *(pa.array(c, t) for c, t in zip(zip(*found), kinds))], ["row", "doc_id", "place", *places]
            )
        out.close()
        release()

    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("place"), F.col("text").cast("string").alias("text"),
    )
    schema = rows.drop("text").schema
    for c in places:
        schema = schema.add(c, {"uri": StringType(), "keys": ArrayType(LongType())}.get(c, LongType()))
    return stage(rows.mapInArrow(run, schema), "simhash-rows")


def keep_one(docs: DataFrame, shingle: int = SET_SHINGLE, similar: tuple[int, int] = SIMILAR, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near duplicates.

    Texts are linked if their sets of ``shingle``-word shingles have a Jaccard
    similarity of ``similar`` or more: 256-bit fingerprints within WIDE_RADIUS
    bits that share a band are candidates, whole sets decide.  Texts without words (null and
    empty ones too) are one group.  Of a group's rows that with the smallest
    doc_id stays, nulls last; of rows that repeat it, one.  A group is told by
    its texts alone, so rows of unlike texts that repeat a doc_id all stay.
    Columns pass through unchanged, whatever their names; an empty table gives
    an empty result.
    """
    base = scratch(docs.sparkSession, "simhash-sets")
    rows = _with_sets(docs, shingle, base)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    places = F.struct("uri", "at", "n", *(f"p{k}" for k in range(WIDE)), "keys")
    distinct = stage(rows.groupBy("node").agg(F.min(places).alias("x"), F.min(first).alias("first")), "simhash-sets-distinct")
    found = stage(set_links(distinct.select("node", "x.*"), WIDE_RADIUS, similar, block), "simhash-set-links")
    discard(docs.sparkSession, base)  # the links are written: nothing reads sets any more
    member = connected_components(found)
    lead = distinct.select("node", "first").join(member, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    # always the same kind of join: what it moves then grows with the input, not by a step
    kept = stage(lead.select(F.col("first.place").alias("place")), "simhash-kept").hint("merge")
    return rows.select("row", "place").join(kept, "place", "left_semi").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
