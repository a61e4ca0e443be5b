"""Exact embedding links by dual traversal of cover trees.

For unit vectors, cosine >= c is Euclidean distance <= sqrt(2 - 2c) = r.

1. Equal vectors become one node with a multiplicity; copies are never paired.
2. The upper level of a cover tree over a bounded sample (SAMPLE vectors, so
   the bound doesn't grow with the data) gives at most CELLS pivots.  Every
   vector joins its nearest pivot's cell; a cell is dealt into blocks of about
   ``block`` vectors.  Two cells whose pivots lie farther apart than the sum
   of their covering radii plus r share no link, and their blocks never meet.
3. Each block gets a cover tree: nested levels with halving radii, every
   node's centre also a centre of the next level (:class:`CoverTree`).  It is
   written once to the shared folder; only names of blocks are shuffled.
4. One task walks one pair of blocks' trees.  A pair of nodes is pruned when
   their centres lie farther apart than both covering radii plus r, taken
   whole when even the farthest members are within r, and else replaced by
   its children.  Leaves' members are compared exactly in double precision.

A pair of blocks returns each node's link count and a spanning forest of its
links, so the output is linear in the blocks however dense a cluster is.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get_arrays, put_arrays, release, scratch, slices, stage
from .components import Forest, connected_components

THRESHOLD = 0.95
SAMPLE = 2048
CELLS = 64
BLOCK = 4096
LEAF = 32
PAIRS = 1 << 18
SLACK = 1e-7
ROUGH = np.float32(1e-5)


def _greedy_net(points: np.ndarray, radius: float, limit: int | None = None) -> list[int]:
    """Indices of centres, 0 first, no two within ``radius``, covering all points.

    Stops early, with more than ``limit`` centres, if a limit is given.
    """
    near = 1 - radius * radius / 2
    centres = [0]
    for low in range(0, len(points), 256):
        chunk = points[low : low + 256]
        loose = np.flatnonzero((chunk @ points[centres].T).max(1) < near)
        inner = chunk[loose] @ chunk[loose].T
        alive = np.ones(len(loose), bool)
        for i in range(len(loose)):
            if alive[i]:
                centres.append(low + int(loose[i]))
                alive &= inner[i] < near
        if limit and len(centres) > limit:
            break
    return centres


def pivots(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """The finest cover-tree level of a sample that has ``cells`` centres at most."""
    level, radius = [0], 1.0
    while radius > 0.01:
        finer = _greedy_net(sample, radius, cells)
        if len(finer) > cells:
            break
        level, radius = finer, radius / 2
    return sample[level]


class CoverTree:
    """Flat arrays; a node's members are points[lo:hi], its children adjoin."""

    def __init__(self, points: np.ndarray):
        order, nodes = np.arange(len(points)), [[0, 0, len(points), 0, 0, 0.0]]
        i = 0
        while i < len(nodes):
            centre, lo, hi = nodes[i][:3]
            own = order[lo:hi]
            spread = float(np.sqrt(max(0.0, 2 - 2 * (points[own] @ points[centre]).min())))
            nodes[i][5] = spread + SLACK
            if hi - lo > LEAF and spread > SLACK:
                radius = 1.0
                while radius >= spread:
                    radius /= 2
                at = int(np.flatnonzero(own == centre)[0])
                own[[0, at]] = own[[at, 0]]
                net = _greedy_net(points[own], radius)
                owner = np.concatenate([(points[own[k : k + 1024]] @ points[own[net]].T).argmax(1) for k in range(0, len(own), 1024)])
                owner[net] = np.arange(len(net))
                placed = np.argsort(owner, kind="stable")
                centres = own[net]
                order[lo:hi] = own[placed]
                ends = lo + np.cumsum(np.bincount(owner, minlength=len(net)))
                nodes[i][3:5] = [len(nodes), len(net)]
                for c, start, end in zip(centres.tolist(), [lo, *ends[:-1].tolist()], ends.tolist()):
                    nodes.append([c, start, end, 0, 0, 0.0])
            i += 1
        self.order = order
        table = np.array([n[:5] for n in nodes], np.int64)
        self.centre, self.lo, self.hi, self.child, self.children = table.T
        self.radius = np.array([n[5] for n in nodes])

    FIELDS = ("order", "centre", "lo", "hi", "child", "children", "radius")

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.FIELDS}


class Block:
    """A tree with its points in tree order, of :meth:`CoverTree.arrays` with node, mult and points."""

    def __init__(self, held: dict[str, np.ndarray]):
        for k in CoverTree.FIELDS:
            setattr(self, k, held[k])
        self.node, self.mult, self.points = (held[k][self.order] for k in ("node", "mult", "points"))
        self.unit = self.points / np.linalg.norm(self.points, axis=1, keepdims=True)
        self.length = np.linalg.norm(self.points, axis=1)
        self.hub = self.unit[np.argsort(self.order)[self.centre]]
        self.rough = self.hub.astype(np.float32)

    def below(self, n: int) -> np.ndarray:
        return np.arange(self.child[n], self.child[n] + self.children[n]) if self.children[n] else np.array([n])


def near(one: Block, other: Block, rows: np.ndarray, cols: np.ndarray, reach: float):
    """Candidate node pairs: all whose centres may be within covers and reach.

    Nodes of like radius are taken together, so one product and one comparison
    with the widest cover of two classes leaves few pairs to look at singly.
    """
    def classes(block: Block, nodes: np.ndarray):
        kind = np.digitize(block.radius[nodes], (2 * SLACK, 0.1, 0.3, 0.6, 1.0))
        return [nodes[kind == k] for k in np.unique(kind)]

    for some in classes(one, rows):
        for others in classes(other, cols):
            widest = one.radius[some].max() + other.radius[others].max() + reach + SLACK
            least, right = np.float32(1 - widest * widest / 2), other.rough[others].T
            for low in range(0, len(some), 512):
                x, y = np.nonzero(one.rough[some[low : low + 512]] @ right >= least - ROUGH)
                yield some[low + x], others[y]


def walk(one: Block, two: Block | None, threshold: float = THRESHOLD) -> tuple[list, list]:
    """(node, links) counts and (u, v) spanning links of one pair of blocks."""
    same = two is None
    other = one if same else two
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    shift = 0 if same else len(one.points)
    trees = Forest(shift + len(other.points))
    count_a = np.zeros(len(one.points), np.int64)
    count_b = count_a if same else np.zeros(len(other.points), np.int64)
    edges: list[tuple[int, int]] = []

    def join(p: np.ndarray, q: np.ndarray) -> None:
        new = trees.join_all(p, q + shift)
        edges.extend(zip(one.node[p[new]].tolist(), other.node[q[new]].tolist()))

    def whole(a: int, b: int) -> None:
        rows, cols = np.arange(one.lo[a], one.hi[a]), np.arange(other.lo[b], other.hi[b])
        if same and a == b:
            count_a[rows] += one.mult[rows].sum() - one.mult[rows]
        else:
            count_a[rows] += other.mult[cols].sum()
            count_b[cols] += one.mult[rows].sum()
        join(rows, np.full(len(rows), cols[0]))
        join(np.full(len(cols), rows[0]), cols)

    def leaves(p: np.ndarray, q: np.ndarray) -> None:
        """All members of leaves p[i] against those of q[i], exactly."""
        n_q = other.hi[q] - other.lo[q]
        sizes = (one.hi[p] - one.lo[p]) * n_q
        ends = np.cumsum(sizes)
        low = 0
        while low < len(p):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
            n = sizes[low:high]
            pair = np.repeat(np.arange(low, high), n)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            i, k = one.lo[p[pair]] + nth // n_q[pair], other.lo[q[pair]] + nth % n_q[pair]
            cosine = np.einsum("ij,ij->i", one.points[i], other.points[k]) / (one.length[i] * other.length[k])
            hit = (cosine >= threshold) & ((i < k) if same else True)
            i, k = i[hit], k[hit]
            np.add.at(count_a, i, other.mult[k])
            np.add.at(count_b, k, one.mult[i])
            join(i, k)
            low = high

    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        if same and a == b and 2 * one.radius[a] + SLACK <= reach:
            whole(a, b)
            continue
        if not one.children[a] and not other.children[b]:
            leaves(np.array([a]), np.array([b]))
            continue
        for p, q in near(one, other, one.below(a), other.below(b), reach):
            if same and a == b:
                p, q = p[p <= q], q[p <= q]
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", one.hub[p], other.hub[q])))
            cover = one.radius[p] + other.radius[q]
            keep = apart <= cover + reach + SLACK
            full = keep & (apart + cover + SLACK <= reach)
            if same:
                full &= p != q
            for x, y in zip(p[full].tolist(), q[full].tolist()):
                whole(x, y)
            leaf = keep & ~full & (one.children[p] == 0) & (other.children[q] == 0)
            leaves(p[leaf], q[leaf])
            rest = keep & ~full & ~leaf
            todo += zip(p[rest].tolist(), q[rest].tolist())
    counts = list(zip(one.node.tolist(), count_a.tolist())) + ([] if same else list(zip(other.node.tolist(), count_b.tolist())))
    return [c for c in counts if c[1]], edges


def _vectors(table: DataFrame) -> DataFrame:
    """(vec_id, dim, v binary): v is null where a vector can't be linked."""

    def run(batches):
        for batch in slices(batches):
            held = []
            for x in batch.column("embedding").to_pylist():
                v = None if x is None or not x or any(c is None for c in x) else np.array(x, np.float64)
                usable = v is not None and np.isfinite(v).all() and v.any()
                # a power of two changes no cosine, and keeps squares from running over or under
                held.append(np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])).tobytes() if usable else None)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "dim": pa.array([None if v is None else len(v) // 8 for v in held], pa.int32()), "v": pa.array(held, pa.binary())})

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, dim int, v binary")


def _unit(data: bytes) -> np.ndarray:
    v = np.frombuffer(data, np.float64)
    return v / np.linalg.norm(v)


def links(distinct: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """distinct(node, mult, dim, v) -> rows (node, other, links).

    ``other`` is set in rows of the spanning forest, ``links`` in counts.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    sample: dict[int, list[np.ndarray]] = {}
    for r in distinct.orderBy(F.xxhash64("v")).limit(SAMPLE).select("dim", "v").collect():
        sample.setdefault(r.dim, []).append(_unit(bytes(r.v)))
    hubs = {dim: pivots(np.array(rows)) for dim, rows in sample.items()}

    def settle(batches):
        for batch in batches:
            cells, far = [], []
            for dim, v in zip(batch.column("dim").to_pylist(), batch.column("v").to_pylist()):
                near = hubs[dim] @ _unit(v) if dim in hubs else None
                cells.append(0 if near is None else int(near.argmax()))
                far.append(2.0 if near is None else float(np.sqrt(max(0.0, 2 - 2 * near.max()))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "mult", "dim", "v")), pa.array(cells, pa.int32()), pa.array(far, pa.float64())], ["node", "mult", "dim", "v", "cell", "far"])

    settled = stage(distinct.select("node", "mult", "dim", "v").mapInArrow(settle, "node long, mult long, dim int, v binary, cell int, far double"), "cover-cells")
    cells = {(r.dim, r.cell): (r.n, r.far) for r in settled.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    counts = {(dim, cell): -(-n // max(256, min(block, (4 << 20) // (8 * dim)))) for (dim, cell), (n, _) in cells.items()}
    partners: dict[tuple[int, int], list[int]] = {}
    for dim, i in cells:
        hub = hubs.get(dim)
        partners[dim, i] = [
            j for d, j in cells if d == dim and (hub is None or np.linalg.norm(hub[i] - hub[j]) <= cells[dim, i][1] + cells[dim, j][1] + reach + SLACK)
        ]
    sizes = F.create_map(*[F.lit(x) for (dim, cell), n in counts.items() for x in (f"{dim}.{cell}", n)]) if counts else F.lit(None)
    salted = settled.withColumn("s", F.pmod(F.xxhash64("v"), F.try_element_at(sizes, F.concat_ws(".", "dim", "cell"))).cast("int") if counts else F.lit(0))

    base = scratch(distinct.sparkSession, "cover-blocks")

    def deal(key, table):
        dim, cell, s = (k.as_py() for k in key)
        points = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float64).reshape(-1, dim)
        unit = points / np.linalg.norm(points, axis=1, keepdims=True)
        uri = f"{base}/{uuid.uuid4().hex}.npz"
        put_arrays(uri, node=table.column("node").to_numpy(), mult=table.column("mult").to_numpy(), points=points, **CoverTree(unit).arrays())
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "s": pa.array([s], pa.int32()), "block": [uri]})

    def compare(batches):
        release()
        at, one = None, None
        for batch in batches:
            for first, second in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
                if first != at:
                    at, one = first, Block(get_arrays(first))
                counts, edges = walk(one, None if first == second else Block(get_arrays(second)), threshold)
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array([n for n, _ in counts] + [u for u, _ in edges], pa.int64()),
                    "other": pa.array([None] * len(counts) + [v for _, v in edges], pa.int64()),
                    "links": pa.array([c for _, c in counts] + [None] * len(edges), pa.int64()),
                })
        release()

    spark = distinct.sparkSession
    blocks = stage(salted.groupBy("dim", "cell", "s").applyInArrow(deal, "dim int, cell int, s int, block string"), "cover-deal")
    near_cells = spark.createDataFrame([(d, i, j) for (d, i), js in partners.items() for j in js if i <= j], "dim int, cell int, other int")
    one = blocks.join(near_cells, ["dim", "cell"]).select("dim", "cell", "s", F.col("other").alias("cell2"), F.col("block").alias("one"))
    two = blocks.select("dim", F.col("cell").alias("cell2"), F.col("s").alias("s2"), F.col("block").alias("two"))
    pairs = stage(one.join(two, ["dim", "cell2"]).where("cell < cell2 or s <= s2").select("one", "two"), "cover-pairs")
    n = pairs.count()
    parts = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), min(n // 8, 20_000))
    return pairs.repartition(parts, "one", "two").sortWithinPartitions("one").mapInArrow(compare, "node long, other long, links long")


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """table(vec_id, embedding, ...) -> (vec_id, n_links, component_id, kept).

    One row for each row.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and so do vectors of different
    lengths.  Rows repeating a vec_id are separate vectors.  ``component_id``
    is the smallest vec_id reachable; null only where no reachable row has
    one, and ``kept`` is false there.  Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = stage(_vectors(table), "cover-vectors")
    distinct = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("dim").alias("dim"))
    distinct = stage(distinct.withColumn("node", F.monotonically_increasing_id()), "cover-distinct")
    found = stage(links(distinct, threshold, block), "cover-links")
    member = connected_components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    joined = member.join(distinct.select("node", "rep"), "node")
    root = joined.groupBy("root").agg(F.min("rep").alias("component"))
    grouped = joined.join(root, "root").select("node", "component")
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    label = distinct.join(grouped, "node", "left").join(counts, "node", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = rows.join(label, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
