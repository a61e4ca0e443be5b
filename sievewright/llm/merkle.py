"""Merkle dataset manifest by mountain ranges over indexed partitions.

1. A row becomes a leaf (SHA-256 of its fields) where it is read; no text is
   shuffled.  Leaves are numbered within their source (``ranges``).
2. A task streams consecutive leaves through a mountain range: a stack with
   up to ``FANOUT`` pending nodes a level.  When a run is full, its hash
   carries into the level above, and its nodes leave as records.  What is
   pending where the task's leaves begin or end within a run leaves as peaks.
3. Peaks meet level by level in Spark, grouped by their parent's number, 16 at
   most in a group: runs that cross partitions, and each level's last run, get
   their hash there.  Nothing is padded.
4. Subroots are the leaves of one more tree, built by the same steps.
5. A chunk of 16**3 leaves with its node records is one group; what lies above
   a chunk is the same for all of its leaves and comes as one row.

No task holds a source.  The driver sees the number of levels only.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stage
from .ranges import ordered, placed, spans

FANOUT_BITS = 4
FANOUT = 1 << FANOUT_BITS
#: Levels within a chunk.
CHUNK = 3
#: Levels that a count of 64 bits can need.
LEVELS = 15
#: Where this divides crc32(doc_id), the row is altered before it is verified.
ALTERED = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = "key string, top int, level int, idx long, hash string, peak boolean"
_ROW = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(column: Column) -> Column:
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column) -> Column:
    """A row's digest: SHA-256 of doc_id, source, lang, n_chars and the text, each with its length."""
    return F.sha2(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)), 256)


def top_level(n: Column) -> Column:
    """The level of the root over n leaves."""
    return sum((n > F.lit(1 << (FANOUT_BITS * i))).cast("int") for i in range(LEVELS))


class Range:
    """The mountain range over consecutive leaves of one key."""

    def __init__(self, key: str, top: int, emit):
        self.key, self.top, self.emit, self.pending = key, top, emit, []

    def push(self, idx: int, digest: str) -> None:
        """The next leaf; full runs carry upwards."""
        level = 0
        while True:
            if level == len(self.pending):
                self.pending.append([])
            run = self.pending[level]
            run.append((idx, digest))
            if (idx + 1) % FANOUT:
                return
            if len(run) < FANOUT:  # the run began in another task
                self.out(level, run, True)
                run.clear()
                return
            digest = _hash("".join(d for _, d in run))
            if level:
                self.out(level, run, False)
            run.clear()
            idx, level = idx >> FANOUT_BITS, level + 1

    def out(self, level: int, run: list, peak: bool) -> None:
        self.emit.extend((self.key, self.top, level, i, d, peak) for i, d in run)

    def close(self) -> None:
        for level, run in enumerate(self.pending):
            self.out(level, run, True)
        self.pending = []


def _stack(batches):
    """(key, idx, n, top, hash) in order -> node records and peaks."""
    now, after, emit = None, -1, []

    def batch():
        columns = list(zip(*emit))
        emit.clear()
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "top", "level", "idx", "hash", "peak"])

    for piece in slices(batches, 4096):
        for key, idx, top, digest in zip(*(piece.column(c).to_pylist() for c in ("key", "idx", "top", "hash"))):
            if now is None or key != now.key or idx != after:
                if now is not None:
                    now.close()
                now = Range(key, top, emit)
            now.push(idx, digest)
            after = idx + 1
        if emit:
            yield batch()
    if now is not None:
        now.close()
    if emit:
        yield batch()


class Tree:
    """One Merkle tree a key over leaves (key, order..., hash, ...)."""

    def __init__(self, leaves: DataFrame, order: list[Column], name: str):
        table = ordered(leaves, "key", order, f"{name}-leaves")
        spanned = spans(table, "key")
        spanned = stage(spanned.withColumn("top", top_level(F.col("n"))), f"{name}-spans")
        #: leaves with idx, n and top
        self.leaves = placed(table, spanned, "key")
        #: (key, n, top)
        self.keys = spanned.select("key", "n", "top").distinct()
        self.tops = spanned.agg(F.max("top")).first()[0] or 0
        own = self.leaves.select("key", "idx", "top", "hash").sortWithinPartitions("key", "idx")
        made = stage(own.mapInArrow(_stack, _NODE), f"{name}-nodes")
        parts = [made]
        for level in range(self.tops):
            children = [p.where(F.col("peak") & (F.col("level") == level) & (F.col("top") > level)) for p in (made, *parts[1:][-1:])]
            pending = children[0] if len(children) == 1 else children[0].unionByName(children[1])
            up = F.shiftright("idx", FANOUT_BITS)
            merged = pending.groupBy("key", "top", up.alias("idx")).agg(_run().alias("run")).select(
                "key", "top", F.lit(level + 1).alias("level"), "idx", F.sha2("run", 256).alias("hash"), F.lit(True).alias("peak")
            )
            parts.append(stage(merged, f"{name}-level{level + 1}"))
        nodes = parts[0]
        for part in parts[1:]:
            nodes = nodes.unionByName(part)
        #: all node records of level 1 and above, and the leaf that is its key's only one
        self.nodes = nodes.where((F.col("level") > 0) | (F.col("top") == 0))

    def roots(self) -> DataFrame:
        """(key, hash): what remains of each key."""
        return self.nodes.where(F.col("level") == F.col("top")).select("key", "hash")

    def paths(self, rows: DataFrame, level: int, at: str) -> DataFrame:
        """rows(key, top, at: a node's number on ``level``) with ``path``: array of (slot, run) from that level to the root."""
        out = rows.withColumn("path", F.array().cast("array<struct<slot:int,run:string>>"))
        for now in range(level, self.tops):
            source = self.nodes if now else self.leaves.withColumn("level", F.lit(0))
            runs = source.where((F.col("level") == now) & (F.col("top") > now)).groupBy("key", F.shiftright("idx", FANOUT_BITS).alias("_up")).agg(_run().alias("_run"))
            here = F.shiftright(at, FANOUT_BITS * (now - level))
            step = F.struct(here.bitwiseAND(FANOUT - 1).cast("int").alias("slot"), F.col("_run").alias("run"))
            out = (
                out.withColumn("_up", F.shiftright(here, FANOUT_BITS)).join(runs, ["key", "_up"], "left")
                .withColumn("path", F.when(F.col("top") > now, F.concat("path", F.array(step))).otherwise(F.col("path"))).drop("_up", "_run")
            )
        return out


def _run() -> Column:
    """The hashes of a run (16 at most) in order, concatenated."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]), "")


def _without(run: str, slot: int) -> str:
    return run[: 64 * slot] + run[64 * slot + 64 :]


def _fold(digest: str, path: list[tuple[int, str]]) -> str:
    for slot, run in path:
        digest = _hash(run[: 64 * slot] + digest + run[64 * slot + 64 :])
    return digest


def _proofs(members: pa.Table, above: pa.Table) -> pa.Table:
    """One chunk: its leaves and inner nodes, and the row of what lies above."""
    if not members.num_rows:
        return pa.Table.from_pylist([], _arrow())
    top, subroot, root = (above.column(c)[0].as_py() for c in ("top", "subroot", "root"))
    over = [(s["slot"], s["run"]) for s in above.column("path")[0].as_py()]
    over_siblings = "".join(_without(run, slot) for slot, run in over)
    rows = sorted(zip(*(members.column(c).to_pylist() for c in ("level", "idx", "hash", "doc_id", "altered"))), key=lambda r: r[:2])
    runs: dict[tuple[int, int], list[str]] = {}
    for level, idx, digest, _, _ in rows:
        runs.setdefault((level, idx >> FANOUT_BITS), []).append(digest)
    whole = {at: "".join(run) for at, run in runs.items()}
    out = []
    for level, idx, digest, doc_id, altered in rows:
        if level:
            break
        path = [((idx >> (FANOUT_BITS * k)) % FANOUT, whole[k, idx >> (FANOUT_BITS * (k + 1))]) for k in range(min(top, CHUNK))]
        proof = _hash("".join(_without(run, slot) for slot, run in path) + over_siblings)
        folded = _fold(digest if altered is None else altered, path + over)
        out.append((doc_id, digest, subroot, root, proof, folded, folded == root))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _arrow())], schema=_arrow())


def _arrow() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in _ROW.split(", "))])


def manifest(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text, ...) -> leaf, subroot, root, proof and the altered row's verdict.

    Leaves ascend by doc_id in their source (null first; rows of one doc_id by
    their digest, so equal rows are interchangeable).  A null source is a
    source of its own, before all others; null and empty texts differ.  Rows
    whose doc_id is null are leaves like any other and never altered.  An
    empty table has no rows and no root.  Other columns are not read.
    """
    text = F.col("text").cast("string")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % ALTERED == 0
    changed = F.when(chosen & text.isNotNull(), leaf(F.translate(text, _UPPER, _LOWER)))
    leaves = docs.select(
        F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf(text).alias("hash"), changed.alias("altered"),
    )
    tree = Tree(leaves, [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()], "merkle")
    subroots = stage(tree.roots(), "merkle-subroots")
    top = Tree(subroots.select(F.lit("").alias("key"), F.col("key").alias("source_key"), "hash"), [F.col("source_key").asc()], "merkle-top")
    upper = top.paths(top.leaves.select("key", "top", "source_key", "idx"), 0, "idx").select(F.col("source_key").alias("key"), F.col("path").alias("upper"))
    root = top.roots().select(F.col("hash").alias("root"))
    chunk = FANOUT_BITS * CHUNK
    chunks = tree.keys.select("key", "top", F.explode(F.sequence(F.lit(0), F.shiftright(F.col("n") - 1, chunk))).alias("chunk"))
    above = (
        tree.paths(chunks, CHUNK, "chunk").join(upper, "key").join(subroots.withColumnRenamed("hash", "subroot"), "key").join(F.broadcast(root))
        .select("key", "chunk", "top", F.concat("path", "upper").alias("path"), "subroot", "root")
    )
    own = tree.leaves.select("key", F.shiftright("idx", chunk).alias("chunk"), F.lit(0).alias("level"), "idx", "hash", "doc_id", "altered")
    inner = tree.nodes.where((F.col("level") > 0) & (F.col("level") < F.least(F.col("top"), F.lit(CHUNK)))).select(
        "key", F.expr(f"shiftright(idx, {chunk} - {FANOUT_BITS} * level)").alias("chunk"), "level", "idx", "hash", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("altered")
    )
    return own.unionByName(inner).groupBy("key", "chunk").cogroup(above.groupBy("key", "chunk")).applyInArrow(_proofs, _ROW)


def tree_of(spark: SparkSession, leaves: DataFrame) -> DataFrame:
    """leaves(key string, doc_id long, hash string) -> (key, top, level, idx, hash) of all nodes above the leaves: the manifest's own table."""
    return Tree(leaves, [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()], "merkle").nodes.drop("peak")
