"""Conversation prefix trie with a pointer-jumping rollup.

1. Turns become digests where they are read, and get their number within the
   conversation from range partitions (``ranges``), so a long conversation is
   never one task's work.
2. A prefix's digest is a sum, over its turns, of 64-bit hashes of (position,
   turn), in two lanes.  Sums need no order: blocks of ``BLOCK`` turns are
   summed on their own, then shifted by what the blocks before them sum to.
3. Equal digests of one depth are one node, made by partial aggregation; its
   parent's digest is its own less the last turn's hash.
4. Rollup: with S(v) the sum over v's descendants less than 2**k levels below
   and jump(u) the ancestor 2**k levels up, a round adds every S(u) to
   S(jump(u)) and replaces jump by jump of jump.  After log2(depth) rounds
   every ancestor has its whole subtree.  A round costs one aggregation and
   two joins by digest, however deep the trie is.
5. Ids of conversations that end at a node are joined into pieces of text in
   range partitions; one hash runs over a node's pieces, in order.

Main path: DataFrame functions, but for the hash of member ids (3 MB of text
or 10 GB, it streams through one hash object, which SQL doesn't have).
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import slices, stage
from .ranges import ordered, placed, spans

#: Turns of one window of sums.
BLOCK = 1024
#: Conversations of one template: an id less its remainder by this names the template.
TEMPLATE = 100
#: The template's first turns come first in every one of its conversations: crc32(id) % HEADS of them.
HEADS = 6
#: Characters of a piece of joined ids.
PIECE = 32_768

_LANES = ("a", "b")
_NODE = ["depth", *_LANES]


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps (role, text) apart."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations(conv_id, turn, role, text) -> turns in order, and their spans."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("x"), F.char_length(text).cast("long").alias("chars")
    )
    table = ordered(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("x").asc()], "trie-turns")
    return table, stage(spans(table, "conv_id"), "trie-spans")


def rebuilt(table: DataFrame, spanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of :func:`numbered_turns` -> (conv_id, pos, x, chars), and (conv_id, turns): one row a conversation, turnless ones included.

    A conversation gets the first h turns of its template's conversation (all
    if it has fewer, none if it is absent), then its own turns after the first
    h; h = crc32(id) % HEADS.
    """
    convs = spanned.select("conv_id", "n").distinct()
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    template = F.col("conv_id") - F.col("conv_id") % TEMPLATE
    sizes = convs.where(F.col("conv_id") % TEMPLATE == 0).select(F.col("conv_id").alias("_from"), F.col("n").alias("_has"))
    led = convs.select("conv_id", "n", heads.alias("h"), template.alias("_from")).join(sizes, "_from", "left")
    led = stage(led.select("conv_id", "_from", "n", "h", F.least("h", F.coalesce("_has", F.lit(0))).alias("m")), "trie-heads")
    own = placed(table, spanned.join(led.select("conv_id", "h", "m"), "conv_id"), "conv_id")
    own = own.where(F.col("idx") >= F.col("h")).select("conv_id", (F.col("idx") - F.col("h") + F.col("m")).alias("pos"), "x", "chars")
    first = placed(table, spanned.where(F.col("conv_id") % TEMPLATE == 0), "conv_id").where(F.col("idx") < HEADS - 1)
    taken = led.where("m > 0").select("conv_id", "_from", "m").join(first.select(F.col("conv_id").alias("_from"), F.col("idx").alias("pos"), "x", "chars"), "_from")
    turns = own.unionByName(taken.where(F.col("pos") < F.col("m")).select("conv_id", "pos", "x", "chars"))
    return turns, led.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"))


def _wrapped(total: Column) -> Column:
    """A sum of longs, held as a decimal, as a long again: modulo 2**64."""
    whole, half = (F.lit(str(1 << bits)).cast("decimal(20,0)") for bits in (64, 63))
    low = F.pmod(total, whole)
    return F.when(low >= half, low - whole).otherwise(low).cast("long")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, x, chars) -> (conv_id, depth, a, b, pa, pb, chars): each prefix's digest and its parent's."""
    wide = "decimal(38,0)"
    lanes = {"a": F.xxhash64("pos", "x"), "b": F.xxhash64(F.lit("second lane"), "x", "pos")}
    hashed = turns.select("conv_id", "pos", "chars", F.floor(F.col("pos") / BLOCK).alias("_block"), *(v.cast(wide).alias(f"_{k}") for k, v in lanes.items()))
    upto = Window.partitionBy("conv_id", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = hashed.select("*", *(F.sum(f"_{k}").over(upto).alias(f"_in_{k}") for k in _LANES))
    later = hashed.groupBy("conv_id", "_block").agg(*(F.sum(f"_{k}").alias(f"_{k}") for k in _LANES))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = later.select("conv_id", "_block", *(F.sum(f"_{k}").over(before).alias(f"_by_{k}") for k in _LANES)).where("_block > 0")
    whole = {k: F.col(f"_in_{k}") + F.coalesce(f"_by_{k}", F.lit(0).cast(wide)) for k in _LANES}
    return inner.join(shift, ["conv_id", "_block"], "left").select(
        "conv_id", (F.col("pos") + 1).cast("long").alias("depth"), *(_wrapped(whole[k]).alias(k) for k in _LANES), *(_wrapped(whole[k] - F.col(f"_{k}")).alias(f"p{k}") for k in _LANES), "chars"
    )


def rollup(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes(depth, a, b, pa, pb, values...) -> (depth, a, b, values...): summed over each node's subtree.

    Rounds of doubled jumps; their number is the logarithm of the largest
    depth, which is all that the driver sees.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = nodes.select(*_NODE, *values)
    jumps = nodes.where("depth > 0").select(*_NODE, F.col("pa").alias("ja"), F.col("pb").alias("jb"))
    reach = 1
    while reach <= deepest:
        far = jumps.join(sums, _NODE).groupBy((F.col("depth") - reach).alias("depth"), F.col("ja").alias("a"), F.col("jb").alias("b")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        sums = sums.join(far, _NODE, "left").select(*_NODE, *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values))
        sums = stage(sums, "trie-sums")
        if 2 * reach <= deepest:
            over = jumps.select((F.col("depth") + reach).alias("depth"), F.col("a").alias("ja"), F.col("b").alias("jb"), F.col("ja").alias("_ja"), F.col("jb").alias("_jb"))
            jumps = stage(jumps.where(F.col("depth") >= 2 * reach).join(over, ["depth", "ja", "jb"]).select(*_NODE, F.col("_ja").alias("ja"), F.col("_jb").alias("jb")), "trie-jumps")
        reach *= 2
    return sums


def _pieces(batches):
    """(depth, a, b, conv_id) in order -> (depth, a, b, first, piece): ids joined by commas."""
    now, ids, size = None, [], 0

    def piece():
        return [*now, ids[0], ",".join(map(str, ids))]

    for batch in slices(batches, 8192):
        out = []
        for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "conv_id"))):
            if node != now or size > PIECE:
                if ids:
                    out.append(piece())
                now, ids, size = node, [], 0
            ids.append(conv)
            size += len(str(conv)) + 1
        if out:
            yield _batch(out, ["depth", "a", "b", "first", "piece"])
    if ids:
        yield _batch([piece()], ["depth", "a", "b", "first", "piece"])


def _digests(batches):
    """Pieces in order -> (depth, a, b, ends_sha256)."""
    now, running = None, None
    for batch in slices(batches, 64):
        out = []
        for *node, piece in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "piece"))):
            if node != now:
                if running is not None:
                    out.append([*now, running.hexdigest()])
                now, running = node, hashlib.sha256()
            else:
                running.update(b",")
            running.update(piece.encode())
        if out:
            yield _batch(out, ["depth", "a", "b", "ends_sha256"])
    if running is not None:
        yield _batch([[*now, running.hexdigest()]], ["depth", "a", "b", "ends_sha256"])


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def ends_digest(ends: DataFrame) -> DataFrame:
    """ends(depth, a, b, conv_id) -> (depth, a, b, ends_sha256) over the ids in ascending order."""
    dealt = ends.select(*_NODE, "conv_id").repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    pieces = stage(dealt.mapInArrow(_pieces, "depth long, a long, b long, first long, piece string"), "trie-pieces")
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> one row for each distinct prefix of the rebuilt conversations.

    Rows without a conv_id belong to no conversation and are passed over.
    Null turns come first; turns of one number are ordered by the digest of
    role and text, so equal rows are interchangeable.  Null role and text are
    empty.  The textless root has all conversations, turnless ones included;
    an empty table has no root.  Repeated rows are turns of their own.  Other
    columns are not read.  Columns: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns, lengths = rebuilt(*numbered_turns(conversations))
    steps = stage(prefixes(turns), "trie-steps")
    lengths = stage(lengths, "trie-lengths")
    zero = F.lit(0).cast("long")
    inner = steps.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"), F.first("pa").alias("pa"), F.first("pb").alias("pb"))
    root = lengths.groupBy(zero.alias("depth"), zero.alias("a"), zero.alias("b")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).withColumns({"chars": zero, "pa": zero, "pb": zero})
    nodes = stage(inner.unionByName(root), "trie-nodes")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    children = nodes.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _NODE, "left").select(
        *nodes.columns, F.coalesce("n_children", zero).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    nodes = stage(nodes, "trie-counted")
    sums = rollup(nodes, ["n_leaves", "saved_tokens"])
    over = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    last = steps.join(lengths.withColumnRenamed("turns", "depth"), ["conv_id", "depth"]).select(*_NODE, "conv_id")
    turnless = lengths.where("turns = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id")
    ends = ends_digest(stage(last.unionByName(turnless), "trie-ends"))
    return (
        nodes.drop("n_leaves", "saved_tokens").join(over, ["depth", "pa", "pb"], "left").join(sums, _NODE).join(ends, _NODE, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    )
