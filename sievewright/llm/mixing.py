"""Mixing sources to target weights over a domain-language-source tree.

1. Tokens (white-space words) of every leaf are counted.
2. The budget flows down the tree in proportion to weights.  Where a leaf
   holds fewer tokens than its share, even with ``epochs`` passes over it, the
   shortage goes to its siblings first, by their weights; what they can't take
   goes to the parent's siblings, and so on up (:func:`allocate`).
3. Each leaf gives whole epochs first and then a prefix of one more epoch, in
   an order seeded by the epoch's number, until its budget is met.  A document is taken if the tokens before
   it are fewer than the budget.

The prefix needs no global sort and no task that holds a leaf: documents fall
into 65,536 hash ranges of each leaf, running sums over the ranges find the
one range in which a leaf's budget ends, and only that range is ordered.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

LEVELS = ("domain", "lang", "source")
EPOCHS = 1
SHARE = 0.8
SEED = 17
DOMAINS = 4
_SELF = object()


def domain_of(column: str = "source"):
    """The default domain of a source: one of DOMAINS, by its name's crc32."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(DOMAINS)))


def tokens_of(column: str = "text"):
    """White-space separated words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def allocate(leaves: dict[tuple, int], total: float, weights: dict[tuple, float] | None = None, epochs: int = EPOCHS) -> dict[tuple, float]:
    """Budget of each leaf.

    leaves: path -> tokens held.  weights: path of a node -> its weight among
    its siblings; a node without one weighs 1.  A leaf whose path goes on in
    other leaves' paths stands beside these, with weight 1.  The budgets sum to
    ``total``, or to all that ``epochs`` passes hold where that is less.
    """
    weights = weights or {}
    inner = {path[:n] for path in leaves for n in range(len(path))}
    children: dict[tuple, dict[tuple, None]] = {}
    capacity: dict[tuple, float] = {}
    for path in sorted(leaves, key=lambda p: [(x is None, str(x)) for x in p]):
        full = (*path, _SELF) if path in inner else path
        for n in range(len(full) + 1):
            capacity[full[:n]] = capacity.get(full[:n], 0) + leaves[path] * epochs
            if n:
                children.setdefault(full[: n - 1], {})[full[:n]] = None
    out: dict[tuple, float] = {}

    def share(node: tuple, budget: float) -> None:
        below = list(children.get(node, ()))
        if not below:
            out[node[:-1] if node and node[-1] is _SELF else node] = budget
            return
        given, open_ = {}, below
        while open_:
            weight = sum(weights.get(c, 1.0) for c in open_)
            part = {c: budget * weights.get(c, 1.0) / weight if weight > 0 else budget / len(open_) for c in open_}
            short = {c for c in open_ if capacity[c] <= part[c]}
            if not short:
                given |= part
                break
            for c in short:
                given[c] = capacity[c]
            budget = max(0.0, budget - sum(capacity[c] for c in open_ if c in short))
            open_ = [c for c in open_ if c not in short]
        for c in below:
            share(c, given[c])

    if leaves:
        share((), min(float(total), float(capacity[()])))
    return out


def mix(docs: DataFrame, weights: dict[tuple, float] | None = None, share: float = SHARE, total: int | None = None, epochs: int = EPOCHS, seed: int = SEED, domain=None) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) -> the chosen rows.

    Columns: those of ``docs``, whatever their names, then mix_domain,
    mix_tokens and mix_epoch (a row appears once for each epoch that takes
    it); columns of ``docs`` with these three names are left out.  ``total``
    defaults to ``share`` of all tokens.  ``weights`` are by path: (domain,),
    (domain, lang) or (domain, lang, source); None stands for a null there,
    which is a node of its own, apart from the text "null".  A null doc_id is
    ordered by its text; a text without words has no tokens and follows the
    prefix of its leaf: it stays if it comes before the budget is met.  Rows
    that repeat a doc_id (or have none and repeat a text) share their place and
    are taken together.  An empty table gives an empty result.

    The driver sees one row for each leaf: the tree that the weights describe.
    """
    base = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    own = [c for c in docs.columns if c not in ("mix_domain", "mix_tokens", "mix_epoch")]
    path = F.to_json(F.array(F.col("mix_domain").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")))
    # the columns of docs travel in a struct, where their names can't meet those made here
    marked = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), (domain if domain is not None else domain_of()).alias("mix_domain"), tokens_of().alias("mix_tokens"), base.alias("base"), F.col("lang"), F.col("source")
    ).select("row", "mix_domain", "mix_tokens", "base", path.alias("leaf"))
    light = stage(marked.select("leaf", "base", "mix_tokens"), "mix-light")
    names = {tuple(json.loads(r["leaf"])): (r["leaf"], r["n"]) for r in light.groupBy("leaf").agg(F.sum("mix_tokens").alias("n")).collect()}
    held = {k: n for k, (_, n) in names.items()}
    budgets = allocate(held, sum(held.values()) * share if total is None else total, weights, epochs)
    plan = []
    for k, budget in budgets.items():
        n = held[k]
        full = min(epochs, int(budget // n)) if n else epochs
        plan.append((names[k][0], full, max(0.0, budget - full * n) if full < epochs else 0.0))
    spark = docs.sparkSession
    leaf = spark.createDataFrame(plan, "leaf string, full int, rest double")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.col("base")).cast("binary"))
    keyed = light.join(leaf, "leaf").select("leaf", "rest", "mix_tokens", key.alias("key"))
    keyed = keyed.withColumn("range", F.conv(F.substring("key", 1, 4), 16, 10).cast("int"))
    ranges = keyed.groupBy("leaf", "range").agg(F.sum("mix_tokens").alias("n"), F.first("rest").alias("rest"))
    order = Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    cut = ranges.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where("before < rest and rest <= before + n")
    cut = cut.groupBy("leaf").agg(F.min(F.struct("range", "before")).alias("c")).select("leaf", F.col("c.range").alias("cut"), F.col("c.before").alias("before"))
    # rows of one key are one step: all of them have the tokens of smaller keys before them
    steps = keyed.join(cut, "leaf").where("range = cut").groupBy("leaf", "key").agg(F.sum("mix_tokens").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    place = Window.partitionBy("leaf").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = steps.select("leaf", "key", "rest", (F.col("before") + F.coalesce(F.sum("n").over(place), F.lit(0))).alias("at"))
    last = inside.where("at < rest").groupBy("leaf").agg(F.max("key").alias("last"))
    chosen = stage(leaf.join(last, "leaf", "left").select("leaf", "full", F.coalesce("last", F.lit("")).alias("last")), "mix-plan")
    taken = marked.join(chosen, "leaf").withColumn("times", F.col("full") + (key <= F.col("last")).cast("int")).where("times > 0")
    taken = taken.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return taken.select(*(F.col("row").getField(c).alias(c) for c in own), "mix_domain", "mix_tokens", "mix_epoch")
