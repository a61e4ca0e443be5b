"""Budgets, quotas, leases and request lifecycles, replayed in batch."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.numbers import day_key, month_key
from ..sources.store import scratch


def quota_admission(requests: DataFrame, client: str, at: str, per_client: int, per_day: int, order: str) -> DataFrame:
    """Adds ``admitted``: within the client's and the whole day's fixed windows.

    A request over its client's limit doesn't use up the day's.  The day's
    rank is taken over per-client heads only, in two steps: counts of earlier
    hours, then ranks within an hour.
    """
    day = day_key(F.col(at))
    mine = F.row_number().over(Window.partitionBy(client, day).orderBy(at, order))
    rows = requests.withColumn("_day", day).withColumn("_client_ok", mine <= per_client).withColumn("_hour", F.date_trunc("hour", F.col(at)))
    hours = rows.where("_client_ok").groupBy("_day", "_hour").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_day").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(hours.withColumn("_before", before).drop("_n"), ["_day", "_hour"], "left")
    nth = F.row_number().over(Window.partitionBy("_day", "_hour", "_client_ok").orderBy(at, order))
    return rows.withColumn("admitted", F.col("_client_ok") & (F.coalesce("_before", F.lit(0)) + nth <= per_day)).drop("_day", "_hour", "_client_ok", "_before")


def _fold(key: str, columns: tuple[str, ...], begin: Callable, step: Callable, adds, kinds, then: dict | None = None) -> Callable:
    """The fold over Arrow batches that are sorted by key and order.

    With ``then`` (chunk -> the chunk that goes on with its last key) they are
    sorted by chunk first; a row with ``_state`` is the state before its
    chunk, and such rows are made for the chunks to come.
    """
    group = (key,) if then is None else ("_chunk", key)

    def runs(batch):
        starts = np.arange(len(batch)) == 0
        for c in group:
            codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts[1:] |= codes[1:] != codes[:-1]
        at = np.flatnonzero(starts).tolist()
        return zip(at, [*at[1:], len(batch)])

    def carried(place, state, like):
        known = {"_chunk": then[place[0]], key: place[1], "_state": pickle.dumps(state)}
        return pa.RecordBatch.from_arrays([*(pa.array([known.get(f.name)], f.type) for f in like), *(pa.nulls(1, t) for t in kinds)], [*like.names, *adds])

    def run(batches):
        state, place, like = None, None, None
        for batch in batches:
            made, like, values = [], batch.schema, [batch.column(c).to_pylist() for c in columns]
            for low, high in runs(batch):
                here = tuple(batch.column(c)[low].as_py() for c in group)
                if here != place:
                    if then and place and here[0] != place[0] and place[0] in then:
                        yield carried(place, state, like)
                    place = here
                    if then is not None and batch.column("_state")[low].is_valid:
                        state, low = pickle.loads(batch.column("_state")[low].as_py()), low + 1
                    else:
                        state = begin()
                for row in zip(*(v[low:high] for v in values)):
                    state, out = step(state, *row)
                    made.append(out)
            if then is not None:
                batch = batch.filter(pc.is_null(batch.column("_state")))
            if made:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*made), kinds))], [*like.names, *adds])
        if then and place and place[0] in then:
            yield carried(place, state, like)

    return run


#: Rows of a key that a task sorts at once; longer keys are folded chunk after chunk.
CHUNK = 500_000


def replay(rows: DataFrame, key: str, order: tuple[str, ...], columns: tuple[str, ...], begin: Callable, step: Callable, **adds: T.DataType) -> DataFrame:
    """``rows`` with the columns ``adds``: an ordered fold over each key's rows.

    Rows are dealt by key, sorted, and streamed: a task holds one state and one
    Arrow batch, and sorts about ``CHUNK`` rows of a key at most (see
    ``_in_chunks``).  begin() -> state, which can be pickled;
    step(state, *columns) -> (state, values of adds).
    """
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, t) for c, t in adds.items())])
    kinds = [to_arrow_type(t) for t in adds.values()]
    count = rows.groupBy(key).count().agg(F.max("count").alias("longest"), F.sum("count").alias("all")).first()
    if (count.longest or 0) > CHUNK:
        return _in_chunks(rows, -(-count.all // CHUNK), key, order, columns, begin, step, adds, kinds).select(schema.names)
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(_fold(key, columns, begin, step, adds, kinds), schema)


def _in_chunks(rows, chunks, key, order, columns, begin, step, adds, kinds) -> DataFrame:
    """The fold of ``replay`` over ranges of (key, order): first all keys' first chunks, then their second ones, and so on.

    The chunks are written once.  A key's state goes to its next chunk as a row
    of its own, which is sorted before the others; each round writes its rows.
    """
    spark, chunked, done = rows.sparkSession, scratch(rows.sparkSession, "chunks"), scratch(rows.sparkSession, "folded")
    rows.repartitionByRange(chunks, key, *order).withColumn("_chunk", F.spark_partition_id()).write.partitionBy("_chunk").parquet(chunked)
    stored = spark.read.parquet(chunked).withColumn("_state", F.lit(None).cast("binary"))
    in_turn = Window.partitionBy(key).orderBy("_chunk")
    places = stored.select(key, "_chunk").distinct().withColumns({"_round": F.row_number().over(in_turn) - 1, "_before": F.lag("_chunk").over(in_turn)})
    later = places.where("_round > 0").collect()  # only the last key of a chunk goes on in another: these are fewer than the chunks
    place = T.StructType([stored.schema[key], stored.schema["_chunk"]])
    schema = T.StructType([*stored.schema.fields, *(T.StructField(c, t) for c, t in adds.items())])
    for n in range(max((r["_round"] for r in later), default=0) + 1):
        mine = F.broadcast(spark.createDataFrame([(r[key], r["_chunk"]) for r in later if r["_round"] == n or not n], place).toDF("_key", "_place"))
        same = (F.col("_chunk") == F.col("_place")) & F.col(key).eqNullSafe(F.col("_key"))
        if n:
            states = spark.read.schema(schema).parquet(f"{done}/{n - 1}").where("_state is not null").select(stored.columns)
            part = stored.where(F.col("_chunk").isin(sorted(r["_chunk"] for r in later if r["_round"] == n))).join(mine, same, "left_semi").unionByName(states)
        else:
            part = stored.join(mine, same, "left_anti")
        then = {r["_before"]: r["_chunk"] for r in later if r["_round"] == n + 1}
        dealt = part.repartitionById(chunks, F.col("_chunk")).sortWithinPartitions("_chunk", key, F.col("_state").isNull(), *order)
        dealt.mapInArrow(_fold(key, columns, begin, step, adds, kinds, then), schema).write.parquet(f"{done}/{n}")
    return spark.read.schema(schema).parquet(*(f"{done}/{i}" for i in range(n + 1))).where("_state is null")


def rollover(days: DataFrame, base: int, cap: int, per_run: int, seed: int, key: str = "ledger") -> DataFrame:
    """(ledger, day, run, before, credit, limit, used, after) of each run of a ledger.

    days(ledger, day, run, calls).  Unused credit rolls over up to ``cap``; a
    day's first run is credited, skipped days too.
    """
    def step(state, day, calls):
        last, balance = state
        gap = None if last is None else (day - last).days
        before = min(cap, seed) if gap is None else min(cap, balance + max(0, gap - 1) * base)
        credit = base if gap is None or gap > 0 else 0
        limit = min(per_run, before + credit)
        used = min(calls, limit)
        after = min(cap, max(0, before + credit - used))
        return (day, after), (before, credit, limit, used, after)

    rows = days.select(key, "day", F.col("run").cast("long").alias("run"), F.col("calls").cast("long").alias("calls"))
    names = ("before", "credit", "limit", "used", "after")
    return replay(rows, key, ("day", "run"), ("day", "calls"), lambda: (None, 0), step, **{n: T.LongType() for n in names}).select(key, "day", "run", *names)


def lease_concurrency(leases: DataFrame, started: str, ended: str, *groups: str) -> DataFrame:
    """(groups, peak): the most leases open at once; an end frees its place first."""
    moves = leases.select(*groups, F.col(started).alias("at"), F.lit(1).alias("d")).unionByName(leases.select(*groups, F.col(ended).alias("at"), F.lit(-1).alias("d")))
    net = moves.groupBy(*groups, "at").agg(F.sum("d").alias("d"))
    keys = groups or (F.lit(0),)
    open_ = F.sum("d").over(Window.partitionBy(*keys).orderBy("at"))
    return net.withColumn("open", open_).groupBy(*groups).agg(F.max("open").alias("peak"))


def lease_admission(requests: DataFrame, pool: str, most: int, seconds: int) -> DataFrame:
    """Adds ``granted``: was a lease free at the request's time (leases last ``seconds``)."""
    def step(open_, at):
        open_ = [end for end in open_ if end > at]
        free = len(open_) < most
        return [*open_, at + seconds * 1_000_000] if free else open_, (free,)

    timed = requests.withColumn("_micros", F.unix_micros(F.col("at").cast("timestamp")))
    return replay(timed, pool, ("_micros", "ord"), ("_micros",), list, step, granted=T.BooleanType()).drop("_micros")


def budget_admission(requests: DataFrame, hard_micros: int, month: str = "month") -> DataFrame:
    """Adds ``admitted`` and ``committed``: a month's requests in order against its hard limit.

    A denied request ties up nothing, so admission feeds back: an ordered
    fold.  A null estimate is neither admitted nor denied (null).
    """
    def step(total, estimate):
        fits = None if estimate is None else total + estimate <= hard_micros
        total = total + estimate if fits else total
        return total, (fits, total)

    rows = requests.withColumn("_estimate", F.col("estimated_micros").cast("long"))
    return replay(rows, month, ("ord",), ("_estimate",), int, step, admitted=T.BooleanType(), committed=T.LongType()).drop("_estimate")


def last_states(events: DataFrame, request: str = "request_id") -> DataFrame:
    """Each request's final state: the first of settle, release or deny after its reserve.

    events(request_id, action, at, micros).  Repeated actions count once.
    """
    final = events.where(F.col("action").isin("settle", "release", "deny"))
    ends = final.groupBy(request).agg(F.min(F.struct("at", "action", "micros")).alias("e"))
    starts = events.where(F.col("action") == "reserve").groupBy(request).agg(F.min("at").alias("reserved_at"), F.min_by("micros", "at").alias("estimated_micros"))
    state = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in (("settle", "settled"), ("release", "released"), ("deny", "denied")) for x in p]), F.col("e.action")), F.lit("reserved"))
    return starts.join(ends, request, "left").select(request, "reserved_at", "estimated_micros", state.alias("state"), F.when(F.col("e.action") == "settle", F.coalesce("e.micros", "estimated_micros")).otherwise(F.lit(0)).alias("actual_micros"))


def months(rows: DataFrame, at: str) -> DataFrame:
    return rows.withColumn("month", month_key(F.col(at)))
