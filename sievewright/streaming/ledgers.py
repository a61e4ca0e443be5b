"""Streaming leases and ledgers: event-time order, state that survives restarts.

Events wait in state until the watermark has passed them, then run in order of
time, so any order of arrival within the watermark gives what the batch fold
gives.  Spark commits state and output of a micro-batch together; a stopped
query goes on from its checkpoint, and a final state is written once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.guardrails import EVENT, Guardrails, Limits

#: The state store that timers need.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Store(MutableMapping):
    """A map of JSON values in the state store."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, key: str) -> list:
        found = self.state.getValue((key,))
        if found is None:
            raise KeyError(key)
        return json.loads(found[0])

    def __setitem__(self, key: str, value: list) -> None:
        self.state.updateValue((key,), (json.dumps(value),))

    def __delitem__(self, key: str) -> None:
        self.state.removeKey((key,))

    def __iter__(self):
        return (k[0] for k in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self)


class _Ordered(StatefulProcessor):
    """Holds events back until the watermark; runs those of one millisecond in order of (time, ord)."""

    columns: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = _Store(handle.getMapState("waiting", "k string", "v string"))
        self.held = _Store(handle.getMapState("held", "k string", "v string"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list] = {}
        for frame in rows:
            for row in frame[["micros_at", "ord", *self.columns]].astype(object).where(lambda x: x.notna(), None).values.tolist():
                new.setdefault(row[0] // 1000, []).append(row)
        for ms, events in new.items():
            self.waiting[str(ms)] = self.waiting.get(str(ms), []) + events
            self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        out = list(self.elapsed(key, ms))
        due = self.waiting.pop(str(ms), [])
        for row in sorted(due, key=lambda r: r[:2]):
            out += self.run(key, *row)
        if out:
            yield pd.DataFrame(out)

    def elapsed(self, key, ms: int) -> Iterator[dict]:
        """Rows for what ended by itself."""
        yield from ()

    def run(self, key, at: int, ord_: int, *event) -> list[dict]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Leases(_Ordered):
    columns = ("request_id",)

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def run(self, key, at, ord_, request):
        seen = f"s/{request}"
        if self.held.get(seen, [at])[0] > at:
            return []
        open_ = [x for x in self.held.get("open", []) if x[0] > at]
        granted = len(open_) < self.most
        ends = at + self.seconds * 1_000_000
        self.held[seen] = [ends]
        if granted:
            open_.append([ends, request])
        self.held["open"] = open_
        self.handle.registerTimer(ends // 1000 + 1)  # the place, and the memory of the request, end
        self.held[f"t/{ends // 1000 + 1}"] = self.held.get(f"t/{ends // 1000 + 1}", []) + [[ends, request, granted]]
        return [{"pool": key[0], "request_id": request, "at": pd.Timestamp(at, unit="us"), "state": "granted" if granted else "refused"}]

    def elapsed(self, key, ms):
        for ends, request, granted in self.held.pop(f"t/{ms}", []):
            self.held["open"] = [x for x in self.held.get("open", []) if x != [ends, request]]
            if self.held.get(f"s/{request}") == [ends]:
                del self.held[f"s/{request}"]
            if granted:
                yield {"pool": key[0], "request_id": request, "at": pd.Timestamp(ends, unit="us"), "state": "expired"}


def lease_stream(requests: DataFrame, pool: str, most: int, seconds: int, at: str = "at", late: str = "1 hour") -> DataFrame:
    """(pool, request_id, at, state): granted or refused once the watermark has passed a request, ``expired`` when a lease ends.

    At most ``most`` leases of a pool run at once, each for ``seconds``.  A
    timer gives an expired lease's place back and forgets its request (a timer
    that is due when it is set runs with the next micro-batch); a request that
    comes again before that time is ignored.  Requests of one time run by
    ``ord``.  Rows without time, and rows that come after the watermark, are
    not seen.
    """
    rows = requests.where(F.col(at).isNotNull()).select(F.col(pool).cast("string").alias("pool"), F.col(at).cast("timestamp").alias("_time"), "ord", F.col("request_id").cast("string").alias("request_id"))
    rows = rows.withColumn("micros_at", F.unix_micros("_time")).withWatermark("_time", late)
    return rows.groupBy("pool").transformWithStateInPandas(_Leases(most, seconds), "pool string, request_id string, at timestamp, state string", "append", "eventTime")


class _Guarded(_Ordered):
    columns = ("day", *EVENT)

    def __init__(self, limits: Limits):
        self.limits = limits

    def run(self, key, at, ord_, day, request, client, action, micros):
        outcome, committed = Guardrails(self.held, self.limits).step(at, day, request, client, action, None if micros is None else int(micros))
        return [{"ledger": key[0], "ord": ord_, "request_id": request, "action": action, "outcome": outcome, "committed": committed}]


def guarded_stream(events: DataFrame, limits: Limits, key: str = "ledger", late: str = "1 hour") -> DataFrame:
    """``operators.guardrails.guarded`` over a stream: (ledger, ord, request_id, action, outcome, committed).

    The same outcomes as in batch for any order of arrival within ``late``.
    Requests' final states stay in state: that is what makes them final.
    Events without time, and those that come after the watermark, are not seen.
    """
    rows = events.where(F.col("at").isNotNull()).select(
        F.col(key).cast("string").alias("ledger"), F.col("at").cast("timestamp").alias("_time"), "ord", F.date_format(F.col("at").cast("timestamp"), "yyyy-MM-dd").alias("day"),
        *(F.col(c).cast("string").alias(c) for c in EVENT[:3]), F.col("micros").cast("long").alias("micros"),
    )
    rows = rows.withColumn("micros_at", F.unix_micros("_time")).withWatermark("_time", late)
    out = "ledger string, ord long, request_id string, action string, outcome string, committed long"
    return rows.groupBy("ledger").transformWithStateInPandas(_Guarded(limits), out, "append", "eventTime")
