"""The whole life of paid requests: budget, lease, quotas, and one final state.

One step function serves the batch fold and the stream (``streaming.ledgers``).
A ledger's events feed back into one another (what is denied ties up nothing),
so they are one ordered fold; ledgers run beside each other.
"""

from __future__ import annotations

from collections.abc import Iterable, MutableMapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ledger import replay

RESERVED, SETTLED, RELEASED, DENIED = "reserved", "settled", "released", "denied"
_FINAL = {"settle": SETTLED, "release": RELEASED, "deny": DENIED}
#: Columns of a ledger's events.
EVENT = ("request_id", "client", "action", "micros")
MICRO = 1_000_000


@dataclass(frozen=True)
class Limits:
    """Bounds of a ledger; money in millionths."""

    hard_micros: int
    soft_micros: int
    concurrent: int
    lease_seconds: int
    per_client: int
    per_day: int
    per_day_saving: int


class Guardrails:
    """Steps over a key-value store; every value is a list of strings and integers.

    Keys: ``r/<request>`` its state, client, day, month and micros; ``m/<month>``
    what is settled; ``d/<day>`` and ``c/<day>/<client>`` counters; ``open`` the
    reservations that hold a lease, ``concurrent`` of them at most.
    """

    def __init__(self, store: MutableMapping[str, list], limits: Limits):
        self.store, self.limits = store, limits

    def _open(self, at: int) -> list:
        return [x for x in self.store.get("open", []) if x[1] > at]

    def committed(self, month: str, at: int) -> int:
        """What is settled in a month, and reserved in it under a running lease."""
        return self.store.get(f"m/{month}", [0])[0] + sum(x[3] for x in self._open(at) if x[2] == month)

    def _count(self, key: str, by: int) -> None:
        self.store[key] = [max(0, self.store.get(key, [0])[0] + by)]

    def reserve(self, request: str, client: str, micros: int, at: int, day: str) -> str:
        """reserved, duplicate, budget_exceeded, too_many_running or daily_limit.

        Only the last two leave a record (denied): a request over budget may
        be asked again.
        """
        if f"r/{request}" in self.store:
            return "duplicate"
        month, limits = day[:7], self.limits
        if self.committed(month, at) + micros > limits.hard_micros:
            return "budget_exceeded"
        held = self._open(at)
        record = [DENIED, client, day, month, micros]
        outcome = RESERVED
        if len(held) >= limits.concurrent:
            outcome = "too_many_running"
        else:
            saving = self.committed(month, at) + micros >= limits.soft_micros
            daily = min(limits.per_day, limits.per_day_saving) if saving else limits.per_day
            mine, all_ = f"c/{day}/{client}", f"d/{day}"
            if self.store.get(mine, [0])[0] >= limits.per_client or self.store.get(all_, [0])[0] >= daily:
                outcome = "daily_limit"
            else:
                self._count(mine, 1)
                self._count(all_, 1)
                record[0] = RESERVED
                held.append([request, at + limits.lease_seconds * MICRO, month, micros])
        self.store[f"r/{request}"] = record
        self.store["open"] = held
        return outcome

    def finish(self, request: str, action: str, micros: int | None) -> str:
        """The final state, once: later ones, and those of unknown requests, are ``ignored``.

        A lease that ran out doesn't stop a request from being settled.  A
        released request gives its places in both counters back.
        """
        record = self.store.get(f"r/{request}")
        if record is None or record[0] != RESERVED:
            return "ignored"
        state, client, day, month, estimate = record
        final = _FINAL[action]
        if final == SETTLED:
            self._count(f"m/{month}", estimate if micros is None else micros)
        if final == RELEASED:
            self._count(f"c/{day}/{client}", -1)
            self._count(f"d/{day}", -1)
        self.store[f"r/{request}"] = [final, client, day, month, estimate]
        self.store["open"] = [x for x in self.store.get("open", []) if x[0] != request]
        return final

    def step(self, at: int, day: str, request: str | None, client: str | None, action: str | None, micros: int | None) -> tuple[str, int]:
        """(outcome, micros committed in the event's month afterwards)."""
        if request is None or action not in ("reserve", *_FINAL) or (action == "reserve" and (micros is None or micros < 0)) or (micros or 0) < 0:
            outcome = "invalid"
        elif action == "reserve":
            outcome = self.reserve(request, client or "", micros, at, day)
        else:
            outcome = self.finish(request, action, micros)
        return outcome, self.committed(day[:7], at)


def guarded(events: DataFrame, limits: Limits, key: str = "ledger") -> DataFrame:
    """``events`` with ``outcome`` and ``committed``: replayed in order of (at, ord).

    events(ledger, at timestamp, ord, request_id, client, action: reserve,
    settle, release or deny, micros).  Events without request, known action or
    (for reserve) an amount, and negative amounts, are ``invalid`` and change
    nothing; a null client is a client of its own.  Events without a time come
    first and count for 1970.
    """
    def step(store, at, day, *event):
        return store, Guardrails(store, limits).step(at, day, *event)

    timed = events.withColumns({"_at": F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(0).cast("long")), "_day": F.date_format(F.coalesce(F.col("at").cast("timestamp"), F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd")})
    timed = timed.withColumns({"micros": F.col("micros").cast("long"), **{c: F.col(c).cast("string") for c in EVENT[:3]}})
    return replay(timed, key, ("_at", "ord"), ("_at", "_day", *EVENT), dict, step, outcome=T.StringType(), committed=T.LongType()).drop("_at", "_day")


def lifecycle(rows: Iterable, limits: Limits) -> list[tuple[str, int]]:
    """Outcomes of one ledger's (at, day, request, client, action, micros) in order."""
    rails = Guardrails({}, limits)
    return [rails.step(*row) for row in rows]
