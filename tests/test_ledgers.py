"""Request lifecycles: the fold against a table of records that is scanned anew for every event; streams against the fold."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.operators import guardrails, ledger
from sievewright.streaming import ledgers

LIMITS = guardrails.Limits(hard_micros=220, soft_micros=150, concurrent=3, lease_seconds=300, per_client=12, per_day=30, per_day_saving=24)
BEGIN = datetime(2024, 1, 31, 20, tzinfo=timezone.utc)
SCHEMA = "ledger string, at timestamp, ord long, request_id string, client string, action string, micros long"


def scanned(rows, limits=LIMITS):
    """Outcomes by definition: nothing is kept but the records of requests and finished leases."""
    out = {}
    for name in {r[0] for r in rows}:
        records, released = [], []  # [request, client, at, estimate, state, actual, in lease]
        for _, at, ord_, request, client, action, micros in sorted((r for r in rows if r[0] == name), key=lambda r: r[1:3]):
            running = [r for r in records if r["leased"] and r["state"] == "reserved" and at < r["at"] + timedelta(seconds=limits.lease_seconds)]
            month = f"{at:%Y-%m}"

            def spent():
                return sum(r["actual"] for r in records if r["state"] == "settled" and f"{r['at']:%Y-%m}" == month) + sum(r["estimate"] for r in records if r in running and f"{r['at']:%Y-%m}" == month)

            mine = [r for r in records if r["request"] == request]
            if action == "reserve":
                today = [r for r in records if r["counted"] and f"{r['at']:%Y-%m-%d}" == f"{at:%Y-%m-%d}"]
                if mine:
                    outcome = "duplicate"
                elif spent() + micros > limits.hard_micros:
                    outcome = "budget_exceeded"
                else:
                    r = dict(request=request, client=client, at=at, estimate=micros, state="denied", actual=0, leased=False, counted=False)
                    daily = limits.per_day_saving if spent() + micros >= limits.soft_micros else limits.per_day
                    if len(running) >= limits.concurrent:
                        outcome = "too_many_running"
                    elif len(today) >= daily or sum(x["client"] == client for x in today) >= limits.per_client:
                        outcome = "daily_limit"
                    else:
                        outcome = "reserved"
                        r |= dict(state="reserved", leased=True, counted=True)
                        running.append(r)
                    records.append(r)
            elif not mine or mine[0]["state"] != "reserved":
                outcome = "ignored"
            else:
                outcome = {"settle": "settled", "release": "released", "deny": "denied"}[action]
                mine[0] |= dict(state=outcome, actual=(mine[0]["estimate"] if micros is None else micros) if outcome == "settled" else 0)
                mine[0]["counted"] = outcome != "released"
                running = [r for r in running if r is not mine[0]]
            out[ord_] = (outcome, spent())
    return out


def events(seed, n=400):
    draw = random.Random(seed)
    rows, at = [], BEGIN
    for i in range(n):
        at += timedelta(seconds=draw.choice([0, 5, 40, 100, 400]))
        rows.append((f"l{draw.randrange(2)}", at, i, f"q{draw.randrange(n // 2)}", f"c{draw.randrange(4)}", draw.choice(["reserve"] * 3 + ["settle", "release", "deny"]), draw.choice([10, 40, 90])))
    return [r[:6] + (None,) if r[5] == "settle" and r[2] % 3 == 0 else r for r in rows]


def test_fold_is_the_definition(spark):
    seen = set()
    for seed in range(4):
        rows = events(seed)
        got = {r.ord: (r.outcome, r.committed) for r in guardrails.guarded(spark.createDataFrame(rows, SCHEMA).repartition(5), LIMITS).collect()}
        assert got == scanned(rows)
        seen |= {o for o, _ in got.values()}
    assert seen == {"reserved", "duplicate", "budget_exceeded", "too_many_running", "daily_limit", "settled", "released", "denied", "ignored"}


def test_invalid_events(spark):
    rows = [("a", None, 0, "q", "c", "reserve", 5), ("a", BEGIN, 1, None, "c", "reserve", 5), ("a", BEGIN, 2, "r", None, "reserve", None), ("a", BEGIN, 3, "r", "c", "what", 5), (None, BEGIN, 4, "r", None, "reserve", 7), ("a", BEGIN, 5, "r", "c", "settle", -1)]
    got = {r.ord: (r.outcome, r.committed) for r in guardrails.guarded(spark.createDataFrame(rows, SCHEMA), LIMITS).collect()}
    assert got == {0: ("reserved", 5), 1: ("invalid", 0), 2: ("invalid", 0), 3: ("invalid", 0), 4: ("reserved", 7), 5: ("invalid", 0)}
    assert guardrails.guarded(spark.createDataFrame([], SCHEMA), LIMITS).count() == 0


def shuffled_files(spark, rows, schema, path, seed, parts=3, within=40):
    """Rows in files that arrive one after another, out of order by up to ``within`` places, and a last row that moves the watermark past all."""
    draw = random.Random(seed)
    late = sorted(range(len(rows)), key=lambda i: i + draw.uniform(0, within))
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame([rows[i] for i in late[k * size : (k + 1) * size]], schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    return [f"{path}/{k}" for k in range(parts)]


def run_in_batches(spark, make, folders, schema, checkpoint, out):
    """One query a folder: each starts from the checkpoint of the one before."""
    import shutil

    source = f"{checkpoint}-in"
    for k, folder in enumerate(folders):
        shutil.copytree(folder, f"{source}/{k}")
        made = make(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source))
        query = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out)


@pytest.fixture
def rocks(spark):
    name = next(iter(ledgers.PROVIDER))
    before = spark.conf.get(name)
    spark.conf.set(name, ledgers.PROVIDER[name])
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stream_is_the_fold_over_restarts(spark, tmp_path, rocks):
    rows = events(7, 160)
    end = (rows[0][0], rows[-1][1] + timedelta(days=4), 10_000, None, None, "reserve", 1)
    ends = [("l0", *end[1:]), ("l1", *end[1:2], 10_001, *end[3:])]
    folders = shuffled_files(spark, rows, SCHEMA, str(tmp_path / "rows"), 1)
    spark.createDataFrame(ends, SCHEMA).write.parquet(str(tmp_path / "end"))
    got = run_in_batches(spark, lambda s: ledgers.guarded_stream(s, LIMITS, late="2 days"), [*folders, str(tmp_path / "end")], SCHEMA, str(tmp_path / "c"), str(tmp_path / "out"))
    got = [(r.ord, (r.outcome, r.committed)) for r in got.collect() if r.ord < 10_000]
    assert len(got) == len(rows) and dict(got) == scanned(rows)


def test_lease_stream_is_the_batch_result(spark, tmp_path, rocks):
    draw = random.Random(5)
    schema = "pool string, at timestamp, ord long, request_id string"
    rows = [(f"p{draw.randrange(2)}", BEGIN + timedelta(seconds=draw.randrange(4000)), i, f"q{i}") for i in range(120)]
    rows.sort(key=lambda r: r[1:3])
    again = [(p, at + timedelta(seconds=1), ord_ + 1000, q) for p, at, ord_, q in rows[::9]]  # repeated soon after
    folders = shuffled_files(spark, sorted(rows + again, key=lambda r: r[1:3]), schema, str(tmp_path / "rows"), 2)
    ends = [str(tmp_path / f"end{k}") for k in (5, 6)]
    for k, path in zip((5, 6), ends):
        spark.createDataFrame([("p9", BEGIN + timedelta(days=k), 99_999, "end")], schema).write.parquet(path)
    got = run_in_batches(spark, lambda s: ledgers.lease_stream(s, "pool", 2, 300, late="2 days"), [*folders, *ends], schema, str(tmp_path / "c"), str(tmp_path / "out")).collect()
    want = {r.request_id: r.granted for r in ledger.lease_admission(spark.createDataFrame(rows, schema), "pool", 2, 300).collect()}
    assert {r.request_id: r.state == "granted" for r in got if r.state != "expired" and r.request_id != "end"} == want
    at = {q: when for _, when, _, q in rows}
    expired = {r.request_id: r.at for r in got if r.state == "expired" and r.request_id != "end"}
    assert expired.keys() == {q for q, g in want.items() if g}
    assert all((when.replace(tzinfo=timezone.utc) - at[q]).total_seconds() == 300 for q, when in expired.items())


def test_a_long_key_is_folded_in_chunks(spark, monkeypatch):
    """A task sorts a few chunks, not a whole key; the fold goes on from chunk to chunk, short and null keys beside it."""
    monkeypatch.setattr(ledger, "CHUNK", 200, raising=False)
    keys = ["long"] * 2000 + ["other"] * 700 + [None] * 500 + [f"k{i % 40}" for i in range(300)]
    random.Random(2).shuffle(keys)
    rows = spark.createDataFrame(list(enumerate(keys)), "ord long, key string").repartition(7)

    def step(n, _):
        return n + 1, (n + 1, TaskContext.get().taskAttemptId())

    got = ledger.replay(rows, "key", ("ord",), ("ord",), int, step, nth=T.LongType(), task=T.LongType())
    assert got.columns == ["ord", "key", "nth", "task"]
    seen, out = Counter(), sorted(got.collect())
    for r in out:
        seen[keys[r.ord]] += 1
        assert (r.key, r.nth) == (keys[r.ord], seen[keys[r.ord]])
    assert [r.ord for r in out] == list(range(len(keys)))
    assert max(Counter(r.task for r in out).values()) <= 1200


def test_ledgers_in_chunks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ledger, "CHUNK", 60, raising=False)
    draw, at = random.Random(5), lambda s: BEGIN + timedelta(seconds=s)
    money = [(i, draw.choice("abc"), draw.choice([None, 0, 3, 40, -2])) for i in range(600)]
    want, total = {}, Counter()
    for i, month, micros in money:
        fits = None if micros is None else total[month] + micros <= 200
        total[month] += micros if fits else 0
        want[i] = (fits, total[month])
    got = ledger.budget_admission(spark.createDataFrame(money, "ord long, month string, estimated_micros long"), 200)
    assert {r.ord: (r.admitted, r.committed) for r in got.collect()} == want
    moves = [(i, "ab"[i % 5 == 0], at(draw.randint(0, 9000))) for i in range(500)]
    want, open_ = {}, {"a": [], "b": []}
    for i, pool, when in sorted(moves, key=lambda m: (m[2], m[0])):
        open_[pool] = [end for end in open_[pool] if end > when]
        want[i] = len(open_[pool]) < 3
        open_[pool] += [when + timedelta(seconds=60)] * want[i]
    got = ledger.lease_admission(spark.createDataFrame(moves, "ord long, pool string, at timestamp"), "pool", 3, 60)
    assert {r.ord: r.granted for r in got.collect()} == want
    rows = [("ab"[i % 3 == 0], at(i * 40), i, f"r{draw.randint(0, 150)}", draw.choice("xyz"), draw.choice(["reserve", "reserve", "settle", "release"]), draw.randint(1, 40)) for i in range(400)]
    got = {r.ord: (r.outcome, r.committed) for r in guardrails.guarded(spark.createDataFrame(rows, SCHEMA).repartition(5), LIMITS).collect()}
    monkeypatch.setattr(ledger, "CHUNK", 10_000, raising=False)
    assert got == {r.ord: (r.outcome, r.committed) for r in guardrails.guarded(spark.createDataFrame(rows, SCHEMA), LIMITS).collect()}
