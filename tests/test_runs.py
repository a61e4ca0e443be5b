"""Lineage, weekly briefs, guarded requests and hybrid retrieval against sequential versions."""

import math
import os
import random
import subprocess
import sys
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievewright.operators import briefs, lineage, retrieval
from sievewright.plans import runs
from tests.test_ledgers import scanned

SMALL = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_failing_run_leaves_its_rows(spark, tmp_path):
    rows = spark.range(10)
    stages = [("half", lambda d: d.where("id < 5")), ("none", lambda d: d.where("id < 0")), ("break", lambda d: d.withColumn("id", F.raise_error(F.lit("no luck")).cast("long"))), ("after", lambda d: d)]
    stages[2] = ("break", lambda d: d.unionByName(d.sparkSession.range(1)).select(F.raise_error(F.lit("no luck")).cast("long").alias("id")))
    path = str(tmp_path / "runs")
    with pytest.raises(lineage.StageError) as error:
        lineage.run_stages(rows, stages, path, "r1")
    assert error.value.stage == "break"
    got = lineage.run_rows(spark, path, "r1").orderBy("place").collect()
    assert [(r.stage, r.status, r.input_count, r.output_count) for r in got] == [("half", "succeeded", 10, 5), ("none", "succeeded", 5, 0), ("break", "failed", 0, None), ("after", "skipped", None, None)]
    out, run_id = lineage.run_stages(rows, stages[:1], path)
    assert out.count() == 5 and lineage.run_rows(spark, path, run_id).count() == 1 and spark.read.parquet(path).count() == 5
    counts = lineage.outcome_counts(spark.createDataFrame([("a",), ("b",), ("a",)], "o string"), "o", ("a", "c"))
    assert {r.outcome: r.n for r in counts.collect()} == {"a": 2, "b": 1, "c": 0}


def test_weekly_runs_step_by_step(spark):
    """Run after run, with all candidates counted anew each time."""
    draw = random.Random(4)
    begin = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i in range(60):
        at = begin + timedelta(hours=draw.randrange(24 * 50))
        rows.append((f"s{draw.randrange(3)}", at, at + timedelta(hours=draw.randrange(300)), f"{draw.getrandbits(256):064x}", ["e"] if i % 9 else [], "标题" if i % 7 else None))
    articles = spark.createDataFrame(rows, "source_id string, published_at timestamp, collected_at timestamp, content_hash string, evidence_ids array<string>, title_zh string").withColumns({"summary_zh": F.col("title_zh"), "title": F.lit("t"), "abstract": F.lit("a"), "language": F.lit("en")})
    times = [(i, begin + timedelta(hours=draw.randrange(24 * 60)), draw.random() < 0.1, draw.random() < 0.8) for i in range(150)]
    got = {r.run_id: r for r in briefs.weekly_runs(spark.createDataFrame([*times, (999, None, True, True)], "run_id long, now timestamp, forced boolean, able boolean"), briefs.week_readiness(articles)).collect()}
    held = brief = None
    states = Counter()
    for run_id, now, forced, able in sorted(times, key=lambda r: (r[1], r[0])):
        start, end = briefs.last_complete_week(now)
        local = now + timedelta(hours=8)
        some = [r for r in rows if start <= r[1] < end and r[2] <= now and r[4] and r[5]]
        if held == end:
            state = "current"
        elif not (forced or (local.weekday() == 5 and local.hour >= 9)) or not able:
            state = "carried" if brief else "not_due"
        elif len(some) < 4 or len({r[0] for r in some}) < 2:
            state = "insufficient_carried" if brief else "insufficient"
        else:
            state, held, brief = "generated", end, f"brief-{start:%Y-%m-%d}"
        states[state] += 1
        assert got[run_id].state == state
        assert (got[run_id].brief_id or "")[:16] == (brief or "")
        assert got[run_id].period_end.replace(tzinfo=timezone.utc) == end
    assert len(got) == len(times) and len(states) >= 5


def test_guarded_requests_by_definition(spark):
    rows = [(r.ledger, r.at, r.ord, r.request_id, r.client, r.action, r.micros) for r in runs.requests(spark, SMALL).collect()]
    got = {r.ord: (r.outcome, r.committed) for r in entry.queries()["guarded_requests"](spark, SMALL).collect()}
    assert got == scanned(rows, runs.LIMITS)


def test_hybrid_retrieval_by_hand(spark):
    """BM25 and cosines of all pairs, fused."""
    from tests.test_brute import embedded

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    asked = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    tokens = {d: Counter(words(t)) for d, t in docs.items()}
    df = Counter(w for c in tokens.values() for w in c)
    mean = sum(sum(c.values()) for c in tokens.values()) / len(docs)
    vectors = {d: embedded(t) for d, t in docs.items()}
    want = {}
    for q, text in asked.items():
        lexical = {d: sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set(words(text)) if w in c) for d, c in tokens.items()}
        qv = embedded(text)
        dense = {d: round(sum(a * b for a, b in zip(qv, v)), 6) for d, v in vectors.items()}
        fused = Counter()
        for scores in ({d: math.floor(s * 1e6 + 0.5) / 1e6 for d, s in lexical.items()}, dense):
            for rank, d in enumerate(sorted(scores, key=lambda d: (-scores[d], d))[:10], 1):
                fused[d] += 1 / (60 + rank)
        best = sorted(fused, key=lambda d: (-math.floor(fused[d] * 1e8 + 0.5), d))[:10]
        want |= {(q, rank): d for rank, d in enumerate(best, 1)}
    got = {(r.query_id, r["rank"]): r.chunk_id for r in entry.queries()["hybrid_rrf"](spark, SMALL).collect()}
    assert got == want


def words(text):
    import re

    return re.findall(r"[a-z0-9][a-z0-9._+\-]*", text.lower())  # the tables have no Chinese


def test_dense_blocks(spark):
    """Null vectors, other lengths, ties by id, blocks of queries and slices of the corpus."""
    draw = random.Random(2)
    corpus = [(i, [draw.choice([0.0, 1.0, -1.0]) for _ in range(3)]) for i in range(300)] + [(900, None), (901, [1.0]), (902, [])]
    asked = [(f"q{i}", [draw.choice([0.0, 1.0]) for _ in range(3)]) for i in range(7)] + [("short", [2.0]), ("none", None)]
    got = retrieval.dense_top(spark.createDataFrame(corpus, "chunk_id long, v array<double>").repartition(3), spark.createDataFrame(asked, "query_id string, qv array<double>"), 5, block=2).collect()
    for name, qv in asked:
        alike = [(sum(a * b for a, b in zip(qv, v)), i) for i, v in corpus if v and qv and len(v) == len(qv)]
        want = [i for _, i in sorted(alike, key=lambda x: (-x[0], x[1]))[:5]]
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == name), key=lambda r: r["rank"])] == want
    assert retrieval.dense_top(spark.createDataFrame([], "chunk_id long, v array<double>"), spark.createDataFrame(asked, "query_id string, qv array<double>")).count() == 0


def test_command_line_sees_every_query(tmp_path):
    """In a process of its own, where nothing else has imported the catalogue."""
    run = lambda *args: subprocess.run([sys.executable, "-m", "sievewright", *args], cwd=ROOT, capture_output=True, text=True, timeout=300)
    listed = run("list")
    assert listed.returncode == 0 and set(listed.stdout.split()) == set(entry.catalog.QUERIES) and len(entry.catalog.QUERIES) > 110
    assert run("run", "nothing", "--tables", SMALL).returncode == 2
    assert run("run", "set_difference", "--tables", SMALL, "--out", str(tmp_path / "out")).returncode == 0
