"""Runs of named stages, with counts that Spark observes while it writes them.

A stage's rows are written to the shared folder under an ``Observation``, so
counting costs no pass of its own, and the next stage reads what was written.
A run's rows are appended whether its stages succeed or one of them fails.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import store

ROW = "run_id string, place int, stage string, status string, input_count long, output_count long, failure string, started_at timestamp, duration_ms long"
Stage = Callable[[DataFrame], DataFrame]


class StageError(Exception):
    """A stage failed; the run's rows are at ``path``."""

    def __init__(self, stage: str, path: str, reason: str):
        super().__init__(f"{stage}: {reason}")
        self.stage, self.path, self.reason = stage, path, reason


def observed(rows: DataFrame, path: str) -> tuple[DataFrame, int]:
    """``rows`` written to ``path`` and read back, and their number."""
    watch = Observation()
    rows.observe(watch, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), watch.get["n"]


def run_stages(rows: DataFrame, stages: list[tuple[str, Stage]], path: str, run_id: str | None = None) -> tuple[DataFrame, str]:
    """The last stage's rows, and the run's id; one lineage row a stage goes to ``path``.

    A stage's input is the output of the one before; the first stage's is
    ``rows``, counted as it is read.  If a stage fails, it leaves a row with
    status ``failed`` and no output, the stages after it leave ``skipped``
    rows, and :class:`StageError` is raised.  Stages that kept no row still
    succeed.
    """
    spark = rows.sparkSession
    run_id = run_id or uuid.uuid4().hex
    log, count, failed = [], None, None
    for place, (name, stage) in enumerate(stages):
        if failed:
            log.append((run_id, place, name, "skipped", None, None, None, None, None))
            continue
        began, started = time.perf_counter(), datetime.now(timezone.utc)
        watch = Observation()
        given = rows.observe(watch, F.count(F.lit(1)).alias("n")) if count is None else rows
        try:
            rows, made = observed(stage(given), store.scratch(spark, f"run-{name}"))
            if count is None:
                count = watch.get["n"]
            entry = ("succeeded", count, made, None)
            count = made
        except Exception as error:
            failed = StageError(name, path, str(error).split("\n")[0][:500])
            entry = ("failed", count, None, failed.reason)
        log.append((run_id, place, name, *entry, started, round((time.perf_counter() - began) * 1000)))
    store.append_run(spark.createDataFrame(log, ROW), path)
    if failed:
        raise failed
    return rows, run_id


def run_rows(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The lineage rows of one run."""
    return spark.read.schema(ROW).parquet(path).where(F.col("run_id") == run_id)


def outcome_counts(outcomes: DataFrame, kind: str, known: tuple[str, ...]) -> DataFrame:
    """(outcome, n) of every known outcome, zeros included, and of others that occur."""
    every = outcomes.sparkSession.createDataFrame([(k,) for k in known], "outcome string")
    n = outcomes.groupBy(F.col(kind).alias("outcome")).agg(F.count("*").alias("n"))
    return every.join(n, "outcome", "full").select("outcome", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
