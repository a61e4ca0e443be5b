"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.briefs import weekly_window


def weekly_counts(events: DataFrame, at: str = "ts", late: str = "1 day", *keys: str) -> DataFrame:
    """Events of each weekly window; late ones within ``late`` still count."""
    grouped = events.withWatermark(at, late).groupBy(weekly_window(F.col(at)).alias("week"), *keys)
    return grouped.agg(F.count("*").alias("n")).select(F.col("week.start").alias("week_start"), F.col("week.end").alias("week_end"), *keys, "n")


def admit_quota(requests: DataFrame, client: str, at: str, per_client: int, request: str = "request_id", late: str = "1 day") -> DataFrame:
    """(client, day, request, admitted): a fixed daily window for each client.

    A request seen again is ignored.  State is a counter a client and day,
    dropped once the watermark has passed the day.
    """
    rows = requests.withWatermark(at, late).dropDuplicatesWithinWatermark([request])
    rows = rows.select(F.col(client).cast("string").alias("client"), F.date_format(at, "yyyy-MM-dd").alias("day"), F.col(request).cast("string").alias("request"), F.col(at).alias("at"))

    def count(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        (seen,) = state.get if state.exists else (0,)
        for frame in frames:
            frame = frame.sort_values(["at", "request"])
            yield pd.DataFrame({"client": key[0], "day": key[1], "request": frame["request"], "admitted": [seen + i < per_client for i in range(len(frame))]})
            seen += len(frame)
        state.update((seen,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(pd.Timestamp(key[1]).timestamp() * 1000) + 86_400_000))

    return rows.groupBy("client", "day").applyInPandasWithState(count, "client string, day string, request string, admitted boolean", "seen long", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def rolling_merge(stream: DataFrame, merge, root: str, key: str, checkpoint: str):
    """Start a query that merges each micro-batch into a versioned table.

    merge(old or None, batch) -> new rows.  A version is one folder named by
    its batch, so a batch that runs again writes the same version.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark: SparkSession = batch.sparkSession
        old = spark.read.parquet(f"{root}/v{n - 1}") if n else None
        merge(old, batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{root}/v{n}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
