"""Rows numbered within their keys over range partitions.

A key's rows, however many, are dealt over as many partitions as their number
asks for: rows are partitioned by ranges of (key, order), sorted, and written
with their place in the partition.  One small table of spans then says, for
each key in each partition, how many rows of the key lie before.  No task ever
holds a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

_PART = 33  # monotonically_increasing_id: the partition's number stands above 33 bits of the row's


def ordered(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` written in order of (key, order...), with ``_row``: partition and place.

    ``key`` must not be null.  Rows that are equal in key and order may be
    split between partitions, in any order.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(F.col(key).asc(), *order, F.col("_tie").asc()).sortWithinPartitions(F.col(key).asc(), *order)
    return stage(dealt.drop("_tie").withColumn("_row", F.monotonically_increasing_id()), name)


def spans(table: DataFrame, key: str) -> DataFrame:
    """Of a table of :func:`ordered`: (_part, key, _first, _before, n), one row a key and partition.

    ``n`` is the key's number of rows.  The window reads a row a partition at most for any key.
    """
    each = table.groupBy(F.shiftrightunsigned("_row", _PART).alias("_part"), key).agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("_part", key, "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"))


def placed(table: DataFrame, spanned: DataFrame, key: str) -> DataFrame:
    """``table`` with ``idx``, the row's number within its key from 0, and the columns of ``spanned``."""
    return (
        table.withColumn("_part", F.shiftrightunsigned("_row", _PART)).join(spanned, ["_part", key])
        .withColumn("idx", F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_before")
    )
