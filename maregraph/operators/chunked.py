"""Bounded row frames over series of any length: chunks of rows with a margin of neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maregraph.operators.series import Series
from maregraph.operators.work import matched


def numbered(df: DataFrame, s: Series, bucket: Column) -> DataFrame:
    """df with `_rank`, the row's place (from 0) in its series, without sorting a series in one task.

    `bucket` must rise with the order, such as the day of the time: rows are numbered
    inside buckets and buckets by their counts.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*s.keys, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.select(*s.keys, "_bucket", (F.sum("_n").over(Window.partitionBy(*s.keys).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*s.keys, "_bucket").orderBy(*s.order)) - 1
    joined = matched(rows.withColumn("_inside", inside), before, (*s.keys, "_bucket"))
    return joined.withColumn("_rank", F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside")


def rising(df: DataFrame, s: Series, rows: int) -> Column:
    """A bucket for numbered(): the day of times, stretches of `rows` of other numbers."""
    first = F.col(s.order[0])
    return first.cast("date") if isinstance(df.schema[s.order[0]].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.floor(first / rows)


def chunked(df: DataFrame, s: Series, rows: int, bucket: Column | None = None) -> DataFrame:
    """df with `_chunk`: stretches of `rows` rows of each series, by place."""
    at = numbered(df, s, rising(df, s, rows) if bucket is None else bucket)
    return at.withColumn("_chunk", F.floor(F.col("_rank") / rows)).drop("_rank")


def in_chunks(df: DataFrame, s: Series, margin: int, operator: Callable[[DataFrame, Series], DataFrame], bucket: Column, rows: int = 100_000) -> DataFrame:
    """operator(df, s) for operators whose rows depend on at most `margin` rows either side.

    Each chunk of `rows` rows is computed as a series of its own with `margin` rows
    before and after it, which are then dropped, so no task holds more than
    rows + 2 * margin rows of a series. Keys and columns come back as the operator
    returns them. Statistics of whole series don't belong inside the operator.
    """
    at = numbered(df, s, bucket).withColumn("_home", F.floor(F.col("_rank") / rows))
    near = F.sequence(F.greatest(F.floor((F.col("_rank") - margin) / rows), F.lit(0).cast("long")), F.floor((F.col("_rank") + margin) / rows))
    spread = at.withColumn("_chunk", F.explode(near)).drop("_rank")
    out = operator(spread, Series((*s.keys, "_chunk"), s.order, s.value))
    return out.filter("_home = _chunk").drop("_home", "_chunk")
