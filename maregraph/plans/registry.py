"""Where queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maregraph.operators.series import Series
from maregraph.operators.work import scratch  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: The observation stream: stations and variables of events, every 17th value missing.
OBS = Series(("station", "variable"), ("ts", "event_id"), "x")
OBS_SQL = "obs AS (SELECT event_id, ts, user_id % 6 AS station, event_type AS variable, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS x FROM events)"
KEY = ("station", "variable", "event_id")
KEYS = "station, variable, event_id"
PART = "PARTITION BY station, variable"
W = f"{PART} ORDER BY ts, event_id"


def frame(a: str, b: str) -> str:
    return f"({W} ROWS BETWEEN {a} AND {b})"


def obs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", (F.col("user_id") % 6).alias("station"), F.col("event_type").alias("variable"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("x"))


def r(c: str | Column, digits: int = 6) -> Column:
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return out.alias(name) if name else out


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
