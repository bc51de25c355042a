"""Ordered series: keys, resampling to an hourly grid, bounded gap filling, chronological splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """Which columns name a series, order it (the last breaks ties) and hold its values."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    value: str

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def x(self) -> Column:
        return F.col(self.value)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def with_statistics(df: DataFrame, keys: tuple[str, ...], **statistics: Column) -> DataFrame:
    """df with aggregates of its key. They are one row a key, so Spark may broadcast them when they are small."""
    found = df.groupBy(*keys).agg(*(c.alias(name) for name, c in statistics.items()))
    return df.join(found, list(keys))


def over_key(df: DataFrame, keys: tuple[str, ...], **statistics: Column) -> DataFrame:
    """df with aggregates of its key, as windows: for rows that are, or will be, partitioned by the key, which then aren't read and moved twice."""
    w = Window.partitionBy(*keys)
    return df.withColumns({name: c.over(w) for name, c in statistics.items()})


def dedup_time(df: DataFrame, s: Series) -> DataFrame:
    """The first row of each key and time by the tie-breaking columns; rows without a time go."""
    w = Window.partitionBy(*s.keys, s.order[0]).orderBy(*s.order[1:])
    return df.filter(F.col(s.order[0]).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def hourly(df: DataFrame, s: Series) -> DataFrame:
    """Rows `keys, hour, value`: the median of each hour from the first to the last, null for empty hours."""
    hour = F.date_trunc("hour", F.col(s.order[0]))
    medians = df.groupBy(*s.keys, hour.alias("hour")).agg(F.median(s.x).alias("value"))
    spans = medians.groupBy(*s.keys).agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    grid = spans.select(*s.keys, F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("hour"))
    return grid.join(medians, [*s.keys, "hour"], "left")


def interpolated(df: DataFrame, s: Series, limit: int = 3, mode: str = "both_sides") -> Column:
    """Linear by position. `both_sides` fills what is within `limit` rows of a valid value on either side; `max_gap` only whole gaps of at most `limit` rows. Ends are filled flat."""
    before, after = s.window.rowsBetween(Window.unboundedPreceding, 0), s.window.rowsBetween(0, Window.unboundedFollowing)
    i = F.row_number().over(s.window)
    at = F.when(s.x.isNotNull(), i)
    pi, ni = F.last(at, True).over(before), F.first(at, True).over(after)
    pv, nv = F.last(s.x, True).over(before), F.first(s.x, True).over(after)
    near = (i - pi <= limit) | (ni - i <= limit) if mode == "both_sides" else (F.coalesce(ni, i + limit + 1) - F.coalesce(pi, i - limit - 1) - 1 <= limit)
    line = F.when(pv.isNull(), nv).when(nv.isNull(), pv).otherwise(pv + (nv - pv) * (i - pi) / F.nullif(ni - pi, F.lit(0)))
    return F.when(s.x.isNotNull(), s.x).when(F.coalesce(i - pi <= limit, F.lit(False)) | F.coalesce(ni - i <= limit, F.lit(False)) if mode == "both_sides" else near, line)


def tail(df: DataFrame, s: Series, n: int = 8760) -> DataFrame:
    """The last n rows with a value of each series."""
    back = Window.partitionBy(*s.keys).orderBy(*(F.desc(c) for c in s.order))
    return df.filter(s.x.isNotNull()).withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= n).drop("_n")


def split(df: DataFrame, s: Series, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """df with `part`: train, validation or test by position; bounds are cut to whole rows."""
    n, i = F.count("*").over(s.whole), F.row_number().over(s.window) - 1
    part = F.when(i < F.floor(n * F.lit(train)), "train").when(i < F.floor(n * (F.lit(train) + F.lit(validation))), "validation").otherwise("test")
    return df.withColumn("part", part)


def sequences(df: DataFrame, s: Series, lookback: int) -> DataFrame:
    """Rows with `history`, the `lookback` values before each; rows with fewer go."""
    held = F.collect_list(s.x).over(s.window.rowsBetween(-lookback, -1))
    return df.withColumn("history", held).filter(F.size("history") == lookback)


def three_step_sequences(df: DataFrame, s: Series, lookback: int) -> DataFrame:
    """Rows with `history`, the `lookback` values up to the second row before, and `targets`, those of the row before, the row and the row after; rows without all of them go."""
    w = s.window
    out = df.withColumns({"history": F.collect_list(s.x).over(w.rowsBetween(-lookback - 1, -2)), "targets": F.array(F.lag(s.x).over(w), s.x, F.lead(s.x).over(w))})
    return out.filter((F.size("history") == lookback) & ~F.exists("targets", lambda v: v.isNull()))


def mean_of_steps(*steps: Column) -> Column:
    """The forecast of the middle row: the mean of what is forecast for it and its neighbours."""
    return sum(steps, F.lit(0.0)) / len(steps)


def islands(df: DataFrame, s: Series, state: Column) -> DataFrame:
    """df with `island`: a number that rises whenever the state changes within a series."""
    changed = F.coalesce(~state.eqNullSafe(F.lag(state).over(s.window)), F.lit(True)).cast("int")
    return df.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(s.window)).drop("_changed")
