"""Extreme-value tails: generalised Pareto fits of all keys at once, ranks within a sample, and calibrations that are kept and joined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maregraph.functions.scalar import T4_QUARTILE, clean, gpd_sf, t4_sf
from maregraph.operators.quantiles import exact_quantiles, ordered_key
from maregraph.operators.work import matched, stored

#: Trailing bits of scores that are merged in one range.
RANGE_BITS = 42
#: Points of a first grid on each side of 0, of each refinement, and refinements.
SIDE, STEPS, ROUNDS = 24, 32, 3


def _filled(score: str) -> Column:
    return F.coalesce(clean(F.col(score).cast("double")), F.lit(0.0))


def _first_grid() -> tuple[Column, Callable[[Column], Column]]:
    """From near the least value that the greatest excess allows, through 0, to ten over the mean excess."""
    low, high = -(1 - 1e-6) / F.col("_top"), 10 / F.col("_mean")
    return F.array(*map(F.lit, [k / SIDE for k in range(-SIDE, SIDE + 1)])), lambda k: F.when(k < 0, -low * k).otherwise(high * (k * k))


def _refined() -> tuple[Column, Callable[[Column], Column]]:
    return F.array(*map(F.lit, [k / STEPS for k in range(STEPS + 1)])), lambda k: F.col("_a") + (F.col("_b") - F.col("_a")) * k


def gpd_fit(df: DataFrame, keys: tuple[str, ...], score: str, quantile: float = 0.9, train: Column | None = None) -> DataFrame:
    """Rows `keys, threshold, shape, scale, p_exceed, n_exceed`: the tail of each key's scores above their exact quantile, by maximum likelihood.

    Missing scores count as 0; `train` names the rows to fit (default: all). For a given
    shape / scale the best shape is the mean of log(1 + excess * shape / scale), so the
    likelihood is a function of one number. It is summed over a grid of that number for
    all keys in one aggregation, and ROUNDS times again over a finer grid around each
    key's best, so no task holds a key's excesses. Keys without rows above their
    threshold have none here.
    """
    rows = df if train is None else df.filter(train)
    scored = stored(rows.select(*keys, _filled(score).alias("_s")), "scores")
    limits = exact_quantiles(scored, keys, {"threshold": ("_s", quantile)})
    over = matched(scored, limits, keys).filter("_s > threshold").select(*keys, (F.col("_s") - F.col("threshold")).alias("_z"))
    over = stored(over, "excesses")
    size = matched(scored.groupBy(*keys).agg(F.count("*").alias("_n")), limits, keys)
    about = stored(matched(over.groupBy(*keys).agg(F.count("*").alias("_m"), F.avg("_z").alias("_mean"), F.max("_z").alias("_top")), size, keys), "excess-sizes")

    def best(told: DataFrame, places: Column, point: Callable[[Column], Column], n: int) -> DataFrame:
        """`told` with `_theta`, the best of a grid's n points, its shape, and its neighbours `_a` and `_b`."""
        gridded = told.withColumn("_grid", F.transform(places, point))
        logs = [F.sum(F.log1p(F.get("_grid", F.lit(k)) * F.col("_z"))).alias(f"_log{k}") for k in range(n)]
        about = [F.any_value(c).alias(c) for c in ("threshold", "_n", "_m", "_mean", "_top", "_grid")]
        summed = matched(over, gridded, keys).groupBy(*keys).agg(*about, *logs)
        summed = summed.withColumn("_shapes", F.transform(F.array(*(f"_log{k}" for k in range(n))), lambda x: x / F.col("_m")))

        def likelihood(theta: Column, shape: Column) -> Column:
            found = F.when(F.abs(theta) < 1e-12, -F.col("_m") * (F.log(F.col("_mean")) + 1)).otherwise(-F.col("_m") * (F.log(shape / theta) + shape + 1))
            return F.when(F.isnan(found) | found.isNull(), F.lit(float("-inf"))).otherwise(found)

        at = summed.withColumn("_fit", F.zip_with("_grid", "_shapes", likelihood)).withColumn("_k", F.array_position("_fit", F.array_max("_fit")).cast("int"))
        pick = lambda k: F.element_at("_grid", F.greatest(F.lit(1), F.least(F.lit(n), F.col("_k") + k)))
        return at.select(*keys, "threshold", "_n", "_m", "_mean", "_top", pick(0).alias("_theta"), pick(-1).alias("_a"), pick(1).alias("_b"), F.element_at("_shapes", F.col("_k")).alias("_shape"))

    told = stored(best(about, *_first_grid(), 2 * SIDE + 1), "fits")
    for _ in range(ROUNDS):
        told = stored(best(told, *_refined(), STEPS + 1), "fits")
    none = F.abs("_theta") < 1e-12
    return told.select(*keys, "threshold", F.when(none, 0.0).otherwise(F.col("_shape")).alias("shape"), F.when(none, F.col("_mean")).otherwise(F.col("_shape") / F.col("_theta")).alias("scale"), (F.col("_m") / F.col("_n")).alias("p_exceed"), F.col("_m").alias("n_exceed"))


def sample_counts(df: DataFrame, keys: tuple[str, ...], score: str) -> DataFrame:
    """Rows `keys, _key, _m`: how often each score (as its ordered key) occurs."""
    return df.groupBy(*keys, ordered_key(_filled(score)).alias("_key")).agg(F.count("*").alias("_m"))


def with_tail_ranks(df: DataFrame, keys: tuple[str, ...], score: str, counts: DataFrame) -> DataFrame:
    """df with `p_rank`: the share of its key's sample (sample_counts) that is as large as the score or larger; null for keys without a sample.

    Distinct scores of both sides are merged in order: they are counted inside ranges of
    their leading bits, and what comes before each range is carried over from a small
    table. Rows only look up their score's count, so ties are no hot window.
    """
    rows = df.withColumn("_key", ordered_key(_filled(score)))
    both = counts.union(rows.select(*keys, "_key", F.lit(0).cast("long"))).groupBy(*keys, "_key").agg(F.sum("_m").alias("_m")).withColumn("_p", F.shiftright("_key", RANGE_BITS))
    both = stored(both, "merged-scores")
    ranges = both.groupBy(*keys, "_p").agg(F.sum("_m").alias("_in"))
    w = Window.partitionBy(*keys)
    before = ranges.select(*keys, "_p", F.coalesce(F.sum("_in").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_in").over(w).alias("_n"))
    inside = F.coalesce(F.sum("_m").over(Window.partitionBy(*keys, "_p").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = matched(both.withColumn("_below", inside), before, (*keys, "_p"))
    share = placed.select(*keys, "_key", (1 - (F.col("_before") + F.col("_below")) / F.nullif(F.col("_n"), F.lit(0))).alias("p_rank"))
    return matched(rows, share, (*keys, "_key")).drop("_key")


def empirical_tail(df: DataFrame, keys: tuple[str, ...], score: str, train: Column | None = None) -> DataFrame:
    """df with `p_rank`: the share of the key's scores (of its `train` rows, if given) that are as large or larger; missing scores count as 0."""
    return with_tail_ranks(df, keys, score, sample_counts(df if train is None else df.filter(train), keys, score))


class Calibration:
    """What p-values of residuals need from a sample: the fitted tail, how often each score occurs and the robust scale, one table each."""

    PARTS = ("tail", "counts", "scale")

    def __init__(self, keys: tuple[str, ...], **tables: DataFrame) -> None:
        self.keys, self.tables = keys, tables

    @classmethod
    def of(cls, df: DataFrame, keys: tuple[str, ...], score: str, quantile: float = 0.9) -> Calibration:
        """From all rows of df: give it a training part to judge other rows by that part."""
        sized = df.select(*keys, _filled(score).alias(score), F.abs(_filled(score)).alias("_size"))
        return cls(keys, tail=gpd_fit(sized, keys, score, quantile), counts=sample_counts(sized, keys, score), scale=exact_quantiles(stored(sized, "scores"), keys, {"scale": ("_size", 0.5)}))

    def write(self, path: str) -> None:
        for part in self.PARTS:
            self.tables[part].write.parquet(f"{path}/{part}")

    @classmethod
    def read(cls, spark: SparkSession, path: str, keys: tuple[str, ...]) -> Calibration:
        return cls(keys, **{part: spark.read.parquet(f"{path}/{part}") for part in cls.PARTS})

    def judge(self, df: DataFrame, score: str) -> DataFrame:
        """df with `p_robust`, the two-sided tail over the scale, and `p_gpd`: the fitted tail above its threshold, the rank share below. Null for keys that the sample lacks."""
        x = _filled(score)
        out = with_tail_ranks(df, self.keys, score, self.tables["counts"])
        out = matched(matched(out, self.tables["scale"], self.keys, "left").withColumnRenamed("scale", "_t"), self.tables["tail"], self.keys, "left")
        tail = F.col("p_exceed") * gpd_sf(x - F.col("threshold"), F.col("shape"), F.col("scale"))
        out = out.withColumns({"p_robust": 2 * t4_sf(x / (F.nullif(F.col("_t"), F.lit(0.0)) / T4_QUARTILE)), "p_gpd": F.when(x > F.col("threshold"), tail).otherwise(F.col("p_rank"))})
        return out.drop("_t", "threshold", "shape", "scale", "p_exceed", "n_exceed", "p_rank")


def gpd_pvalues(df: DataFrame, keys: tuple[str, ...], score: str, quantile: float = 0.9, train: Column | None = None) -> DataFrame:
    """df with `p_gpd`, fitted and ranked in the rows of `train` (default: all)."""
    sample = df if train is None else df.filter(train)
    out = matched(empirical_tail(df, keys, score, train), gpd_fit(sample, keys, score, quantile), keys, "left")
    x = _filled(score)
    tail = F.col("p_exceed") * gpd_sf(x - F.col("threshold"), F.col("shape"), F.col("scale"))
    return out.withColumn("p_gpd", F.when(x > F.col("threshold"), tail).otherwise(F.col("p_rank"))).drop("threshold", "shape", "scale", "p_exceed", "n_exceed", "p_rank")
