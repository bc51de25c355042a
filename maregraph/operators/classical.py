"""The seven tests of a series, its quality index, z-score and Q-Dixon flags, and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from maregraph.functions.scalar import MAD_TO_SIGMA, clip, decision, final_class, flag, q_class, quality_class, ratio, z_class
from maregraph.operators.quantiles import with_quantiles
from maregraph.operators.series import Series, micros, over_key, with_statistics
from maregraph.operators.work import stored

# Fixed values of the tests.
WINDOW, LEAST = 49, 12
MAD_FLAG, QARTOD_FLAG, LOCAL_STD_FLAG = 6, 8, 4
TESTS = ("classic", "mad", "second_difference", "qartod", "roc", "local_std", "range")
#: second_difference is twice classic, and qartod is part of mad: without them tests are independent.
INDEPENDENT = ("classic", "mad", "roc", "local_std", "range")


def classic_spike(s: Series) -> Column:
    return F.abs(s.x - (F.lag(s.x).over(s.window) + F.lead(s.x).over(s.window)) / 2)


def second_difference(s: Series) -> Column:
    return F.abs(F.lead(s.x).over(s.window) - 2 * s.x + F.lag(s.x).over(s.window))


def step_hours(s: Series) -> Column:
    t = micros(F.col(s.order[0]))
    return (t - F.lag(t).over(s.window)) / 3.6e9


def over_window(value: Column, s: Series, what: str, window: int = WINDOW, least: int = LEAST) -> Column:
    """median, avg or std of a centred frame of rows that holds `least` values."""
    frame = s.window.rowsBetween(-(window // 2), window // 2)
    found = {"median": F.percentile(value, F.lit(0.5)), "avg": F.avg(value), "std": F.stddev_samp(value)}[what]
    return F.when(F.count(value).over(frame) >= least, found.over(frame))


def scores(df: DataFrame, s: Series) -> DataFrame:
    """df with classic_score, second_difference_score, step and step_hours (to the row before), mad_score and local_std_score: sorted passes over one partitioning, in frames of rows only."""
    out = df.withColumns({"classic_score": classic_spike(s), "second_difference_score": second_difference(s), "step": F.abs(s.x - F.lag(s.x).over(s.window)), "step_hours": step_hours(s)})
    c = F.col("classic_score")
    out = out.withColumns({"_med": over_window(c, s, "median"), "_mean": over_window(c, s, "avg"), "_std": over_window(c, s, "std")})
    out = out.withColumn("_dev", F.abs(c - F.col("_med")))
    out = out.withColumn("_mad", over_window(F.col("_dev"), s, "median"))
    out = out.withColumns({"mad_score": ratio(c, MAD_TO_SIGMA * F.col("_mad")), "local_std_score": ratio(F.abs(c - F.col("_mean")), F.col("_std"))})
    return out.drop("_med", "_mean", "_std", "_dev", "_mad")


def tested(df: DataFrame, s: Series, ranges: dict[str, tuple[float, float]] | None = None, roc_limits: dict[str, float] | None = None, variable: str = "variable", tests: tuple[str, ...] = TESTS) -> DataFrame:
    """scores() with thresholds, roc_per_hour, flag_<test>, flag_count, removed, suspect, quality_index and quality_class.

    Ranges and rate limits that aren't given for a variable are quantiles of the series.
    The scores are stored; their quantiles, of series of any length, come from counting
    passes over that table, so no task holds the values of a series.
    """
    scored = stored(scores(df, s), "scores")
    limits = {"classic_p995": ("classic_score", 0.995), "second_p995": ("second_difference_score", 0.995), "roc_limit": ("step", 0.995), "range_min": (s.value, 0.001), "range_max": (s.value, 0.999), "_hours": ("step_hours", 0.5)}
    usual = F.when(F.col("_hours") > 0, F.col("_hours")).otherwise(0.5)
    out = with_quantiles(scored, s.keys, limits, per={"roc_limit": lambda step: step / usual})
    out = out.withColumn("roc_per_hour", F.col("step") / usual).drop("_hours", "step", "step_hours")
    for name, value in (roc_limits or {}).items():
        out = out.withColumn("roc_limit", F.when(F.col(variable) == name, value).otherwise(F.col("roc_limit")))
    for name, (lo, hi) in (ranges or {}).items():
        out = out.withColumns({"range_min": F.when(F.col(variable) == name, lo).otherwise(F.col("range_min")), "range_max": F.when(F.col(variable) == name, hi).otherwise(F.col("range_max"))})
    made = {
        "classic": F.col("classic_score") > F.col("classic_p995"),
        "mad": F.col("mad_score") > MAD_FLAG,
        "second_difference": F.col("second_difference_score") > F.col("second_p995"),
        "qartod": F.col("mad_score") > QARTOD_FLAG,
        "roc": F.col("roc_per_hour") > F.col("roc_limit"),
        "local_std": F.col("local_std_score") > LOCAL_STD_FLAG,
        "range": (s.x < F.col("range_min")) | (s.x > F.col("range_max")),
    }
    out = out.withColumns({f"flag_{t}": flag(c) for t, c in made.items()})
    count = sum((F.col(f"flag_{t}").cast("long") for t in tests), F.lit(0).cast("long"))
    out = out.withColumn("flag_count", count).withColumns({"removed": F.col("flag_range") | (F.col("flag_count") >= 3), "suspect": F.col("flag_count") >= 1})
    parts = F.greatest(
        ratio(F.col("classic_score"), F.col("classic_p995")), F.col("mad_score") / QARTOD_FLAG, ratio(F.col("second_difference_score"), F.col("second_p995")),
        ratio(F.col("roc_per_hour"), F.col("roc_limit")), F.col("local_std_score") / LOCAL_STD_FLAG,
    )
    out = out.withColumn("_composite", F.greatest(parts, F.when(parts.isNotNull(), 0.0)))
    out = with_quantiles(out, s.keys, {"_top": ("_composite", 0.999)})
    top = F.when(F.col("_top") == 0, 1.0).otherwise(F.coalesce("_top", F.lit(1.0)))
    out = out.withColumn("quality_index", clip(100 * (1 - F.col("_composite") / top), 0, 100))
    return out.withColumn("quality_class", quality_class(F.col("quality_index"))).drop("_composite", "_top")


def month_quantile(df: DataFrame, s: Series, q: float = 0.99) -> DataFrame:
    """df with classic_score and its quantile within the series' calendar month."""
    out = df.withColumns({"classic_score": classic_spike(s), "month": F.month(s.order[0])})
    return with_quantiles(stored(out, "scores"), (*s.keys, "month"), {"month_limit": ("classic_score", q)})


def _z(df: DataFrame, s: Series) -> DataFrame:
    return df.withColumn("z", ratio(s.x - F.col("mu"), F.col("sigma"))).withColumn("dixon_flag", z_class(F.col("z")))


def global_z(df: DataFrame, s: Series) -> DataFrame:
    """Rows with a value, with z of the whole series (sample deviation) and its class `dixon_flag`."""
    return _z(with_statistics(df.filter(s.x.isNotNull()), s.keys, mu=F.avg(s.x), sigma=F.stddev_samp(s.x)), s)


def _q(df: DataFrame, s: Series, window: int, least: int, edges: str, w: WindowSpec) -> DataFrame:
    h = window // 2
    out = df.withColumn("_raw", F.collect_list(s.x).over(w.rowsBetween(-h, h))).withColumn("_sorted", F.array_sort("_raw"))
    n = F.size("_raw")
    centre = s.x if edges == "exact" else F.try_element_at("_raw", (F.floor(n / 2) + 1).cast("int"))
    low, high = F.try_element_at("_sorted", F.lit(1)), F.try_element_at("_sorted", F.lit(-1))
    gap = F.when(centre == high, high - F.try_element_at("_sorted", F.lit(-2))).when(centre == low, F.try_element_at("_sorted", F.lit(2)) - low).otherwise(0.0)
    q = F.when(n < least, None).when(high == low, 0.0).otherwise(gap / (high - low))
    return out.withColumn("q", q).withColumn("q_dixon_flag", q_class(F.col("q"))).drop("_raw", "_sorted")


def q_dixon(df: DataFrame, s: Series, window: int = 11, least: int = 5, edges: str = "cut") -> DataFrame:
    """Rows with a value, with the gap ratio `q` of the frame's centre and its class `q_dixon_flag`.

    A frame cut short at an end has its centre at half its own length with edges="cut",
    at the row itself with "exact".
    """
    return _q(df.filter(s.x.isNotNull()), s, window, least, edges, s.window)


def classified(df: DataFrame, s: Series) -> DataFrame:
    """All rows with the classes of global_z and q_dixon (MISSING without a value), computed where the rows are: rows with a value have frames of their own."""
    out = _z(over_key(df, s.keys, mu=F.avg(s.x), sigma=F.stddev_samp(s.x)), s).withColumn("_has", s.x.isNotNull())
    return _q(out, s, 11, 5, "cut", Window.partitionBy(*s.keys, "_has").orderBy(*s.order)).drop("_has", "mu", "sigma")


def consolidated(df: DataFrame, s: Series, **options) -> DataFrame:
    """tested() with z and Q-Dixon flags of the same rows, `decision` and `final_class`: one partitioning, no join."""
    out = classified(tested(df, s, **options), s)
    some = F.col("flag_classic") | F.col("flag_mad") | F.col("flag_second_difference") | F.col("flag_qartod") | F.col("flag_roc") | F.col("flag_local_std")
    out = out.withColumn("decision", decision(s.x, F.col("flag_range"), F.col("quality_class"), F.col("dixon_flag"), F.col("q_dixon_flag"), F.col("removed"), some, F.col("quality_index")))
    return out.withColumn("final_class", final_class(F.col("decision"), F.col("quality_class")))


def bad_events(flagged: DataFrame, s: Series, flag_col: str, score_col: str) -> DataFrame:
    """Runs of BAD rows: start, end, n_points, min_value, max_value, max_score, event_type."""
    bad = F.col(flag_col) == "BAD"
    w = s.window
    run = flagged.withColumn("_bad", bad.cast("int")).withColumn("_new", (F.col("_bad") != F.coalesce(F.lag("_bad").over(w), F.lit(-1))).cast("int"))
    run = run.withColumn("_run", F.sum("_new").over(w)).filter("_bad = 1")
    out = run.groupBy(*s.keys, "_run").agg(F.min(s.order[0]).alias("start"), F.max(s.order[0]).alias("end"), F.count("*").alias("n_points"), F.min(s.x).alias("min_value"), F.max(s.x).alias("max_value"), F.max(F.abs(F.col(score_col))).alias("max_score"))
    kind = F.when(F.col("n_points") >= 2, "possible_physical_event").otherwise("possible_instrumental_spike")
    return out.withColumn("event_type", kind).drop("_run")


def top_rows(df: DataFrame, keys: tuple[str, ...], by: str, ties: tuple[str, ...], n: int = 10, largest: bool = True) -> DataFrame:
    order = F.desc_nulls_last(by) if largest else F.asc_nulls_last(by)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ties))).filter(F.col("rank") <= n)
