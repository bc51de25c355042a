"""Evaluation as aggregations: one pass for counts, windows only where ranks are needed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maregraph.operators.series import Series


def _r(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def binary_metrics(df: DataFrame, truth: Column, flagged: Column, by: tuple[str, ...] = ()) -> DataFrame:
    t, f = truth.cast("long"), flagged.cast("long")
    out = df.groupBy(*by).agg(F.sum(t * f).alias("tp"), F.sum((1 - t) * f).alias("fp"), F.sum(t * (1 - f)).alias("fn"), F.sum(f).alias("detected"), F.sum(t).alias("true_anomalies"))
    precision, recall = _r(F.col("tp"), F.col("tp") + F.col("fp")), _r(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": precision, "recall": recall, "f1": _r(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def confusion(df: DataFrame, truth: str, predicted: str, classes: int = 3) -> DataFrame:
    """Rows `truth, predicted, n` for all pairs of classes."""
    spark = df.sparkSession
    spine = spark.range(classes).select(F.col("id").cast("int").alias("truth")).join(spark.range(classes).select(F.col("id").cast("int").alias("predicted")))
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return spine.join(F.broadcast(counts), ["truth", "predicted"], "left").fillna(0, ["n"])  # at most classes squared rows


def class_f1(confused: DataFrame) -> DataFrame:
    """Rows `class, support, predicted_n, f1` from confusion()."""
    rows = confused.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    columns = confused.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted_n"))
    out = rows.join(columns, "class")
    return out.select("class", "support", "predicted_n", "hit", _r(2 * F.col("hit"), F.col("support") + F.col("predicted_n")).alias("f1"))


def multiclass_summary(confused: DataFrame) -> DataFrame:
    """macro_f1 over classes present on either side, weighted_f1, balanced_accuracy and Matthews' coefficient."""
    f = class_f1(confused)
    present = (F.col("support") + F.col("predicted_n")) > 0
    out = f.agg(
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1"),
        _r(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("hit") / F.col("support"))).alias("balanced_accuracy"),
        F.sum("hit").cast("double").alias("_c"), F.sum("support").cast("double").alias("_s"),
        F.sum(F.col("support").cast("double") * F.col("predicted_n")).alias("_tp"), F.sum(F.col("support").cast("double") * F.col("support")).alias("_tt"), F.sum(F.col("predicted_n").cast("double") * F.col("predicted_n")).alias("_pp"),
    )
    s2 = F.col("_s") * F.col("_s")
    mcc = _r(F.col("_c") * F.col("_s") - F.col("_tp"), F.sqrt((s2 - F.col("_pp")) * (s2 - F.col("_tt"))))
    return out.select("macro_f1", "weighted_f1", "balanced_accuracy", mcc.alias("mcc"))


def collapsed(df: DataFrame, truth: str, predicted: str, classes: int = 3) -> DataFrame:
    """One row of the classes' macro_f1 and balanced_accuracy, and of precision, recall and binary_f1 of class 0 against the rest.

    All follow from the confusion counts, so rows are read once. Without rows the
    first two are null and the others 0.
    """
    confused = confusion(df, truth, predicted, classes)
    whole = multiclass_summary(confused).select("macro_f1", "balanced_accuracy")
    both = lambda t, p: F.coalesce(F.sum(F.when(t & p, F.col("n"))), F.lit(0))
    bad, said = F.col("truth") > 0, F.col("predicted") > 0
    counts = confused.agg(both(bad, said).alias("tp"), both(~bad, said).alias("fp"), both(bad, ~said).alias("fn"))
    rates = counts.select(_r(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _r(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), _r(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("binary_f1"))
    return whole.join(F.broadcast(rates))  # one row each


def ranking(df: DataFrame, truth: Column, score: str, by: tuple[str, ...]) -> DataFrame:
    """Rows `by, auroc, average_precision`: ties share their mean rank and one step; null where a class is missing.

    Rows meet as one row for each distinct score, so windows run over those.
    """
    grouped = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(truth.cast("long")).alias("p"), F.count("*").alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    out = grouped.withColumns({"tp": F.sum("p").over(down), "seen": F.sum("n").over(down)})
    neg = F.col("n") - F.col("p")
    # negatives below a positive, and half of those that tie
    whole = Window.partitionBy(*by)
    out = out.withColumns({"all_p": F.sum("p").over(whole), "all_n": F.sum(neg).over(whole)})
    below = F.col("all_n") - (F.col("seen") - F.col("tp"))
    pairs = F.sum(F.col("p") * (below + neg / 2))
    ap = F.sum(F.col("p") * F.col("tp") / F.col("seen"))
    out = out.groupBy(*by).agg(pairs.alias("_u"), ap.alias("_a"), F.first("all_p").alias("_p"), F.first("all_n").alias("_q"))
    ok = (F.col("_p") > 0) & (F.col("_q") > 0)
    return out.select(*by, F.when(ok, F.col("_u") / (F.col("_p") * F.col("_q"))).alias("auroc"), F.when(ok, F.col("_a") / F.col("_p")).alias("average_precision"))


def calibration_error(df: DataFrame, confidence: Column, right: Column, bins: int = 10) -> DataFrame:
    """One row `ece`: bins are (lo, hi]; a confidence of 0 is in none."""
    b = F.ceil(confidence * bins)
    rows = df.select(b.alias("b"), confidence.alias("c"), right.cast("double").alias("r"))
    total = rows.groupBy("b").agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("r").alias("r"))
    return total.agg((F.sum(F.when(F.col("b") > 0, F.col("n") * F.abs(F.col("c") - F.col("r"))).otherwise(0.0)) / F.sum("n")).alias("ece"))


def forecast_errors(df: DataFrame, observed: Column, predicted: Column, by: tuple[str, ...], least: float = 1e-6) -> DataFrame:
    """mae, mse, rmse and mape (rows of |observed| below `least` left out)."""
    e = observed - predicted
    mse = F.avg(e * e)
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), (100 * F.avg(F.when(F.abs(observed) >= least, F.abs(e / observed)))).alias("mape"), F.count(e).alias("n"))


def variance_allocation(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Shares, in per cent, of a crossed table's variation: rows, columns and the rest."""
    every = Window.partitionBy(F.lit(1))
    out = df.groupBy(row, column).agg(F.avg(value).alias("v"))
    out = out.withColumns({"_r": F.avg("v").over(Window.partitionBy(row)), "_c": F.avg("v").over(Window.partitionBy(column)), "_g": F.avg("v").over(every)})
    d = lambda c: F.sum(F.pow(F.col(c) - F.col("_g"), 2))
    out = out.agg(d("v").alias("t"), d("_r").alias("r"), d("_c").alias("c"))
    base = F.greatest(F.col("t"), F.lit(1e-12))
    return out.select((100 * F.col("r") / base).alias("pct_rows"), (100 * F.col("c") / base).alias("pct_columns"), (100 * F.greatest(F.lit(0.0), F.col("t") - F.col("r") - F.col("c")) / base).alias("pct_rest"))


def onsets(df: DataFrame, s: Series, family: str, flagged: Column) -> DataFrame:
    """Rows `letter, rate, n_events`: whether the first row of each run with a family is flagged."""
    inside = F.col(family) != ""
    first = inside & ~F.coalesce(F.lag(inside).over(s.window), F.lit(False))
    rows = df.withColumn("_first", first).withColumn("_hit", flagged.cast("double")).filter("_first")
    return rows.groupBy(F.split_part(F.col(family), F.lit("_"), F.lit(1)).alias("letter")).agg(F.avg("_hit").alias("rate"), F.count("*").alias("n_events"))


def stream_metrics(df: DataFrame, s: Series, truth: str, predicted: str) -> DataFrame:
    """False alarms over GOOD rows, and the mean share flagged of each run of others, for each series."""
    clean, hit = F.col(truth) == "GOOD", F.col(predicted) != "GOOD"
    rows = df.withColumns({"_clean": clean.cast("long"), "_hit": hit.cast("long")}).withColumn("_run", F.sum("_clean").over(s.window.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*s.keys, "_run").agg(F.sum("_clean").alias("clean"), F.sum(F.col("_clean") * F.col("_hit")).alias("alarms"), F.count("*").alias("n"), F.sum("_hit").alias("hits"))
    share = F.when(F.col("n") > F.col("clean"), (F.col("hits") - F.col("alarms")) / (F.col("n") - F.col("clean")))
    out = runs.withColumn("share", share).groupBy(*s.keys).agg(F.sum("clean").alias("n_clean"), F.sum("alarms").alias("false_alarms"), F.count("share").alias("n_episodes"), F.coalesce(100 * F.avg("share"), F.lit(0.0)).alias("mean_coverage_pct"))
    return out.withColumn("false_alarm_pct", 100.0 * F.col("false_alarms") / F.greatest(F.col("n_clean"), F.lit(1)))


def first_offsets(df: DataFrame, by: tuple[str, ...], offset: str, suspect: Column, bad: Column, last: int) -> DataFrame:
    """Each event's `first_suspect_offset` and `first_bad_offset` from 0 on (null: censored), and the share of its rows from 0 to `last` that are suspect."""
    o, inside = F.col(offset), (F.col(offset) >= 0) & (F.col(offset) <= last)
    return df.groupBy(*by).agg(
        F.min(F.when(suspect & (o >= 0), o)).alias("first_suspect_offset"),
        F.min(F.when(bad & (o >= 0), o)).alias("first_bad_offset"),
        F.avg(F.when(inside, suspect.cast("double"))).alias("detection_proportion"),
    )


def causality_violations(df: DataFrame, s: Series, label: Callable[[DataFrame, Series], Column], chosen: Column, shock: Column) -> DataFrame:
    """One row `n_windows, violation_rate`: how often the label of a chosen row changes when the row after it moves by `shock`."""
    nearly = df.withColumn("_chosen", chosen).withColumn("_shock", F.coalesce(F.lag("_chosen").over(s.window), F.lit(False)))
    base = nearly.withColumn("_base", label(nearly, s))
    moved = base.withColumn(s.value, F.when(F.col("_shock"), s.x + shock).otherwise(s.x))
    moved = moved.withColumn("_moved", label(moved, s)).filter("_chosen")
    return moved.agg(F.count("*").alias("n_windows"), F.avg((~F.col("_base").eqNullSafe(F.col("_moved"))).cast("double")).alias("violation_rate"))


def gates(df: DataFrame, by: tuple[str, ...], monotonicity: Column, macro_f1: Column, binary_f1: Column, reference: float = 0.75, least_monotonic: float = 0.9, most_spread: float = 0.05) -> DataFrame:
    """The acceptance gates of runs: monotonicity and binary F1 by their means, the spread of macro F1; and whether all hold."""
    out = df.groupBy(*by).agg((F.avg(monotonicity) >= least_monotonic).alias("monotonic"), (F.stddev_samp(macro_f1) < most_spread).alias("stable"), (F.avg(binary_f1) > reference).alias("above_reference"))
    return out.withColumn("accepted", F.coalesce(F.col("monotonic") & F.col("stable") & F.col("above_reference"), F.lit(False)))


#: Poisson(1): probability of at most k, to where it is 1 in doubles.
POISSON = tuple(accumulate(exp(-1) / factorial(k) for k in range(19)))
PRIME = (1 << 31) - 1


def bootstrap_mean(df: DataFrame, by: tuple[str, ...], value: str, ids: tuple[str, ...], resamples: int = 2000, seed: int = 2026) -> DataFrame:
    """Mean and its 95 % interval over `resamples` Poisson(1) resamples.

    A row's weights follow from its `ids`, the resample and the seed alone. Tasks add up
    arrays of weights and of weighted values, so what moves is two arrays for each group
    and task, whatever the rows.
    """
    key = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in ids)).cast("binary")), 1, 7), 16, 10).cast("long")
    rows = df.select(*by, F.col(value).cast("double").alias("_v"), key.alias("_k")).filter("_v is not null")
    b = np.arange(1, resamples + 1, dtype=np.int64)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for name, own in pdf.groupby(list(by), dropna=False):
                to = held.setdefault(tuple(None if x is None or x != x else x for x in name), np.zeros((2, resamples)))
                for lo in range(0, len(own), 256):
                    k, v = (own[c].to_numpy()[lo : lo + 256] for c in ("_k", "_v"))
                    x = (k[:, None] * 48271 + b * 40692 + seed) % PRIME
                    for _ in range(2):
                        x = (x * x % PRIME * 16807 + x * 69621 + b) % PRIME
                    weight = np.searchsorted(POISSON, (x + 0.5) / PRIME, "right").astype(np.float64)
                    to += np.stack([weight.sum(axis=0), v @ weight])
        for name, (w, wv) in held.items():
            yield pd.DataFrame([dict(zip(by, name, strict=True)) | {"w": w, "wv": wv}])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    parts = rows.mapInPandas(sums, f"{kinds}, w array<double>, wv array<double>").select(*by, F.posexplode(F.arrays_zip("w", "wv")).alias("b", "x"))
    means = parts.groupBy(*by, "b").agg((F.sum("x.wv") / F.nullif(F.sum("x.w"), F.lit(0.0))).alias("m"))
    spread = means.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return rows.groupBy(*by).agg(F.avg("_v").alias("mean")).join(spread, list(by))
