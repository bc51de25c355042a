"""Indicators that read no later row: trailing robust scores, memory of residuals, runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maregraph.functions.scalar import MAD_TO_SIGMA
from maregraph.operators.chunked import chunked
from maregraph.operators.series import Series, over_key
from maregraph.operators.work import matched, stored

# Fixed values of the indicators.
EWMA_RATES = (0.1, 0.3, 0.6)
SLOPE_WINDOWS = (6, 12, 24, 48)
CUSUM_SLACK, CUSUM_RESET = 0.5, 20.0


_NUMBERS = T.StructType([T.StructField("med", T.DoubleType()), T.StructField("mad", T.DoubleType())])


@F.arrow_udf(_NUMBERS)
def _median_mad(frames: pa.Array) -> pa.Array:
    """The median of each list (of no nulls, not empty) and that of the distances to it."""
    offsets = frames.offsets.to_numpy()
    n = np.diff(offsets)
    values = np.full((len(frames), max(1, int(n.max(initial=0)))), np.nan)  # which sorts behind all others
    values[np.arange(values.shape[1]) < n[:, None]] = frames.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    at, rows = (np.maximum((n + 1) // 2 - 1, 0), np.maximum((n + 2) // 2 - 1, 0)), np.arange(len(n))

    def median(x: np.ndarray) -> np.ndarray:
        x = np.sort(x, axis=1)
        return (x[rows, at[0]] + x[rows, at[1]]) / 2

    with np.errstate(invalid="ignore"):
        med = median(values)
        mad = median(np.abs(values - med[:, None]))
    return pa.StructArray.from_arrays([pa.array(med), pa.array(mad)], ["med", "mad"])


def _trailing(s: Series, value: Column, window: int = 24) -> Column:
    """The `window` values before each row that aren't null."""
    return F.collect_list(value.cast("double")).over(s.window.rowsBetween(-window, -1))


def _with_median_mad(df: DataFrame, frame: str, least: int) -> DataFrame:
    found = F.when(F.size(frame) >= least, _median_mad(F.col(frame)))
    return df.withColumn("_found", found).withColumns({"_med": F.col("_found.med"), "_mad": F.col("_found.mad")}).drop("_found", frame)


def trailing_median_mad(df: DataFrame, value: str, s: Series, window: int = 24, least: int = 3) -> DataFrame:
    """df with `_med` and `_mad` (about the frame's own median) of the `window` rows before each; null below `least` values."""
    return _with_median_mad(df.withColumn("_frame", _trailing(s, F.col(value), window)), "_frame", least)


def _distance(x: Column) -> Column:
    return F.coalesce(x / (MAD_TO_SIGMA * F.col("_mad") + 1e-6), F.lit(0.0))


def level_score(df: DataFrame, s: Series) -> DataFrame:
    return trailing_median_mad(df, s.value, s).withColumn("level_score", _distance(F.abs(s.x - F.col("_med")))).drop("_med", "_mad")


def _acceleration(s: Series) -> Column:
    return s.x - 2 * F.lag(s.x).over(s.window) + F.lag(s.x, 2).over(s.window)


def acceleration_score(df: DataFrame, s: Series) -> DataFrame:
    out = trailing_median_mad(df.withColumn("_acc", _acceleration(s)), "_acc", s)
    return out.withColumn("acc_score", _distance(F.abs("_acc"))).drop("_acc", "_med", "_mad")


def trailing_scores(df: DataFrame, s: Series, least: int = 3) -> DataFrame:
    """df with level_score and acc_score: both frames are taken in one sorting of the series, before any row goes to Python."""
    out = df.withColumn("_acc", _acceleration(s)).withColumns({"_frame": _trailing(s, s.x), "_acc_frame": _trailing(s, F.col("_acc"))})
    out = _with_median_mad(out, "_frame", least).withColumn("level_score", _distance(F.abs(s.x - F.col("_med"))))
    return _with_median_mad(out, "_acc_frame", least).withColumn("acc_score", _distance(F.abs("_acc"))).drop("_acc", "_med", "_mad")


def rate(s: Series) -> Column:
    return F.coalesce(F.abs(s.x - F.lag(s.x).over(s.window)), F.lit(0.0))


def clipped_sums(steps: np.ndarray, start: float, limit: float) -> np.ndarray:
    """Running sums from `start` that never fall below 0 and are 0 again where they would pass `limit`: whole stretches between resets at once."""
    out, at = np.empty(len(steps)), 0
    while at < len(steps):
        total = start + np.cumsum(steps[at : at + 4096])
        above = total - np.minimum(0.0, np.minimum.accumulate(total))
        over = np.flatnonzero(above > limit)
        n = int(over[0]) if len(over) else len(above)
        out[at : at + n] = above[:n]
        if len(over):
            out[at + n] = start = 0.0
            n += 1
        else:
            start = above[-1]
        at += n
    return out


def clipped_map(steps: np.ndarray, limit: float) -> tuple[float, float, list[float], list[float]]:
    """What clipped_sums(steps, start, limit) ends in, as a function of its start: `shift, floor, cuts, ends`.

    A start above cuts[k], but not above cuts[k - 1], is first reset where the sums of the
    steps reach their k-th new height, and goes on from 0 to ends[k]. Every other start
    ends in max(start + shift, floor).
    """
    sums = np.cumsum(steps)
    above = sums - np.minimum(0.0, np.minimum.accumulate(sums)) if len(sums) else sums
    over = np.flatnonzero(above > limit)
    stop = int(over[0]) if len(over) else len(sums)
    after = lambda i: float(clipped_sums(steps[i + 1 :], 0.0, limit)[-1]) if i + 1 < len(steps) else 0.0
    highs = np.maximum.accumulate(np.concatenate([[0.0], sums[:stop]]))
    records = np.flatnonzero(highs[1:] > highs[:-1])
    shift, floor = (-np.inf, after(stop)) if len(over) else (float(sums[-1]), float(above[-1])) if len(sums) else (0.0, 0.0)
    return shift, floor, (limit - sums[records]).tolist(), [after(i) for i in records.tolist()]


def through(start: float, shift: float, floor: float, cuts: list[float], ends: list[float]) -> float:
    """The end of a start by clipped_map(); cuts fall."""
    lo, hi = 0, len(cuts)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if start > cuts[mid] else (mid + 1, hi)
    return ends[lo] if lo < len(cuts) else max(start + shift, floor)


def recursive_memory(
    df: DataFrame, s: Series, residual: str, keep: tuple[str, ...], rates: tuple[float, ...] = EWMA_RATES, slack: float = CUSUM_SLACK, reset: float = CUSUM_RESET, rows: int = 100_000, bucket: Column | None = None
) -> DataFrame:
    """`keep` columns with ewma_<k> and cusum_pos, cusum_neg.

    Null residuals count as 0. The averages start at the first residual, the sums at 0
    (without the first residual) and again at 0 when they pass `reset` deviations.

    A prefix scan: a series is cut into chunks of `rows` rows (`bucket` as for numbered(),
    by default the day). Each chunk tells what it makes of any value that enters it, an
    affine map for an average and a clipped_map for a sum; these maps, some numbers for
    each chunk, are composed in order to what does enter, and then all chunks are
    computed at once. No task holds more than a chunk of a series.
    """
    kept = [*dict.fromkeys([*s.keys, *s.order, *keep])]
    e = F.coalesce(F.col(residual).cast("double"), F.lit(0.0))
    narrow = df.select(*kept, e.alias("_e"))
    deviation = narrow.groupBy(*s.keys).agg(F.coalesce(F.nullif(F.stddev_samp("_e"), F.lit(0.0)), F.lit(1e-6)).alias("_sd"))
    at = stored(chunked(matched(narrow, deviation, s.keys), s, rows, bucket), "chunks")
    group, names, n_rates = [*s.keys, "_chunk"], [f"ewma_{k}" for k in range(len(rates))], len(rates)
    order = [(c, "ascending") for c in s.order]

    def steps(chunk: pa.Table) -> tuple[np.ndarray, list[np.ndarray], float]:
        """Residuals, the steps of both sums (none for the first row of a series) and the limit."""
        x, sigma = chunk["_e"].to_numpy(), chunk["_sd"][0].as_py()
        both = [sign * x - slack * sigma for sign in (1, -1)]
        return x, [d[1:] if chunk["_chunk"][0].as_py() == 0 else d for d in both], reset * sigma

    def averages(x: np.ndarray, starts: list[float]) -> list[np.ndarray]:
        return [pd.Series(np.concatenate([[y], x])).ewm(alpha=a, adjust=False).mean().to_numpy()[1:] for a, y in zip(rates, starts, strict=True)]

    def summary(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by(order)
        x, both, limit = steps(chunk)
        sums = [clipped_map(d, limit) for d in both]
        columns = {"first": [float(x[0])], "offsets": [[float(y[-1]) for y in averages(x, [0.0] * n_rates)]], "scales": [[(1 - a) ** len(x) for a in rates]]}
        columns |= {"shifts": [[m[0] for m in sums]], "floors": [[m[1] for m in sums]], "cuts": [[m[2] for m in sums]], "ends": [[m[3] for m in sums]]}
        kinds = {"first": pa.float64(), **{c: pa.list_(pa.float64()) for c in ("offsets", "scales", "shifts", "floors")}, **{c: pa.list_(pa.list_(pa.float64())) for c in ("cuts", "ends")}}
        return pa.table({c: chunk[c][:1] for c in group} | {c: pa.array(v, kinds[c]) for c, v in columns.items()})

    def compose(chunks: pa.Table) -> pa.Table:
        chunks = chunks.sort_by("_chunk")
        average, sums, entering = [], [0.0, 0.0], []
        for m in chunks.select(["first", "offsets", "scales", "shifts", "floors", "cuts", "ends"]).to_pylist():
            average = average or [m["first"]] * n_rates  # an average of equal values is that value
            entering.append([*average, *sums])
            average = [b + a * y for y, a, b in zip(average, m["scales"], m["offsets"], strict=True)]
            sums = [through(y, *each) for y, *each in zip(sums, m["shifts"], m["floors"], m["cuts"], m["ends"], strict=True)]
        return pa.table({c: chunks[c] for c in group} | {"_in": pa.array(entering, pa.list_(pa.float64()))})

    def apply(chunk: pa.Table, entering: pa.Table) -> pa.Table:
        chunk = chunk.sort_by(order)
        x, both, limit = steps(chunk)
        starts = entering["_in"][0].as_py()
        found = averages(x, starts[:n_rates])
        for d, y in zip(both, starts[n_rates:], strict=True):
            found.append(np.concatenate([np.zeros(len(x) - len(d)), clipped_sums(d, y, limit)]))
        return pa.table({c: chunk[c] for c in kept} | dict(zip([*names, "cusum_pos", "cusum_neg"], map(pa.array, found), strict=True)))

    fields = [df.schema[c] for c in s.keys] + [T.StructField("_chunk", T.LongType())]
    of = lambda *more: T.StructType([*fields, *(T.StructField(c, kind) for c, kind in more)])
    numbers, lists = T.ArrayType(T.DoubleType()), T.ArrayType(T.ArrayType(T.DoubleType()))
    maps = at.groupBy(*group).applyInArrow(summary, of(("first", T.DoubleType()), *((c, numbers) for c in ("offsets", "scales", "shifts", "floors")), ("cuts", lists), ("ends", lists)))
    entering = maps.groupBy(*s.keys).applyInArrow(compose, of(("_in", numbers)))
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, T.DoubleType()) for c in (*names, "cusum_pos", "cusum_neg"))])
    return at.groupBy(*group).cogroup(entering.groupBy(*group)).applyInArrow(apply, schema)


def cusum_windows(df: DataFrame, s: Series, residual: str, slack: float = CUSUM_SLACK) -> DataFrame:
    """df with cusum_pos and cusum_neg without resets: running sums less their least, all in windows."""
    w = s.window.rowsBetween(Window.unboundedPreceding, 0)
    e = F.coalesce(F.col(residual), F.lit(0.0))
    out = over_key(df.withColumn("_e", e), s.keys, _sigma=F.stddev_samp("_e"))
    k = slack * F.coalesce(F.nullif(F.col("_sigma"), F.lit(0.0)), F.lit(1e-6))
    first = F.row_number().over(s.window) == 1
    out = out.withColumns({"_up": F.when(first, 0.0).otherwise(F.col("_e") - k), "_down": F.when(first, 0.0).otherwise(-F.col("_e") - k)})
    out = out.withColumns({"_up": F.sum("_up").over(w), "_down": F.sum("_down").over(w)})
    out = out.withColumns({"cusum_pos": F.col("_up") - F.least(F.lit(0.0), F.min("_up").over(w)), "cusum_neg": F.col("_down") - F.least(F.lit(0.0), F.min("_down").over(w))})
    return out.drop("_e", "_sigma", "_up", "_down")


def rolling_slope(df: DataFrame, s: Series, value: str, windows: tuple[int, ...] = SLOPE_WINDOWS, least: int = 3) -> DataFrame:
    """df with slope_<w>: least squares over the last w rows by position; 0 for constant frames and below `least` rows."""
    out = df.withColumn("_i", F.row_number().over(s.window)).withColumn("_e", F.coalesce(F.col(value), F.lit(0.0)))
    for w in windows:
        frame = s.window.rowsBetween(-(w - 1), 0)
        fitted = F.when(F.count("_e").over(frame) >= least, F.regr_slope(F.col("_e"), F.col("_i")).over(frame))
        out = out.withColumn(f"slope_{w}", F.coalesce(fitted, F.lit(0.0)))
    return out.drop("_i", "_e")


def sign_persistence(df: DataFrame, s: Series, value: str) -> DataFrame:
    """df with `persistence`: rows in the run of one non-zero sign; every zero is a run of its own."""
    out = df.withColumn("_sign", F.signum(F.coalesce(F.col(value), F.lit(0.0))))
    new = (F.col("_sign") == 0) | F.coalesce(F.col("_sign") != F.lag("_sign").over(s.window), F.lit(True))
    out = out.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(s.window))
    return out.withColumn("persistence", F.row_number().over(Window.partitionBy(*s.keys, "_run").orderBy(*s.order))).drop("_sign", "_new", "_run")


def near_gap(s: Series, mask: Column) -> Column:
    return F.max(mask).over(s.window.rowsBetween(-1, 1)) > 0
