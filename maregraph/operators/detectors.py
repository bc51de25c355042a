"""Residual detectors: folded Student t, alpha sweep, spikes, isolation forest, and the classifiers' feature sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maregraph.functions.scalar import MAD_TO_SIGMA, T4_QUARTILE, clean, t4_sf
from maregraph.operators.classical import classic_spike
from maregraph.operators.quantiles import exact_quantiles
from maregraph.operators.series import Series, over_key
from maregraph.operators.work import stored

ALPHAS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1)


def diff_mean(s: Series, predicted: Column) -> Column:
    """|observed - predicted| over the mean of the three rows around; null where that mean is about 0."""
    mean = F.avg(s.x).over(s.window.rowsBetween(-1, 1))
    return F.abs(s.x - predicted) / F.when(F.abs(mean) >= 1e-6, mean)


def robust_t(df: DataFrame, keys: tuple[str, ...], score: str, folded: bool = True) -> DataFrame:
    """df with `p_robust`: two-sided tail of the score over a scale from its median (folded=False: of its absolute value)."""
    filled = F.coalesce(clean(F.col(score)), F.lit(0.0))
    filled = filled if folded else F.abs(filled)
    out = over_key(df.withColumn("_s", filled), keys, _m=F.median("_s"))
    scale = F.nullif(F.col("_m"), F.lit(0.0)) / T4_QUARTILE
    return out.withColumn("p_robust", 2 * t4_sf(F.col("_s") / scale)).drop("_s", "_m")


def stat_vector(df: DataFrame, s: Series, residual: str, train: Column, in_range: Column | None = None) -> DataFrame:
    """df with the statistics `spike, rate, outside, mad_score`: the tail of absolute residuals over the scale of the training rows of the key."""
    size = F.abs(F.coalesce(clean(F.col(residual)), F.lit(0.0)))
    scale = F.nullif(F.median(F.when(train, size)).over(s.whole), F.lit(0.0)) / T4_QUARTILE
    inside = s.x.between(0, 250) if in_range is None else in_range
    p = F.greatest(2 * t4_sf(size / scale), F.lit(0.0) * scale)
    return df.withColumns({"spike": F.coalesce(classic_spike(s), F.lit(0.0)), "rate": F.coalesce(F.abs(s.x - F.lag(s.x).over(s.window)), F.lit(0.0)), "outside": (~inside).cast("int"), "mad_score": -F.ln(p + 1e-12)})


def feature_set(name: str, hidden: tuple[str, ...] = (), covariates: tuple[str, ...] = ()) -> list[str]:
    """The columns of the classifiers' feature sets: B forecast and residual, C with statistics, D with the forecaster's state, E all, F without a forecaster."""
    forecast, statistics = ["y", "predicted", "residual", "abs_residual"], ["spike", "mad_score", "gpd_score", "rate", "outside"]
    return {
        "B": forecast,
        "C": [*forecast, *statistics],
        "D": [*hidden, *forecast],
        "E": [*hidden, *forecast, *statistics, *covariates, "missing_mask"],
        "F": ["y", *covariates, "spike", "persistence_residual", "outside"],
    }[name]


def alpha_sweep(scored: DataFrame, keys: tuple[str, ...], p: str, truth: Column, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Rows `keys, alpha, n_flagged, n_true, hits`: one pass over the p-values for all levels."""
    levels = F.explode(F.array(*map(F.lit, alphas)))
    counted = scored.withColumn("_truth", truth.cast("int")).select(*keys, "_truth", F.col(p).alias("_p"), levels.alias("alpha"))
    hit = F.coalesce(F.col("_p") < F.col("alpha"), F.lit(False)).cast("int")
    return counted.groupBy(*keys, "alpha").agg(F.sum(hit).alias("n_flagged"), F.sum("_truth").alias("n_true"), F.sum(hit * F.col("_truth")).alias("hits"))


def traditional_spike(df: DataFrame, s: Series) -> DataFrame:
    """df with `classic`, `limit` (median + 6 robust deviations of the series) and `spike`."""
    out = over_key(df.withColumn("classic", classic_spike(s)), s.keys, _m=F.median("classic"))
    out = over_key(out.withColumn("_d", F.abs(F.col("classic") - F.col("_m"))), s.keys, _mad=F.median("_d"))
    out = out.withColumn("limit", F.col("_m") + 6 * MAD_TO_SIGMA * F.col("_mad"))
    return out.withColumn("spike", F.coalesce(F.col("classic") > F.col("limit"), F.lit(False))).drop("_m", "_d", "_mad")


def isolation_scores(df: DataFrame, features: list[str], keep: list[str], trees: int = 100, sample: int = 256, seed: int = 7, train: str | None = None) -> DataFrame:
    """df's `keep` with `isolation`: anomaly score of a forest grown on a bounded sample of rows (of `train`, a boolean column, if given; the least by hash) and applied to all."""
    ok = F.lit(True)
    for f in features:
        ok = ok & F.col(f).isNotNull()
    rows = df.filter(ok).select(*features, *(c for c in keep if c not in features))
    fitted = rows if train is None else rows.filter(F.col(train))
    drawn = np.array([tuple(r) for r in fitted.select(*features, F.xxhash64(*keep, F.lit(seed)).alias("_h")).orderBy("_h").limit(4 * sample).drop("_h").collect()], float).reshape(-1, len(features))
    rng = np.random.default_rng(seed)
    size = min(sample, len(drawn))
    limit = max(1, int(np.ceil(np.log2(max(2, size)))))

    def average(n: float) -> float:
        return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def grow(x: np.ndarray, depth: int) -> tuple:
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(0)
        if depth >= limit or len(x) <= 1 or not spread.any():
            return (depth + average(len(x)),)
        f = int(rng.choice(np.flatnonzero(spread)))
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        left = x[:, f] < cut
        return f, cut, grow(x[left], depth + 1), grow(x[~left], depth + 1)

    forest = [grow(drawn[rng.choice(len(drawn), size, replace=False)], 0) for _ in range(trees)] if size else []
    norm = average(size) or 1.0

    def score(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(float)
            depth = np.zeros(len(x))

            def walk(node: tuple, at: np.ndarray) -> None:
                if len(node) == 1:
                    depth[at] += node[0]  # noqa: B023
                elif len(at):
                    left = x[at, node[0]] < node[1]  # noqa: B023
                    walk(node[2], at[left])
                    walk(node[3], at[~left])

            for tree in forest:
                walk(tree, np.arange(len(x)))
            out = pdf[keep].copy()
            out["isolation"] = 2.0 ** (-(depth / max(1, len(forest))) / norm)
            yield out

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "isolation double"])
    return rows.mapInPandas(score, schema)


def isolation_flags(scored: DataFrame, train: Column, contamination: float = 1 / 130) -> DataFrame:
    """scored with `flagged`: an isolation above what the share `contamination` of the training rows passes."""
    rows = stored(scored, "isolation")
    limit = exact_quantiles(rows.filter(train), (), {"limit": ("isolation", 1 - contamination)}).first()
    return rows.withColumn("flagged", F.col("isolation") > F.lit(limit and limit["limit"]))
