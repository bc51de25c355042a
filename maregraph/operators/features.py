"""The classifier's vector of a series: 21 causal features in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maregraph.operators import causal as K
from maregraph.operators.series import Series
from maregraph.operators.tails import Calibration
from maregraph.operators.work import stored

#: The order in which stored models read the features.
VECTOR = (
    "y", "predicted", "residual", "abs_residual", "acc_score", "level_score", "rate", "outside", "mad_score", "gpd_score", "ewma_0", "ewma_1", "ewma_2",
    "cusum_pos", "cusum_neg", "slope_6", "slope_12", "slope_24", "slope_48", "persistence", "missing_mask",
)


def surprise(p: Column) -> Column:
    """Minus the logarithm of a p-value; 0 where there is none."""
    return F.coalesce(-F.ln(p + 1e-12), F.lit(0.0))


def causal_vector(df: DataFrame, s: Series, predicted: str, missing: Column, keep: tuple[str, ...] = (), low: float = 0.0, high: float = 250.0, train: Column | None = None, calibration: Calibration | None = None, rows: int = 100_000) -> DataFrame:
    """Rows `keys, order, keep` and VECTOR, for values without gaps (`missing` tells which were filled).

    No feature reads a later row. Tail scores are calibrated by all rows of the series, by
    its `train` rows, or by a given calibration. Each step passes the columns of those
    before it on, so nothing is joined back by row; the memory of residuals is a scan over
    chunks of `rows` rows.
    """
    kept = [*dict.fromkeys([*s.keys, *s.order, *keep])]
    base = df.withColumns({"y": s.x, "residual": F.coalesce(s.x - F.col(predicted), F.lit(0.0)), "missing_mask": missing.cast("int"), "_train": F.lit(True) if train is None else F.coalesce(train, F.lit(False))})
    base = base.withColumns({"predicted": F.coalesce(F.col(predicted), s.x), "abs_residual": F.abs("residual"), "outside": (~s.x.between(low, high)).cast("int"), "rate": K.rate(s)})
    out = K.trailing_scores(K.sign_persistence(K.rolling_slope(base, s, "residual"), s, "residual"), s)
    there = [c for c in VECTOR if c in out.columns]
    out = stored(K.recursive_memory(out, s, "residual", (*kept, *there, "_train"), rows=rows), "memory")
    if calibration is None:
        calibration = Calibration.of(out.filter("_train"), s.keys, "residual")
    judged = calibration.judge(out, "residual").withColumns({"mad_score": surprise(F.col("p_robust")), "gpd_score": surprise(F.col("p_gpd"))})
    return judged.select(*kept, *(F.col(c).cast("double").alias(c) for c in VECTOR))
