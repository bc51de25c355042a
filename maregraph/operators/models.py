"""Forecasts and the ordinal classifier on MLlib, and thresholds tuned in one aggregation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maregraph.functions.scalar import ordinal_probabilities
from maregraph.operators.metrics import _r
from maregraph.operators.quantiles import exact_quantiles
from maregraph.operators.series import Series

#: 0.05 to 0.95 by 0.05, then 0.96 to 0.99.
TAUS = tuple(round(0.05 * k, 2) for k in range(1, 20)) + (0.96, 0.97, 0.98, 0.99)


def lagged(df: DataFrame, s: Series, value: str, lags: int) -> tuple[DataFrame, list[str]]:
    names = [f"lag_{k}" for k in range(1, lags + 1)]
    return df.withColumns({n: F.lag(value, k).over(s.window) for k, n in enumerate(names, 1)}), names


def lag_forecast(df: DataFrame, s: Series, value: str, train: Column, lags: int = 6, loss: str = "huber") -> DataFrame:
    """df's rows with full history and `predicted`: a linear forecast from the last values, robust to outliers, fitted on `train` rows."""
    out, names = lagged(df, s, value, lags)
    out = out.dropna(subset=[*names, value])
    fit = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x"), LinearRegression(featuresCol="_x", labelCol=value, predictionCol="predicted", loss=loss, maxIter=30)]).fit(out.filter(train))
    return fit.transform(out).drop("_x", *names)


def component_residual(df: DataFrame, s: Series, value: str, train: Column, lags: int = 12, k: int = 3) -> DataFrame:
    """df's rows with full history and `residual`: the squared part of a window that the leading components don't hold."""
    out, names = lagged(df, s, value, lags)
    out = out.dropna(subset=names)
    fit = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_x"), PCA(k=k, inputCol="_x", outputCol="_z")]).fit(out.filter(train))
    pc = fit.stages[1].pc.toArray()
    x, z = vector_to_array("_x"), vector_to_array("_z")
    residual = sum(F.pow(F.element_at(x, i + 1) - sum(float(pc[i, j]) * F.element_at(z, j + 1) for j in range(k)), 2) for i in range(lags))
    return fit.transform(out).withColumn("residual", residual).drop("_x", "_z", *names)


def class_weights(df: DataFrame, label: str, confidence: Column | None = None) -> DataFrame:
    """df with `weight`: n / (classes * rows of the class), times the confidence."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    balanced = F.col("_t") / (F.col("_k") * F.col("_n"))
    out = df.join(F.broadcast(n.crossJoin(total)), label)  # one row a class
    return out.withColumn("weight", balanced if confidence is None else balanced * confidence).drop("_n", "_t", "_k")


def robust_scaled(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns cut to the training rows' 0.5 and 99.5 per cent points, less the median, over the quartile range."""
    levels = (0.005, 0.25, 0.5, 0.75, 0.995)
    points = exact_quantiles(df.filter(train), (), {f"{c}_{k}": (c, q) for c in columns for k, q in enumerate(levels)}).first()
    out = df
    for c in columns:
        found = [points and points[f"{c}_{k}"] for k in range(len(levels))]
        lo, q1, mid, q3, hi = found if found[0] is not None else (0.0, 0.0, 0.0, 1.0, 0.0)
        out = out.withColumn(c, (F.greatest(F.least(F.col(c), F.lit(hi)), F.lit(lo)) - mid) / ((q3 - q1) or 1.0))
    return out


def standard_scaled(df: DataFrame, columns: list[str], train: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns less the mean, over the deviation (1 where it is 0), of the training rows (of each key)."""
    w = Window.partitionBy(*keys)
    kept = lambda c: F.when(train, F.col(c))
    spread = lambda c: F.coalesce(F.nullif(F.stddev_pop(kept(c)).over(w), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({c: (F.col(c) - F.avg(kept(c)).over(w)) / spread(c) for c in columns})


def softmax_head(df: DataFrame, features: list[str], label: str, train: Column, confidence: Column | None = None) -> DataFrame:
    """df with p_good, p_suspect, p_bad: one multinomial model of the three classes, balanced and weighed by confidence."""
    assembled = VectorAssembler(inputCols=features, outputCol="_x").transform(df.fillna(0.0, features))
    fitted = class_weights(assembled.filter(train).withColumn("_y", F.col(label).cast("double")), "_y", confidence)
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", family="multinomial", maxIter=60, regParam=1e-3, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_pred").fit(fitted)
    p = vector_to_array("_p")
    out = model.transform(assembled).withColumns({f"p_{name}": F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) for k, name in enumerate(("good", "suspect", "bad"))})
    return out.drop("_x", "_p", "_raw", "_pred")


def ordinal_head(df: DataFrame, features: list[str], label: str, train: Column, confidence: Column | None = None) -> DataFrame:
    """df with p_good, p_suspect, p_bad: P(>= SUSPECT) from all rows and P(BAD | >= SUSPECT) from the others, both balanced."""
    assembled = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df.fillna(0.0, features))
    out = assembled
    for q, rows, target in (("q1", train, F.col(label) >= 1), ("q2", train & (F.col(label) >= 1), F.col(label) >= 2)):
        fitted = class_weights(assembled.filter(rows).withColumn("_y", target.cast("double")), "_y", confidence)
        model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", maxIter=30, regParam=1e-3, probabilityCol=f"_{q}", rawPredictionCol=f"_raw{q}", predictionCol=f"_pred{q}").fit(fitted)
        out = model.transform(out).withColumn(q, F.element_at(vector_to_array(f"_{q}"), -1)).drop(f"_{q}", f"_raw{q}", f"_pred{q}")
    good, suspect, bad = ordinal_probabilities(F.col("q1"), F.col("q2"))
    return out.withColumns({"p_good": good, "p_suspect": suspect, "p_bad": bad}).drop("_x", "q1", "q2")


def by_threshold(df: DataFrame, p: str, truth: Column, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """Rows `tau, tp, fp, fn, precision, recall, f1` for decisions p >= tau: rows meet as counts per threshold passed.

    Each row goes to the number of thresholds it passes; sums over those from above are
    the counts at every threshold, so the data are read once for all of them.
    """
    passed = sum((F.col(p) >= t).cast("int") for t in taus)
    counted = df.select(F.coalesce(passed, F.lit(0)).alias("k"), truth.cast("long").alias("t")).groupBy("k").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(k, float(t)) for k, t in enumerate(taus, 1)], "i int, tau double")
    joined = grid.join(F.broadcast(counted))  # one row for each threshold
    at = F.when(F.col("k") >= F.col("i"), F.lit(1)).otherwise(0)
    out = joined.groupBy("tau").agg(F.sum(F.col("t") * at).alias("tp"), F.sum((F.col("n") - F.col("t")) * at).alias("fp"), F.sum(F.col("t") * (1 - at)).alias("fn"))
    return out.withColumns({"precision": _r(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _r(F.col("tp"), F.col("tp") + F.col("fn")), "f1": _r(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def tuned_threshold(table: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row `tau, f1`: the middle of the thresholds that share the best F1."""
    best = table.withColumn("_best", F.max("f1").over(Window.partitionBy(F.lit(1)))).filter(F.col("f1") >= F.col("_best") - tolerance)
    return best.agg(F.median("tau").alias("tau"), F.max("f1").alias("f1"))


def save_model(model, path: str, parameters: dict) -> None:
    """A fitted pipeline model beside its parameters, one JSON row."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(json.dumps(parameters, sort_keys=True),)], "parameters string").coalesce(1).write.mode("overwrite").json(f"{path}/parameters")


def load_model(path: str) -> tuple:
    row = SparkSession.active().read.schema("parameters string").json(f"{path}/parameters").first()
    return PipelineModel.load(f"{path}/model"), json.loads(row["parameters"])


def leave_one_out_forecasts(df: DataFrame, s: Series, value: str, fold: str, lags: int = 3) -> DataFrame:
    """Each fold's rows forecast by a model of all others: `fold, mae, n`, for any number of folds.

    One aggregation sums the normal equations of every fold; a fold's model is that of
    the total less its own sums. Without rows in other folds `mae` is null. A null fold
    is a fold of its own.
    """
    out, names = lagged(df, s, value, lags)
    columns = [*names, value]
    out = out.dropna(subset=columns).select(F.col(fold).alias("fold"), *(F.col(c).cast("double").alias(f"_z{k}") for k, c in enumerate(columns)))
    z = [f"_z{k}" for k in range(len(columns))]
    at = out.agg(*(F.avg(c) for c in z), *(F.stddev_pop(c) for c in z)).first()
    centre, spread = [x or 0.0 for x in at[: len(z)]], [x or 1.0 for x in at[len(z) :]]
    out = out.withColumns({c: (F.col(c) - centre[k]) / spread[k] for k, c in enumerate(z)})
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    sums = out.groupBy("fold").agg(F.count("*").cast("double").alias("_s0"), *(F.sum(c).alias(f"_s{k}") for k, c in enumerate(z, 1)), *(F.sum(F.col(z[i]) * F.col(z[j])).alias(f"_s{k}") for k, (i, j) in enumerate(pairs, 1 + len(z))))
    held = [f"_s{k}" for k in range(1 + len(z) + len(pairs))]
    total = sums.agg(F.array(*(F.sum(c) for c in held)).alias("_total"))
    both = sums.select("fold", F.array(*held).alias("_own")).join(F.broadcast(total))  # one row

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = []
            for own, every in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n, *rest = np.array(every) - np.array(own)
                if n < 0.5:
                    models.append(None)
                    continue
                mean, square = np.array(rest[: len(z)]) / n, np.zeros((len(z), len(z)))
                for (i, j), x in zip(pairs, rest[len(z) :], strict=True):
                    square[i, j] = square[j, i] = x / n - mean[i] * mean[j]
                weights = np.linalg.lstsq(square[:-1, :-1], square[:-1, -1], rcond=1e-12)[0]
                models.append([mean[-1] - weights @ mean[:-1], *weights])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(models, pa.list_(pa.float64()))], ["_held", "_model"])

    kind = T.StructType([T.StructField("_held", out.schema["fold"].dataType), T.StructField("_model", T.ArrayType(T.DoubleType()))])
    scored = out.join(both.mapInArrow(fit, kind), F.col("fold").eqNullSafe(F.col("_held")))
    predicted = sum((F.col("_model")[k] * F.col(c) for k, c in enumerate(z[:-1], 1)), F.col("_model")[0])
    return scored.groupBy("fold").agg((F.avg(F.abs(F.col(z[-1]) - predicted)) * spread[-1]).alias("mae"), F.count("*").alias("n"))
