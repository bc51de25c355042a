"""Queries of the trained classifiers: heads on the 21 causal features, stored models, and a model for each station left out."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maregraph.functions.scalar import is_sentinel, ordinal_decision
from maregraph.operators import causal as K
from maregraph.operators import inject as I
from maregraph.operators import net as N
from maregraph.operators.features import VECTOR, causal_vector
from maregraph.operators.quantiles import with_quantiles
from maregraph.operators.series import Series, over_key, split
from maregraph.operators.work import gone_at_exit, scratch, stored
from maregraph.plans.causal import families
from maregraph.plans.registry import KEY, OBS, query

FEATURES = list(VECTOR)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Injected series with part, label, confidence, sentinel and the 21 features, calibrated by the training part. A missing value is filled by the median of its series' training part, a sentinel stays what it is."""
    rows = split(families(spark, sf), OBS).withColumns({"sentinel": is_sentinel(F.col("y")), "fit": F.when((F.col("part") == "train") & ~is_sentinel(F.col("y")), F.col("y"))})
    rows = with_quantiles(stored(rows, "injected"), OBS.keys, {"_m": ("fit", 0.5)})
    rows = over_key(rows, OBS.keys, _mean=F.avg("fit"), _sd=F.stddev_pop("fit")).withColumn("v", F.coalesce("y", "_m"))
    z = F.abs(F.col("v") - F.col("_mean")) / (F.col("_sd") + 1e-6)
    label, confidence = I.weak_labels_v2(F.col("class_int"), F.col("v").between(0, 250), z, F.col("gap"))
    rows = rows.withColumn("gap", K.near_gap(OBS, F.col("y").isNull().cast("int"))).withColumns({"label": label, "confidence": confidence, "last": F.lag("v").over(OBS.window)})
    keep = ("event_id", "part", "label", "confidence", "sentinel")
    return stored(causal_vector(rows, Series(OBS.keys, OBS.order, "v"), "last", F.col("y").isNull(), keep, train=F.col("part") == "train"), "labelled")


def _head(spark: SparkSession, sf: str, kind: str) -> tuple[DataFrame, PipelineModel]:
    rows = labelled(spark, sf)
    return rows, N.fitted_pipeline(rows, FEATURES, "label", "part", "sentinel", kind, F.col("confidence"))


def _scores(scored: DataFrame) -> DataFrame:
    return scored.filter("part = 'test'").select(*KEY, "label", "confidence", "p_good", "p_suspect", "p_bad", "decided")


@query()
def ordinal_model(spark: SparkSession, sf: str) -> DataFrame:
    """The ordinal net on all features: scores and decisions of the last fifth of each series."""
    rows, model = _head(spark, sf, "ordinal")
    return _scores(model.transform(rows))


@query()
def softmax_model(spark: SparkSession, sf: str) -> DataFrame:
    """The three-class net on all features."""
    rows, model = _head(spark, sf, "softmax")
    return _scores(model.transform(rows))


@query()
def stored_model(spark: SparkSession, sf: str) -> DataFrame:
    """The ordinal model written, read again, and run over the rows as a stream."""
    rows, model = _head(spark, sf, "ordinal")
    path = f"{scratch(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(f"{path}/model")
    rows.repartition(4).write.parquet(f"{path}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/rows")
    scored = _scores(PipelineModel.load(f"{path}/model").transform(stream))
    scored.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    gone_at_exit(spark, path)
    return spark.read.schema(scored.schema).parquet(f"{path}/out")


def _f1(truth: Column, called: Column) -> Column:
    return F.coalesce(2 * F.count_if(truth & called) / F.nullif(F.count_if(truth) + F.count_if(called), F.lit(0)), F.lit(0.0))


@query()
def lobo_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Each station's test rows, judged by a model that has seen only the others, beside the model of all: `fold, n_test, n_weak, tau, macro_f1, f1_good, f1_suspect, f1_bad, binary_f1, pooled_binary_f1, delta`.

    All models are trained in the same passes. Thresholds are tuned on the validation rows
    of the stations that a model has seen; F1s are of the rows with certain labels, the
    binary ones of SUSPECT and BAD together. The scaler is that of all stations' training rows.
    """
    rows = labelled(spark, sf)
    scaled = stored(N.ClippedScaler.fitted(rows.filter("part = 'train'"), FEATURES).transform(rows), "scaled")
    names = [f"scaled_{c}" for c in FEATURES]
    net, folds = N.train(scaled, names, "label", F.col("part"), "ordinal", F.col("confidence"), "station")
    number = F.create_map(*(F.lit(x) for k, f in enumerate(["all", *folds]) for x in (f, k)))
    # a validation row tunes the model of all and those of the other stations
    seen = N.bad_by_fold(scaled.filter("part = 'validation' and not sentinel"), names, net, folds, F.col("station"), ("label",))
    taus = stored(N.tuned(seen, ("fold",), "p_bad", F.col("label") == 2).select("fold", F.when(F.col("f1") > 0, F.col("tau")).otherwise(0.5).alias("tau")), "thresholds")
    test = scaled.filter("part = 'test'").withColumn("fold", F.col("station").cast("string"))
    judged = test
    for column, which in (("called", F.col("fold")), ("called_all", F.lit("all"))):
        told = taus.withColumnsRenamed({"fold": "_which", "tau": f"tau_{column}"})
        judged = N.probabilities(judged, names, net, number[which]).join(told, which == F.col("_which"), "left").drop("_which")
        decided = ordinal_decision(F.col("p_good"), F.col("p_suspect"), F.col("p_bad"), F.coalesce(f"tau_{column}", F.lit(0.5)), F.col("sentinel"))
        judged = judged.withColumn(column, F.when(decided == "BAD", 2).when(decided == "SUSPECT", 1).otherwise(0)).drop("p_good", "p_suspect", "p_bad")
    strong = judged.filter("confidence >= 0.999").groupBy("fold")
    found = strong.agg(F.count("*").alias("n_test"), F.max("tau_called").alias("tau"), *(_f1(F.col("label") == k, F.col("called") == k).alias(f"f1_{n}") for k, n in enumerate(("good", "suspect", "bad"))), *(_f1(F.col("label") > 0, F.col(c) > 0).alias(n) for n, c in (("binary_f1", "called"), ("pooled_binary_f1", "called_all"))))
    weak = judged.groupBy("fold").agg(F.count_if(F.col("confidence") < 0.999).alias("n_weak"))
    macro = (F.col("f1_good") + F.col("f1_suspect") + F.col("f1_bad")) / 3
    out = found.join(weak, "fold").withColumns({"macro_f1": macro, "delta": F.col("binary_f1") - F.col("pooled_binary_f1")})
    return out.select("fold", "n_test", "n_weak", "tau", "macro_f1", "f1_good", "f1_suspect", "f1_bad", "binary_f1", "pooled_binary_f1", "delta")
