"""Queries of evaluation, reconciliation, stability, behaviour, models and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maregraph.functions import scalar as R
from maregraph.operators import metrics as E
from maregraph.operators import models as M
from maregraph.operators.series import Series
from maregraph.plans.classical import FULL, flags
from maregraph.operators.work import gone_at_exit
from maregraph.plans.registry import KEY, KEYS, OBS, OBS_SQL, W, obs, query, rounded, scratch, table
from maregraph.streaming import quality as Q

# Truth and score: documents' toxic label, scored by the share of characters in a fixed range of lengths; tied on purpose.
PAIR = "pr AS (SELECT l.doc_id, l.toxic, l.quality, d.lang, round((d.n_chars % 97) / 97.0::DOUBLE, 1) * (0.6::DOUBLE + 0.4::DOUBLE * l.toxic) AS score FROM labels l JOIN documents d USING (doc_id))"
# Three classes by bands of the value, and a prediction that errs by the row's number.
TRI = "tr AS (SELECT event_id, user_id % 6 AS station, ts, CASE WHEN value > 120 THEN 2 WHEN value > 60 THEN 1 ELSE 0 END AS truth, CASE WHEN event_id % 11 = 0 THEN (CASE WHEN value > 120 THEN 1 WHEN value > 60 THEN 0 ELSE 2 END) WHEN value > 115 THEN 2 WHEN value > 62 THEN 1 ELSE 0 END AS predicted, least(value / 300.0, 1) AS q1, least(value / 400.0, 1) AS q2 FROM events)"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    score = F.round((F.col("n_chars") % 97) / 97.0, 1) * (0.6 + 0.4 * F.col("toxic"))
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", "toxic", "quality", "lang", score.alias("score"))


def three(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    truth = F.when(v > 120, 2).when(v > 60, 1).otherwise(0)
    wrong = F.when(v > 120, 1).when(v > 60, 0).otherwise(2)
    guess = F.when(F.col("event_id") % 11 == 0, wrong).when(v > 115, 2).when(v > 62, 1).otherwise(0)
    return table(spark, sf, "events").select("event_id", (F.col("user_id") % 6).alias("station"), "ts", truth.alias("truth"), guess.alias("predicted"), F.least(v / 300.0, F.lit(1.0)).alias("q1"), F.least(v / 400.0, F.lit(1.0)).alias("q2"))


def ratio_sql(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


COUNTS = "sum(t * f)::BIGINT AS tp, sum((1 - t) * f)::BIGINT AS fp, sum(t * (1 - f))::BIGINT AS fn"
PRF = f"round({ratio_sql('tp', 'tp + fp')}, 8) AS precision, round({ratio_sql('tp', 'tp + fn')}, 8) AS recall, round({ratio_sql('2 * tp', '2 * tp + fp + fn')}, 8) AS f1"


@query(f"WITH {PAIR}, c AS (SELECT lang, {COUNTS}, sum(f)::BIGINT AS detected, sum(t)::BIGINT AS true_anomalies FROM (SELECT lang, toxic AS t, (score >= 0.5)::INT AS f FROM pr) GROUP BY lang) SELECT *, {PRF} FROM c")
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.binary_metrics(pairs(spark, sf), F.col("toxic"), F.col("score") >= 0.5, ("lang",)), "precision", "recall", "f1", digits=8)


CONF = f"{TRI}, s AS (SELECT unnest([0, 1, 2]) AS k), cm AS (SELECT a.k AS truth, b.k AS predicted, count(tr.truth) AS n FROM s a CROSS JOIN s b LEFT JOIN tr ON tr.truth = a.k AND tr.predicted = b.k GROUP BY ALL)"
PERCLASS = f"{CONF}, pc AS (SELECT k AS class, (SELECT sum(n) FROM cm WHERE truth = k)::BIGINT AS support, (SELECT sum(n) FROM cm WHERE predicted = k)::BIGINT AS predicted_n, (SELECT sum(n) FROM cm WHERE truth = k AND predicted = k)::BIGINT AS hit FROM s)"


@query(f"WITH {CONF} SELECT * FROM cm")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(three(spark, sf), "truth", "predicted")


@query(f"WITH {PERCLASS} SELECT class, support, predicted_n, hit, round({ratio_sql('2 * hit', 'support + predicted_n')}, 8) AS f1 FROM pc")
def multiclass_f1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.class_f1(E.confusion(three(spark, sf), "truth", "predicted")), "f1", digits=8)


@query(f"""WITH {PERCLASS}, f AS (SELECT *, {ratio_sql('2 * hit', 'support + predicted_n')} AS f1 FROM pc) SELECT round(avg(f1) FILTER (support + predicted_n > 0), 8) AS macro_f1, round(sum(f1 * support) / sum(support), 8) AS weighted_f1, round(avg(hit::DOUBLE / support) FILTER (support > 0), 8) AS balanced_accuracy,
round((sum(hit)::DOUBLE * sum(support) - sum(support::DOUBLE * predicted_n)) / sqrt((sum(support)::DOUBLE * sum(support) - sum(predicted_n::DOUBLE * predicted_n)) * (sum(support)::DOUBLE * sum(support) - sum(support::DOUBLE * support))), 8) AS mcc FROM f""")
def mcc_balacc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.multiclass_summary(E.confusion(three(spark, sf), "truth", "predicted")), "macro_f1", "weighted_f1", "balanced_accuracy", "mcc", digits=8)


@query(f"""WITH {PERCLASS}, f AS (SELECT *, {ratio_sql('2 * hit', 'support + predicted_n')} AS f1 FROM pc), m AS (SELECT round(avg(f1) FILTER (support + predicted_n > 0), 8) AS macro_f1, round(avg(hit::DOUBLE / support) FILTER (support > 0), 8) AS balanced_accuracy FROM f),
c AS (SELECT {COUNTS} FROM (SELECT (truth > 0)::INT AS t, (predicted > 0)::INT AS f FROM tr)) SELECT macro_f1, balanced_accuracy, {PRF.replace(' AS f1', ' AS binary_f1')} FROM m, c""")
def collapsed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A log of three classes judged as three, and as GOOD against the rest."""
    return rounded(E.collapsed(three(spark, sf), "truth", "predicted"), "macro_f1", "balanced_accuracy", "precision", "recall", "binary_f1", digits=8)


@query(f"""WITH {PAIR}, rk AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM pr), au AS (SELECT lang, sum(toxic) AS p, count(*) - sum(toxic) AS q, sum(r) FILTER (toxic = 1) AS sr FROM rk GROUP BY 1),
d AS (SELECT lang, score, sum(toxic) AS p, count(*) AS n FROM pr GROUP BY ALL), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM d WINDOW w AS (PARTITION BY lang ORDER BY score DESC)), ap AS (SELECT lang, sum(p * tp::DOUBLE / seen) AS a FROM c GROUP BY 1)
SELECT lang, CASE WHEN p > 0 AND q > 0 THEN round((sr - p * (p + 1) / 2.0) / (p * q), 8) END AS auroc, CASE WHEN p > 0 AND q > 0 THEN round(a / p, 8) END AS average_precision FROM au JOIN ap USING (lang)""")
def auroc_auprc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.ranking(pairs(spark, sf), F.col("toxic"), "score", ("lang",)), "auroc", "average_precision", digits=8)


@query(f"WITH {PAIR} SELECT lang, round(avg((score - toxic) * (score - toxic)), 8) AS brier FROM pr GROUP BY lang")
def brier(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("score") - F.col("toxic")
    return pairs(spark, sf).groupBy("lang").agg(F.round(F.avg(e * e), 8).alias("brier"))


@query(f"WITH {PAIR}, b AS (SELECT ceil(score * 10) AS b, count(*) AS n, avg(score) AS c, avg(toxic) AS r FROM pr GROUP BY 1) SELECT round(sum(CASE WHEN b > 0 THEN n * abs(c - r) ELSE 0 END) / sum(n), 8) AS ece FROM b")
def ece(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.calibration_error(pairs(spark, sf), F.col("score"), F.col("toxic")), "ece", digits=8)


PROB = f"{TRI}, op AS (SELECT *, 1 - q1 AS p_good, q1 * (1 - q2) AS p_suspect, q1 * q2 AS p_bad FROM tr)"


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    good, suspect, bad = R.ordinal_probabilities(F.col("q1"), F.col("q2"))
    return three(spark, sf).withColumns({"p_good": good, "p_suspect": suspect, "p_bad": bad})


@query(f"WITH {PROB} SELECT event_id, round(p_good, 8) AS p_good, round(p_suspect, 8) AS p_suspect, round(p_bad, 8) AS p_bad FROM op")
def ordinal_probs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(probabilities(spark, sf).select("event_id", "p_good", "p_suspect", "p_bad"), "p_good", "p_suspect", "p_bad", digits=8)


@query(f"WITH {PROB} SELECT station, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n, round(avg(p_good), 6) AS p_good, round(avg(p_suspect), 6) AS p_suspect, round(avg(p_bad), 6) AS p_bad FROM op GROUP BY ALL")
def probability_stack(spark: SparkSession, sf: str) -> DataFrame:
    """The three probabilities' means by station and hour, which add up to 1."""
    names = ("p_good", "p_suspect", "p_bad")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return probabilities(spark, sf).groupBy("station", hour).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in names))


@query(f"WITH {PROB} SELECT event_id, CASE WHEN event_id % 53 = 0 THEN 'BAD' WHEN p_bad >= 0.4 THEN 'BAD' WHEN p_suspect >= p_good THEN 'SUSPECT' ELSE 'GOOD' END AS label FROM op")
def ordinal_decide(spark: SparkSession, sf: str) -> DataFrame:
    observed = F.when(F.col("event_id") % 53 == 0, F.lit(-999.0)).otherwise(F.col("q1"))
    return probabilities(spark, sf).select("event_id", R.ordinal_decision(F.col("p_good"), F.col("p_suspect"), F.col("p_bad"), 0.4, R.is_sentinel(observed)).alias("label"))


TAU = f"{PROB}, ta AS (SELECT unnest([{', '.join(map(str, M.TAUS))}]::DOUBLE[]) AS tau), tb AS (SELECT tau, {COUNTS} FROM (SELECT tau, (truth = 2)::INT AS t, (p_bad >= tau)::INT AS f FROM op CROSS JOIN ta) GROUP BY tau)"


@query(f"WITH {TAU} SELECT *, {PRF} FROM tb")
def pr_by_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.by_threshold(probabilities(spark, sf), "p_bad", F.col("truth") == 2), "precision", "recall", "f1", digits=8)


@query(f"WITH {TAU}, f AS (SELECT tau, {ratio_sql('2 * tp', '2 * tp + fp + fn')} AS f1 FROM tb) SELECT round(median(tau), 8) AS tau, round(max(f1), 8) AS f1 FROM f WHERE f1 >= (SELECT max(f1) FROM f) - 1e-9")
def tune_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.tuned_threshold(M.by_threshold(probabilities(spark, sf), "p_bad", F.col("truth") == 2)), "tau", "f1", digits=8)


FAM = f"{TRI}, fm AS (SELECT *, CASE WHEN event_id % 40 < 4 THEN 'C_level' WHEN event_id % 40 = 20 THEN 'A_spike' WHEN event_id % 40 IN (30, 31) THEN 'G_missing' ELSE '' END AS family FROM tr)"


def with_family(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("event_id") % 40
    return three(spark, sf).withColumn("family", F.when(m < 4, "C_level").when(m == 20, "A_spike").when(m.isin(30, 31), "G_missing").otherwise(""))


@query(f"WITH {FAM} SELECT split_part(family, '_', 1) AS letter, count(*) AS n, round(avg((truth = predicted)::INT), 8) AS accuracy, round(avg(q1 * q2), 8) AS mean_p_bad, round(avg((truth = 2)::INT), 8) AS true_bad, round(avg((predicted <> 0)::INT), 8) AS flagged FROM fm WHERE family <> '' GROUP BY 1")
def family_perf(spark: SparkSession, sf: str) -> DataFrame:
    share = lambda c: F.round(F.avg(c.cast("double")), 8)
    rows = with_family(spark, sf).filter("family <> ''").groupBy(F.split_part("family", F.lit("_"), F.lit(1)).alias("letter"))
    return rows.agg(F.count("*").alias("n"), share(F.col("truth") == F.col("predicted")).alias("accuracy"), F.round(F.avg(F.col("q1") * F.col("q2")), 8).alias("mean_p_bad"), share(F.col("truth") == 2).alias("true_bad"), share(F.col("predicted") != 0).alias("flagged"))


@query(f"WITH {FAM}, c AS (SELECT {COUNTS}, sum(f)::BIGINT AS detected, sum(t)::BIGINT AS true_anomalies FROM (SELECT (truth = 2)::INT AS t, (predicted = 2)::INT AS f FROM fm WHERE family <> '' OR q1 < 0.1)) SELECT *, {PRF} FROM c")
def strong_label_eval(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_family(spark, sf).withColumn("confidence", F.when((F.col("family") != "") | (F.col("q1") < 0.1), 1.0).otherwise(0.5)).filter("confidence >= 0.999")
    return rounded(E.binary_metrics(rows, F.col("truth") == 2, F.col("predicted") == 2), "precision", "recall", "f1", digits=8)


STATION = Series(("station",), ("ts", "event_id"), "q1")
SW = "PARTITION BY station ORDER BY ts, event_id"


@query(f"WITH {FAM}, o AS (SELECT *, family <> '' AND NOT coalesce(lag(family <> '') OVER ({SW}), false) AS first FROM fm) SELECT split_part(family, '_', 1) AS letter, round(avg((predicted <> 0)::INT), 8) AS rate, count(*) AS n_events FROM o WHERE first GROUP BY 1")
def onset_detection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.onsets(with_family(spark, sf), STATION, "family", F.col("predicted") != 0), "rate", digits=8)


@query(f"""WITH {TRI}, a AS (SELECT *, sum((truth = 0)::INT) OVER ({SW}) AS run FROM tr), r AS (SELECT station, run, sum((truth = 0)::INT) AS clean, sum((truth = 0 AND predicted <> 0)::INT) AS alarms, avg((predicted <> 0)::INT) FILTER (truth <> 0) AS share FROM a GROUP BY ALL)
SELECT station, sum(clean)::BIGINT AS n_clean, sum(alarms)::BIGINT AS false_alarms, count(share) AS n_episodes, round(coalesce(100 * avg(share), 0), 6) AS mean_coverage_pct, round(100.0 * sum(alarms) / greatest(sum(clean), 1), 6) AS false_alarm_pct FROM r GROUP BY station""")
def streaming_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = three(spark, sf).withColumns({c: R.label_of(F.col(c)) for c in ("truth", "predicted")})
    return rounded(E.stream_metrics(rows, STATION, "truth", "predicted"), "mean_coverage_pct", "false_alarm_pct")


# reconciliation: hourly worst of decisions against a second label
REC = f"""{FULL}, rh AS (SELECT variable, date_trunc('hour', ts) AS hour, max(CASE decision WHEN 'use' THEN 0 WHEN 'review' THEN 1 ELSE 2 END) AS r FROM dec GROUP BY ALL),
qh AS (SELECT variable, date_trunc('hour', ts) AS hour, CASE WHEN max(x) > 150 THEN 2 WHEN max(x) > 80 THEN 1 ELSE 0 END AS q FROM obs WHERE x IS NOT NULL GROUP BY ALL), rq AS (SELECT variable, hour, r, q, greatest(r, q) AS worst FROM rh JOIN qh USING (variable, hour))"""


def reconciled(spark: SparkSession, sf: str) -> DataFrame:
    from maregraph.operators.classical import consolidated

    rank = F.when(F.col("decision") == "use", 0).when(F.col("decision") == "review", 1).otherwise(2)
    top = F.max("x")
    second = F.when(top > 150, 2).when(top > 80, 1).when(top.isNotNull(), 0)
    both = consolidated(obs(spark, sf), OBS).groupBy("variable", F.date_trunc("hour", "ts").alias("hour")).agg(F.max(rank).alias("r"), second.alias("q"))
    return both.filter("q is not null").withColumn("worst", F.greatest("r", "q"))  # hours that both labels have


@query(f"WITH {REC} SELECT variable, hour, r, q, worst, CASE worst WHEN 0 THEN 'GOOD' WHEN 1 THEN 'SUSPECT' ELSE 'BAD' END AS label FROM rq")
def worst_of_hour(spark: SparkSession, sf: str) -> DataFrame:
    return reconciled(spark, sf).withColumn("label", R.label_of(F.col("worst")))


@query(f"WITH {REC} SELECT variable, count(*) AS n_hours, round(avg((r = q)::INT), 8) AS agreement, count(*) FILTER (r > q) AS r_escalates, count(*) FILTER (q > r) AS q_escalates, count(*) FILTER (worst = 0) AS n_good, count(*) FILTER (worst = 1) AS n_suspect, count(*) FILTER (worst = 2) AS n_bad FROM rq GROUP BY variable")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    r, q = F.col("r"), F.col("q")
    return reconciled(spark, sf).groupBy("variable").agg(F.count("*").alias("n_hours"), F.round(F.avg((r == q).cast("double")), 8).alias("agreement"), F.count_if(r > q).alias("r_escalates"), F.count_if(q > r).alias("q_escalates"), *(F.count_if(F.col("worst") == k).alias(f"n_{n.lower()}") for n, k in R.CLASS_RANK.items()))


@query(f"WITH {REC} SELECT k AS r, count(*) FILTER (q = 0) AS good, count(*) FILTER (q = 1) AS suspect, count(*) FILTER (q = 2) AS bad FROM (SELECT unnest([0, 1, 2]) AS k) LEFT JOIN rq ON r = k GROUP BY k")
def reconcile_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    counts = reconciled(spark, sf).groupBy("r").pivot("q", [0, 1, 2]).agg(F.count(F.lit(1)))
    spine = spark.range(3).select(F.col("id").cast("int").alias("r"))
    return spine.join(counts, "r", "left").fillna(0).select("r", F.col("0").alias("good"), F.col("1").alias("suspect"), F.col("2").alias("bad"))


@query(f"WITH {FULL} SELECT {KEYS}, flag_count, dixon_flag, q_dixon_flag FROM dec")
def qc_consolidate_join(spark: SparkSession, sf: str) -> DataFrame:
    from maregraph.operators.classical import classified

    return classified(flags(spark, sf), OBS).select(*KEY, "flag_count", "dixon_flag", "q_dixon_flag")


# stability: a grid of runs (return flag x line status) of one metric
RUNS = "ru AS (SELECT l_returnflag AS model_seed, l_linestatus AS anomaly_seed, l_linenumber AS run, avg(l_discount) * 10 AS f1, count(*) AS n FROM lineitem GROUP BY ALL)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model_seed"), F.col("l_linestatus").alias("anomaly_seed"), F.col("l_linenumber").alias("run")).agg((F.avg("l_discount") * 10).alias("f1"), F.count("*").alias("n"))


@query(f"WITH {RUNS} SELECT model_seed, anomaly_seed, round(avg(f1), 8) AS mean, round(stddev_samp(f1), 8) AS sd, count(*) AS n_runs FROM ru GROUP BY ALL")
def stability_agg(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).groupBy("model_seed", "anomaly_seed").agg(F.round(F.avg("f1"), 8).alias("mean"), F.round(F.stddev_samp("f1"), 8).alias("sd"), F.count("*").alias("n_runs"))


@query(f"WITH {RUNS}, m AS (SELECT model_seed, avg(f1) AS mean FROM ru GROUP BY 1) SELECT model_seed, round(mean, 8) AS mean, rank() OVER (ORDER BY mean DESC)::INT AS rank FROM m")
def seed_ranking(spark: SparkSession, sf: str) -> DataFrame:
    m = runs(spark, sf).groupBy("model_seed").agg(F.avg("f1").alias("mean"))
    return rounded(m.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean")))), "mean", digits=8)


@query(f"WITH {RUNS}, a AS (SELECT model_seed, stddev_samp(f1) AS sd, avg(f1) AS mean FROM ru GROUP BY 1) SELECT model_seed, sd < 0.05 AS stable, mean > 0.45 AS above_base, sd < 0.05 AND mean > 0.45 AS accepted FROM a")
def acceptance_gates(spark: SparkSession, sf: str) -> DataFrame:
    a = runs(spark, sf).groupBy("model_seed").agg((F.stddev_samp("f1") < 0.05).alias("stable"), (F.avg("f1") > 0.45).alias("above_base"))
    return a.withColumn("accepted", F.col("stable") & F.col("above_base"))


@query(f"WITH {RUNS} SELECT model_seed, round(sum(f1 * n) / sum(n), 8) AS weighted, round(avg(f1), 8) AS plain, round(stddev_samp(f1), 8) AS sd FROM ru GROUP BY 1")
def weighted_rate(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).groupBy("model_seed").agg(F.round(F.sum(F.col("f1") * F.col("n")) / F.sum("n"), 8).alias("weighted"), F.round(F.avg("f1"), 8).alias("plain"), F.round(F.stddev_samp("f1"), 8).alias("sd"))


GRID2 = "gr AS (SELECT l_linenumber % 3 AS model_seed, (l_linenumber + l_orderkey) % 5 AS anomaly_seed, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL)"


@query(f"""WITH {GRID2}, m AS (SELECT v, avg(v) OVER (PARTITION BY model_seed) AS r, avg(v) OVER (PARTITION BY anomaly_seed) AS c, avg(v) OVER () AS g FROM gr), s AS (SELECT sum((v - g) * (v - g)) AS t, sum((r - g) * (r - g)) AS r, sum((c - g) * (c - g)) AS c FROM m)
SELECT round(100 * r / greatest(t, 1e-12), 4) AS pct_rows, round(100 * c / greatest(t, 1e-12), 4) AS pct_columns, round(100 * greatest(0, t - r - c) / greatest(t, 1e-12), 4) AS pct_rest FROM s""")
def variance_allocation(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 3).alias("model_seed"), ((F.col("l_linenumber") + F.col("l_orderkey")) % 5).alias("anomaly_seed"), "l_extendedprice")
    return rounded(E.variance_allocation(rows, "model_seed", "anomaly_seed", "l_extendedprice"), "pct_rows", "pct_columns", "pct_rest", digits=4)


POISSON_SQL = "CASE " + " ".join(f"WHEN u < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(E.POISSON)) + f" ELSE {len(E.POISSON)} END"
_mixed = f"((x * x % {E.PRIME}) * 16807 + x * 69621 + b) % {E.PRIME}"


@query(f"""WITH {RUNS}, ky AS (SELECT model_seed, f1, ('0x' || substr(md5(concat_ws('|', model_seed, anomaly_seed, run::VARCHAR)), 1, 7))::BIGINT AS k FROM ru), b0 AS (SELECT ky.*, b, (k * 48271 + b * 40692 + 2026) % {E.PRIME} AS x FROM ky, (SELECT unnest(range(1, 2001)) AS b)),
b1 AS (SELECT * REPLACE ({_mixed} AS x) FROM b0), b2 AS (SELECT * REPLACE ({_mixed} AS x) FROM b1), wt AS (SELECT *, {POISSON_SQL} AS w FROM (SELECT *, (x + 0.5::DOUBLE) / {E.PRIME}.0::DOUBLE AS u FROM b2)),
me AS (SELECT model_seed, b, sum(f1 * w) / nullif(sum(w), 0) AS m FROM wt GROUP BY ALL) SELECT model_seed, round((SELECT avg(f1) FROM ru WHERE ru.model_seed = me.model_seed), 8) AS mean, round(quantile_cont(m, 0.025), 8) AS lo, round(quantile_cont(m, 0.975), 8) AS hi FROM me GROUP BY model_seed""")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.bootstrap_mean(runs(spark, sf), ("model_seed",), "f1", ("model_seed", "anomaly_seed", "run")), "mean", "lo", "hi", digits=8)


@query(f"WITH {RUNS}, a AS (SELECT model_seed, avg(1 - f1 / 10) >= 0.9 AS monotonic, stddev_samp(f1) < 0.05 AS stable, avg(f1 * 1.6) > 0.75 AS above_reference FROM ru GROUP BY 1) SELECT *, coalesce(monotonic AND stable AND above_reference, false) AS accepted FROM a")
def all_gates(spark: SparkSession, sf: str) -> DataFrame:
    return E.gates(runs(spark, sf), ("model_seed",), 1 - F.col("f1") / 10, F.col("f1"), F.col("f1") * 1.6)


@query(f"WITH o AS (SELECT user_id, event_type AS family, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 3 AS k FROM events) SELECT user_id, family, (min(k) FILTER (value > 60 AND k >= 0))::DOUBLE AS first_suspect_offset, (min(k) FILTER (value > 120 AND k >= 0))::DOUBLE AS first_bad_offset, round(avg(CASE WHEN k BETWEEN 0 AND 11 THEN (value > 60)::INT END), 8) AS detection_proportion FROM o GROUP BY ALL")
def persistent_failure(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 3)
    out = E.first_offsets(e.withColumnRenamed("event_type", "family"), ("user_id", "family"), "k", F.col("value") > 60, F.col("value") > 120, 11)
    out = out.withColumns({c: F.col(c).cast("double") for c in ("first_suspect_offset", "first_bad_offset")})
    return rounded(out, "detection_proportion", digits=8)


_label = "coalesce(abs(x - (lag(x) OVER o + lead(x) OVER o) / 2) > 60, false)"


@query(f"""WITH {OBS_SQL}, a AS (SELECT *, event_id % 50 = 7 AS chosen FROM obs WHERE x IS NOT NULL), b AS (SELECT *, coalesce(lag(chosen) OVER o, false) AS shock, {_label} AS base FROM a WINDOW o AS ({W})),
c AS (SELECT * REPLACE (CASE WHEN shock THEN x + 300 ELSE x END AS x) FROM b), d AS (SELECT *, {_label} AS moved FROM c WINDOW o AS ({W})) SELECT count(*) AS n_windows, round(avg((base IS DISTINCT FROM moved)::INT), 8) AS violation_rate FROM d WHERE chosen""")
def causality_violation(spark: SparkSession, sf: str) -> DataFrame:
    """A label that reads the row after isn't causal."""
    from maregraph.operators.classical import classic_spike

    label = lambda df, s: F.coalesce(classic_spike(s) > 60, F.lit(False))
    return rounded(E.causality_violations(obs(spark, sf).filter("x is not null"), OBS, label, F.col("event_id") % 50 == 7, F.lit(300.0)), "violation_rate", digits=8)


CORR = ("l_discount", "l_tax", "l_quantity", "l_partkey", "l_suppkey")
CORR_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr(l_extendedprice, {c}), 6) AS r FROM lineitem" for c in CORR)


@query(f"WITH c AS ({CORR_SQL}) SELECT feature, r, rank() OVER (ORDER BY abs(r) DESC)::INT AS rank FROM c")
def correlation_rank(spark: SparkSession, sf: str) -> DataFrame:
    row = table(spark, sf, "lineitem").agg(*(F.round(F.corr("l_extendedprice", c), 6).alias(c) for c in CORR))
    return row.unpivot([], list(CORR), "feature", "r").withColumn("rank", F.rank().over(Window.orderBy(F.desc(F.abs("r")))))


@query(f"WITH c AS ({CORR_SQL}) SELECT feature, r FROM c WHERE feature <> 'l_partkey' ORDER BY abs(r) DESC, feature LIMIT 2")
def feature_selection(spark: SparkSession, sf: str) -> DataFrame:
    return correlation_rank(spark, sf).filter("feature <> 'l_partkey'").orderBy(F.desc(F.abs("r")), "feature").limit(2).select("feature", "r")


@query(f"WITH {OBS_SQL}, s AS (SELECT station, count(x) AS n FROM obs GROUP BY 1) SELECT station, n, unnest([10, 20, 30, 40, 50])::INT AS anomaly_seed, station + 1 AS model_seed FROM s")
def seed_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of an experiment: every station's model with every seed of anomalies, and the values it learns from."""
    by = obs(spark, sf).groupBy("station").agg(F.count("x").alias("n"))
    return by.select("station", "n", F.explode(F.array(*map(F.lit, (10, 20, 30, 40, 50)))).alias("anomaly_seed"), (F.col("station") + 1).alias("model_seed"))


LOBO = f"{OBS_SQL}, fo AS (SELECT unnest(range(6)) AS fold), lo AS (SELECT fold, avg(x) AS m, count(x) AS n FROM obs JOIN fo ON station <> fold GROUP BY fold)"


def left_out(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of all stations but one, from sums by station: no row is read twice."""
    by = obs(spark, sf).groupBy("station").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    folds = by.select(F.col("station").alias("fold"))
    return folds.join(by, folds["fold"] != by["station"]).groupBy("fold").agg((F.sum("s") / F.sum("n")).alias("m"), F.sum("n").alias("n"))


@query(f"WITH {LOBO} SELECT fold, round(m, 6) AS m, n FROM lo")
def leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(left_out(spark, sf), "m")


@query(f"WITH {LOBO}, st AS (SELECT station, avg(x) AS own FROM obs WHERE station <> 3 GROUP BY 1) SELECT fold, round(m, 6) AS m, round(own, 6) AS own, round(m - own, 6) AS delta FROM lo LEFT JOIN st ON station = fold")
def lobo_delta(spark: SparkSession, sf: str) -> DataFrame:
    own = obs(spark, sf).filter("station <> 3").groupBy(F.col("station").alias("fold")).agg(F.avg("x").alias("own"))
    out = left_out(spark, sf).join(own, "fold", "left").select("fold", "m", "own", (F.col("m") - F.col("own")).alias("delta"))
    return rounded(out, "m", "own", "delta")


@query(f"WITH {OBS_SQL}, a AS (SELECT station::VARCHAR AS station, avg(x) AS m, stddev_samp(x) AS sd FROM obs GROUP BY 1) SELECT station, round(m, 6) AS m, round(sd, 6) AS sd FROM a UNION ALL SELECT 'mean', round(avg(m), 6), round(avg(sd), 6) FROM a")
def lobo_mean_row(spark: SparkSession, sf: str) -> DataFrame:
    a = obs(spark, sf).groupBy(F.col("station").cast("string").alias("station")).agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    return rounded(a.unionByName(a.agg(F.lit("mean").alias("station"), F.avg("m").alias("m"), F.avg("sd").alias("sd"))), "m", "sd")


# behaviour: every row is shocked by k deviations either way; a logistic of the distance stands for the model
SHOCK = """sc AS (SELECT event_id AS idx, value AS x, k, sg, 1 / (1 + exp(-(abs(value + sg * k * 30.0 - 40) - 60) / 20.0)) AS p_bad FROM events, (SELECT unnest([0, 1, 2, 3, 4, 6]) AS k), (SELECT unnest([-1, 1]) AS sg))"""


def shocked(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("idx"), F.col("value").alias("x"), F.explode(F.array(*map(F.lit, (0, 1, 2, 3, 4, 6)))).alias("k"))
    e = e.withColumn("sg", F.explode(F.array(F.lit(-1), F.lit(1))))
    return e.withColumn("p_bad", 1 / (1 + F.exp(-(F.abs(F.col("x") + F.col("sg") * F.col("k") * 30.0 - 40) - 60) / 20.0)))


@query(f"WITH {SHOCK}, l AS (SELECT *, lead(p_bad) OVER (PARTITION BY idx, sg ORDER BY k) AS nx FROM sc) SELECT sg, count(nx) AS n_pairs, round(avg((nx >= p_bad - 1e-6)::INT), 8) AS rate FROM l WHERE nx IS NOT NULL GROUP BY sg")
def monotonicity_rate(spark: SparkSession, sf: str) -> DataFrame:
    nxt = F.lead("p_bad").over(Window.partitionBy("idx", "sg").orderBy("k"))
    rows = shocked(spark, sf).withColumn("nx", nxt).filter("nx is not null")
    return rows.groupBy("sg").agg(F.count("*").alias("n_pairs"), F.round(F.avg((F.col("nx") >= F.col("p_bad") - 1e-6).cast("double")), 8).alias("rate"))


@query(f"WITH {SHOCK}, p AS (SELECT idx, max(p_bad) FILTER (sg = -1 AND k = 2) AS a, max(p_bad) FILTER (sg = 1 AND k = 2) AS b FROM sc GROUP BY 1) SELECT count(*) AS n, round(avg(((a >= 0.5) = (b >= 0.5))::INT), 8) AS same, round(avg(abs(a - b)), 8) AS mean_gap FROM p")
def context_consistency(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda sg: F.max(F.when((F.col("sg") == sg) & (F.col("k") == 2), F.col("p_bad")))
    p = shocked(spark, sf).groupBy("idx").agg(pick(-1).alias("a"), pick(1).alias("b"))
    return p.agg(F.count("*").alias("n"), F.round(F.avg(((F.col("a") >= 0.5) == (F.col("b") >= 0.5)).cast("double")), 8).alias("same"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 8).alias("mean_gap"))


@query(f"WITH {SHOCK}, f AS (SELECT idx, sg, min(k) FILTER (p_bad >= 0.3) AS first_suspect, min(k) FILTER (p_bad >= 0.6) AS first_bad FROM sc GROUP BY ALL) SELECT sg, round(avg(first_suspect), 8) AS suspect_at, round(avg(first_bad), 8) AS bad_at, round(avg((first_bad IS NULL)::INT), 8) AS censored FROM f GROUP BY sg")
def recovery_time(spark: SparkSession, sf: str) -> DataFrame:
    first = lambda p: F.min(F.when(F.col("p_bad") >= p, F.col("k")))
    f = shocked(spark, sf).groupBy("idx", "sg").agg(first(0.3).alias("s"), first(0.6).alias("b"))
    return f.groupBy("sg").agg(F.round(F.avg("s"), 8).alias("suspect_at"), F.round(F.avg("b"), 8).alias("bad_at"), F.round(F.avg(F.col("b").isNull().cast("double")), 8).alias("censored"))


@query(f"WITH {SHOCK}, b AS (SELECT idx, sg, p_bad AS base FROM sc WHERE k = 0) SELECT k, sg, round(avg(abs(p_bad - base)), 8) AS sensitivity, round(avg(((p_bad >= 0.5) <> (base >= 0.5))::INT), 8) AS changed FROM sc JOIN b USING (idx, sg) WHERE k > 0 GROUP BY ALL")
def aux_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    rows = shocked(spark, sf)
    base = rows.filter("k = 0").select("idx", "sg", F.col("p_bad").alias("base"))
    out = rows.filter("k > 0").join(base, ["idx", "sg"]).groupBy("k", "sg")
    return out.agg(F.round(F.avg(F.abs(F.col("p_bad") - F.col("base"))), 8).alias("sensitivity"), F.round(F.avg(((F.col("p_bad") >= 0.5) != (F.col("base") >= 0.5)).cast("double")), 8).alias("changed"))


@query(f"WITH {OBS_SQL}, c AS (SELECT variable, count(*) AS k FROM obs GROUP BY 1) SELECT variable, k AS n, round((SELECT sum(k) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * k), 8) AS weight FROM c")
def class_weight(spark: SparkSession, sf: str) -> DataFrame:
    return M.class_weights(obs(spark, sf), "variable").groupBy("variable").agg(F.count("*").alias("n"), F.round(F.max("weight"), 8).alias("weight"))


# streams over the events table: its rows arrive in two parts by time, then a row far later closes what is open
def _replayed(spark: SparkSession, sf: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that a stream operator appends, over three runs of one query that go on from its checkpoint in the session's shared folder."""
    path = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = e.agg(F.timestamp_seconds((F.unix_seconds(F.min("ts")) + F.unix_seconds(F.max("ts"))) / 2).alias("t"), F.max("ts").alias("last")).first()
    closing = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in e.schema)).withColumns({"ts": F.lit(middle["last"]) + F.expr("interval 100 days"), "event_type": F.lit("~end"), "user_id": F.lit(-1).cast(e.schema["user_id"].dataType), "event_id": F.lit(-1).cast(e.schema["event_id"].dataType)})
    out = None
    for k, part in enumerate((e.filter(F.col("ts") < F.lit(middle["t"])), e.filter(F.col("ts") >= F.lit(middle["t"])), closing)):
        part.select(e.columns).write.parquet(f"{path}/in/{k}")
        raw = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(f"{path}/in")
        out = operator(raw.select("*", (F.col("user_id") % 6).alias("station"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("x")))
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    gone_at_exit(spark, path)
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("SELECT event_type, date_trunc('hour', ts) AS hour, round(median(value), 6) AS value FROM events GROUP BY ALL")
def stream_hourly_median(spark: SparkSession, sf: str) -> DataFrame:
    out = _replayed(spark, sf, lambda e: Q.hourly_medians(e, "ts", "event_type", "value"))
    return out.filter("event_type <> '~end'").select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), F.round("value", 6).alias("value"))


@query("""WITH o AS (SELECT event_type, ts, ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events), s AS (SELECT event_type, ts, sum((gap IS NULL OR gap >= INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM o)
SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY event_type, k""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = _replayed(spark, sf, lambda e: Q.sessions(e, "ts", "event_type"))
    return out.filter("event_type <> '~end'").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM (SELECT DISTINCT user_id, event_type FROM events)")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = _replayed(spark, sf, lambda e: Q.deduplicated(e, "ts", ["user_id", "event_type"], "400 days").select("user_id", "event_type"))
    return out.filter("event_type <> '~end'").agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_users"))


@query(f"""WITH RECURSIVE {OBS_SQL}, a AS (SELECT station, ts, event_id, coalesce(x, 0) AS v, sign(coalesce(x, 0)) AS sg, lag(sign(coalesce(x, 0))) OVER o AS before, lag(coalesce(x, 0)) OVER o AS last, row_number() OVER o AS i FROM obs WINDOW o AS ({SW})),
b AS (SELECT *, sum((sg = 0 OR before IS NULL OR sg <> before)::INT) OVER ({SW}) AS run FROM a),
rec AS (SELECT station, i, v::DOUBLE AS ewma, 0::DOUBLE AS up, 0::DOUBLE AS down FROM a WHERE i = 1 UNION ALL SELECT a.station, a.i, 0.3::DOUBLE * v + (1 - 0.3::DOUBLE) * ewma, CASE WHEN up + v - 25 > 1000 THEN 0 ELSE greatest(0, up + v - 25) END, CASE WHEN down - v - 25 > 1000 THEN 0 ELSE greatest(0, down - v - 25) END FROM rec JOIN a ON a.station = rec.station AND a.i = rec.i + 1)
SELECT b.station, event_id, row_number() OVER (PARTITION BY b.station, run ORDER BY ts, event_id) AS persistence, round(coalesce(abs(v - last), 0), 6) AS rate, round(ewma, 5) AS ewma, round(up, 4) AS cusum_pos, round(down, 4) AS cusum_neg FROM b JOIN rec ON rec.station = b.station AND rec.i = b.i""")
def stream_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = _replayed(spark, sf, lambda e: Q.causal_scores(e.select("station", "ts", "event_id", "x"), slack=25.0, reset=1000.0, silence="90 days"))
    return out.filter("event_id >= 0").select("station", "event_id", "persistence", F.round("rate", 6).alias("rate"), F.round("ewma", 5).alias("ewma"), F.round("cusum_pos", 4).alias("cusum_pos"), F.round("cusum_neg", 4).alias("cusum_neg"))
