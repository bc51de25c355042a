"""Queries of resampling, causal indicators, detectors, injection and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maregraph.operators import causal as K
from maregraph.operators import detectors as D
from maregraph.operators import inject as I
from maregraph.operators import models as M
from maregraph.operators import tails as L
from maregraph.operators.classical import classic_spike
from maregraph.operators.series import Series, hourly, interpolated, mean_of_steps, over_key, sequences, split, tail, three_step_sequences, with_statistics
from maregraph.operators import classical
from maregraph.operators.chunked import in_chunks
from maregraph.operators.features import VECTOR, causal_vector
from maregraph.operators.peaks import peaks
from maregraph.operators.quantiles import with_quantiles
from maregraph.operators.work import gone_at_exit, stored
from maregraph.plans.classical import S1, SCORES, Q
from maregraph.plans.registry import SQL, KEY, KEYS, OBS, OBS_SQL, PART, W, frame, obs, query, rounded, scratch, table
from maregraph.sources.tables import TIME_PARTS, hourly_payload, load_each, read_csv, read_observations, read_wind, timestamp, write_csv

HOURLY = Series(("variable",), ("hour",), "value")
HW = "PARTITION BY variable ORDER BY hour"
#: Six-hourly medians leave no gap, hourly ones do; a third of the hours is taken out to make gaps of all lengths.
GRID = f"""{OBS_SQL}, hm AS (SELECT variable, date_trunc('hour', ts) AS hour, median(x) AS value FROM obs GROUP BY ALL), sp AS (SELECT variable, min(hour) AS lo, max(hour) AS hi FROM hm GROUP BY 1),
gr AS (SELECT variable, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM sp), h AS (SELECT gr.variable, gr.hour, hm.value FROM gr LEFT JOIN hm USING (variable, hour))"""
HOLES = f"{GRID}, g AS (SELECT variable, hour, CASE WHEN (hour(hour) + day(hour) * 5) % 16 < 7 THEN NULL ELSE value END AS value FROM h)"
BOTH = f"""i AS (SELECT *, row_number() OVER ({HW}) AS i FROM g), p AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni,
last_value(value IGNORE NULLS) OVER b AS pv, first_value(value IGNORE NULLS) OVER a AS nv FROM i WINDOW b AS ({HW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS ({HW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, CASE WHEN value IS NOT NULL THEN value WHEN coalesce(i - pi <= 3, false) OR coalesce(ni - i <= 3, false) THEN CASE WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0) END END AS filled FROM p)"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(obs(spark, sf), Series(("variable",), ("ts", "event_id"), "x"))


def holes(spark: SparkSession, sf: str) -> DataFrame:
    gap = (F.hour("hour") + F.dayofmonth("hour") * 5) % 16 < 7
    return grid(spark, sf).withColumn("value", F.when(~gap, F.col("value")))


@query(f"WITH {GRID} SELECT variable, hour, value FROM h")
def hourly_median(spark: SparkSession, sf: str) -> DataFrame:
    return grid(spark, sf)


@query(f"WITH {HOLES}, {BOTH} SELECT variable, hour, round(filled, 6) AS filled FROM f")
def interpolate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(holes(spark, sf).select("variable", "hour", interpolated(None, HOURLY).alias("filled")), "filled")


@query(f"WITH {HOLES}, {BOTH} SELECT variable, hour, (value IS NULL)::INT AS missing_mask, coalesce(lag((value IS NULL)::INT) OVER ({HW}), 1) AS previous_mask FROM f WHERE true QUALIFY filled IS NOT NULL")
def missing_mask(spark: SparkSession, sf: str) -> DataFrame:
    mask = F.col("value").isNull().cast("int")
    out = holes(spark, sf).select("variable", "hour", interpolated(None, HOURLY).alias("filled"), mask.alias("missing_mask"), F.coalesce(F.lag(mask).over(HOURLY.window), F.lit(1)).alias("previous_mask"))
    return out.filter("filled is not null").drop("filled")


@query(f"WITH {GRID}, m AS (SELECT variable, hour, 1 AS flagged FROM h WHERE value > 60) SELECT h.variable, h.hour, coalesce(m.flagged, 0) AS flagged FROM h LEFT JOIN m USING (variable, hour)")
def mask_reindex(spark: SparkSession, sf: str) -> DataFrame:
    h = grid(spark, sf)
    marked = h.filter("value > 60").select("variable", "hour", F.lit(1).alias("flagged"))
    return h.select("variable", "hour").join(marked, ["variable", "hour"], "left").fillna(0, ["flagged"])


@query(f"WITH {GRID}, o AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n_all, round(avg(value), 6) AS mean_all FROM events GROUP BY 1) SELECT h.variable, h.hour, h.value, coalesce(o.n_all, 0) AS n_all, o.mean_all FROM h LEFT JOIN o USING (hour)")
def left_join_hourly(spark: SparkSession, sf: str) -> DataFrame:
    other = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n_all"), F.round(F.avg("value"), 6).alias("mean_all"))
    return grid(spark, sf).join(other, "hour", "left").fillna(0, ["n_all"]).select("variable", "hour", "value", "n_all", "mean_all")


@query(f"WITH {GRID} SELECT variable, hour, value FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY hour DESC) AS n FROM h WHERE value IS NOT NULL) WHERE n <= 240")
def tail_n(spark: SparkSession, sf: str) -> DataFrame:
    return tail(grid(spark, sf), HOURLY, 240)


@query(f"WITH {OBS_SQL}, i AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER ({PART}) AS n FROM obs) SELECT {KEYS}, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'train' WHEN i < floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) THEN 'validation' ELSE 'test' END AS part FROM i")
def chrono_split(spark: SparkSession, sf: str) -> DataFrame:
    return split(obs(spark, sf), OBS).select(*KEY, "part")


@query(f"WITH {OBS_SQL}, s AS (SELECT {KEYS}, list(x) OVER {frame('12 PRECEDING', '1 PRECEDING')} AS a FROM obs WHERE x IS NOT NULL) SELECT {KEYS}, round(list_sum(a), 5) AS history_sum, a[1] AS oldest, a[12] AS newest FROM s WHERE len(a) = 12")
def sequence_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = sequences(obs(spark, sf).filter("x is not null"), OBS, 12)
    return out.select(*KEY, F.round(F.aggregate("history", F.lit(0.0), lambda a, v: a + v), 5).alias("history_sum"), F.col("history")[0].alias("oldest"), F.col("history")[11].alias("newest"))


@query(f"""WITH {OBS_SQL}, a AS (SELECT variable, count(*) AS n_raw, count(x) AS n_valid, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS span, count(DISTINCT date_trunc('hour', ts)) FILTER (x IS NOT NULL) AS hours FROM obs GROUP BY 1)
SELECT variable, n_raw, n_valid, round(mean, 4) AS mean, round(sd, 4) AS sd, lo, hi, (floor(span) + 1)::BIGINT AS span_hours, round(100.0 * n_valid / n_raw, 4) AS raw_coverage_pct, round(100.0 * hours / (floor(span) + 1), 4) AS hourly_coverage_pct FROM a""")
def eda_stats(spark: SparkSession, sf: str) -> DataFrame:
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3.6e9
    a = obs(spark, sf).groupBy("variable").agg(F.count("*").alias("n_raw"), F.count("x").alias("n_valid"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi"), (F.floor(span) + 1).alias("span_hours"), F.count_distinct(F.when(F.col("x").isNotNull(), F.date_trunc("hour", "ts"))).alias("hours"))
    return a.select("variable", "n_raw", "n_valid", "mean", "sd", "lo", "hi", "span_hours", F.round(100.0 * F.col("n_valid") / F.col("n_raw"), 4).alias("raw_coverage_pct"), F.round(100.0 * F.col("hours") / F.col("span_hours"), 4).alias("hourly_coverage_pct"))


@query("WITH d AS (SELECT l_returnflag, l_shipdate::DATE AS day, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), s AS (SELECT l_returnflag, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY 1) SELECT s.l_returnflag, year(s.day)::INT AS year, count(*) AS n_days, round(100.0 * count(d.q) / count(*), 6) AS coverage_pct FROM s LEFT JOIN d USING (l_returnflag, day) GROUP BY ALL")
def coverage_by_year(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").groupBy("l_returnflag", F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("q"))
    s = d.groupBy("l_returnflag").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("l_returnflag", F.explode(F.sequence("lo", "hi")).alias("day"))
    out = s.join(d, ["l_returnflag", "day"], "left").groupBy("l_returnflag", F.year("day").alias("year"))
    return out.agg(F.count("*").alias("n_days"), F.round(100.0 * F.count("q") / F.count("*"), 6).alias("coverage_pct"))


@query(f"""WITH {OBS_SQL}, a AS (SELECT station, count(*) AS n_raw, min(ts) AS first_ts, max(ts) AS last_ts, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9)::BIGINT + 1 AS span_hours, count(DISTINCT date_trunc('hour', ts)) FILTER (x IS NOT NULL) AS n_hours FROM obs GROUP BY 1)
SELECT *, floor(n_hours * 0.6::DOUBLE)::BIGINT AS n_train, floor(n_hours * 0.8::DOUBLE)::BIGINT - floor(n_hours * 0.6::DOUBLE)::BIGINT AS n_validation, n_hours - floor(n_hours * 0.8::DOUBLE)::BIGINT AS n_test, greatest(0, n_hours - floor(n_hours * 0.8::DOUBLE)::BIGINT - 168) AS test_sequences FROM a""")
def station_census(spark: SparkSession, sf: str) -> DataFrame:
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3.6e9
    a = obs(spark, sf).groupBy("station").agg(F.count("*").alias("n_raw"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (F.floor(span) + 1).alias("span_hours"), F.count_distinct(F.when(F.col("x").isNotNull(), F.date_trunc("hour", "ts"))).alias("n_hours"))
    n60, n80 = F.floor(F.col("n_hours") * 0.6), F.floor(F.col("n_hours") * 0.8)
    return a.withColumns({"n_train": n60, "n_validation": n80 - n60, "n_test": F.col("n_hours") - n80, "test_sequences": F.greatest(F.lit(0).cast("long"), F.col("n_hours") - n80 - 168)})


# causal indicators run on the values with missing ones set to the series' median, and on the change from the last value as the residual
FILLED = f"{OBS_SQL}, md AS (SELECT station, variable, median(x) AS m FROM obs GROUP BY ALL), v AS (SELECT obs.station, obs.variable, event_id, ts, coalesce(x, m) AS x FROM obs JOIN md USING (station, variable)), e AS (SELECT *, coalesce(x - lag(x) OVER ({W}), 0) AS e FROM v)"


def filled(spark: SparkSession, sf: str) -> DataFrame:
    out = over_key(obs(spark, sf), OBS.keys, _m=F.median("x")).withColumn("x", F.coalesce("x", "_m")).drop("_m")
    return out.withColumn("e", F.coalesce(F.col("x") - F.lag("x").over(OBS.window), F.lit(0.0)))


def _trail(value: str) -> str:
    return f"fr AS (SELECT *, list_sort(list({value}) OVER {frame('24 PRECEDING', '1 PRECEDING')}) AS a FROM src), tm AS (SELECT *, CASE WHEN len(list_filter(a, lambda z: z IS NOT NULL)) >= 3 THEN list_median(a) END AS med FROM fr), td AS (SELECT *, CASE WHEN med IS NOT NULL THEN list_median(list_transform(a, lambda z: abs(z - med))) END AS mad FROM tm)"


def _list_median(sql: str) -> str:
    return sql.replace("list_median(", "list_aggregate(").replace("list_aggregate(a)", "list_aggregate(a, 'median')").replace("abs(z - med)))", "abs(z - med)), 'median')")


@query(_list_median(f"WITH {FILLED}, src AS (SELECT * FROM e), {_trail('x')} SELECT {KEYS}, round(coalesce(abs(x - med) / (1.4826 * mad + 1e-6), 0), 5) AS level_score FROM td"))
def level_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.level_score(filled(spark, sf), OBS).select(*KEY, "level_score"), "level_score", digits=5)


@query(_list_median(f"WITH {FILLED}, src AS (SELECT *, x - 2 * lag(x) OVER ({W}) + lag(x, 2) OVER ({W}) AS acc FROM e), {_trail('acc')} SELECT {KEYS}, round(coalesce(abs(acc) / (1.4826 * mad + 1e-6), 0), 4) AS acc_score FROM td"))
def acc_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.acceleration_score(filled(spark, sf), OBS).select(*KEY, "acc_score"), "acc_score", digits=4)


@query(f"WITH {FILLED} SELECT {KEYS}, round(coalesce(abs(x - lag(x) OVER ({W})), 0), 6) AS rate_score FROM v")
def rate_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(filled(spark, sf).select(*KEY, K.rate(OBS).alias("rate_score")), "rate_score")


REC = f"n AS (SELECT *, row_number() OVER ({W}) AS i FROM e)"


EWMA_SQL = f"""WITH RECURSIVE {FILLED}, {REC}, rec AS (SELECT station, variable, event_id, i, e AS e0, e AS e1, e AS e2 FROM n WHERE i = 1 UNION ALL
SELECT n.station, n.variable, n.event_id, n.i, 0.1::DOUBLE * n.e + (1 - 0.1::DOUBLE) * e0, 0.3::DOUBLE * n.e + (1 - 0.3::DOUBLE) * e1, 0.6::DOUBLE * n.e + (1 - 0.6::DOUBLE) * e2 FROM rec JOIN n ON n.station = rec.station AND n.variable = rec.variable AND n.i = rec.i + 1)
SELECT {KEYS}, round(e0, 6) AS ewma_0, round(e1, 6) AS ewma_1, round(e2, 6) AS ewma_2 FROM rec"""


@query(EWMA_SQL)
def ewma(spark: SparkSession, sf: str) -> DataFrame:
    out = K.recursive_memory(filled(spark, sf), OBS, "e", ("event_id",))
    return rounded(out.select(*KEY, "ewma_0", "ewma_1", "ewma_2"), "ewma_0", "ewma_1", "ewma_2")


CUSUM_SQL = f"""WITH RECURSIVE {FILLED}, {REC}, sg AS (SELECT station, variable, coalesce(nullif(stddev_samp(e), 0), 1e-6) AS sg FROM e GROUP BY ALL), m AS (SELECT n.*, sg FROM n JOIN sg USING (station, variable)),
rec AS (SELECT station, variable, event_id, i, 0::DOUBLE AS up, 0::DOUBLE AS down FROM m WHERE i = 1 UNION ALL
SELECT m.station, m.variable, m.event_id, m.i, CASE WHEN greatest(0, up + e - 0.5 * sg) > 20 * sg THEN 0 ELSE greatest(0, up + e - 0.5 * sg) END, CASE WHEN greatest(0, down - e - 0.5 * sg) > 20 * sg THEN 0 ELSE greatest(0, down - e - 0.5 * sg) END
FROM rec JOIN m ON m.station = rec.station AND m.variable = rec.variable AND m.i = rec.i + 1) SELECT {KEYS}, round(up, 5) AS cusum_pos, round(down, 5) AS cusum_neg FROM rec"""


@query(CUSUM_SQL)
def cusum(spark: SparkSession, sf: str) -> DataFrame:
    out = K.recursive_memory(filled(spark, sf), OBS, "e", ("event_id",))
    return rounded(out.select(*KEY, "cusum_pos", "cusum_neg"), "cusum_pos", "cusum_neg", digits=5)


@query(EWMA_SQL)
def ewma_chunked(spark: SparkSession, sf: str) -> DataFrame:
    """The averages with every series cut into chunks of 100 rows, as for series that no task can hold."""
    out = K.recursive_memory(filled(spark, sf), OBS, "e", ("event_id",), rows=100)
    return rounded(out.select(*KEY, "ewma_0", "ewma_1", "ewma_2"), "ewma_0", "ewma_1", "ewma_2")


@query(CUSUM_SQL)
def cusum_chunked(spark: SparkSession, sf: str) -> DataFrame:
    out = K.recursive_memory(filled(spark, sf), OBS, "e", ("event_id",), rows=100)
    return rounded(out.select(*KEY, "cusum_pos", "cusum_neg"), "cusum_pos", "cusum_neg", digits=5)


@query(f"""WITH {FILLED}, {REC}, sg AS (SELECT station, variable, coalesce(nullif(stddev_samp(e), 0), 1e-6) AS sg FROM e GROUP BY ALL), c AS (SELECT n.*, sum(CASE WHEN i = 1 THEN 0 ELSE e - 0.5 * sg END) OVER ({W}) AS up, sum(CASE WHEN i = 1 THEN 0 ELSE -e - 0.5 * sg END) OVER ({W}) AS down FROM n JOIN sg USING (station, variable))
SELECT {KEYS}, round(up - least(0, min(up) OVER ({W})), 5) AS cusum_pos, round(down - least(0, min(down) OVER ({W})), 5) AS cusum_neg FROM c""")
def cusum_no_reset(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.cusum_windows(filled(spark, sf), OBS, "e").select(*KEY, "cusum_pos", "cusum_neg"), "cusum_pos", "cusum_neg", digits=5)


@query(f"WITH {FILLED}, {REC} SELECT {KEYS}, " + ", ".join(f"round(coalesce(CASE WHEN count(*) OVER w{k} >= 3 THEN regr_slope(e, i) OVER w{k} END, 0), 5) AS slope_{k}" for k in K.SLOPE_WINDOWS) + " FROM n WINDOW " + ", ".join(f"w{k} AS {frame(f'{k - 1} PRECEDING', 'CURRENT ROW')}" for k in K.SLOPE_WINDOWS))
def rolling_slope(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"slope_{k}" for k in K.SLOPE_WINDOWS]
    return rounded(K.rolling_slope(filled(spark, sf), OBS, "e").select(*KEY, *names), *names, digits=5)


@query(f"WITH {FILLED}, a AS (SELECT *, sign(e) AS sg, lag(sign(e)) OVER ({W}) AS before FROM e), b AS (SELECT *, sum((sg = 0 OR before IS NULL OR sg <> before)::INT) OVER ({W}) AS run FROM a) SELECT {KEYS}, row_number() OVER ({PART}, run ORDER BY ts, event_id)::INT AS persistence FROM b")
def sign_persistence(spark: SparkSession, sf: str) -> DataFrame:
    return K.sign_persistence(filled(spark, sf), OBS, "e").select(*KEY, "persistence")


@query(f"WITH {OBS_SQL} SELECT {KEYS}, max((x IS NULL)::INT) OVER {frame('1 PRECEDING', '1 FOLLOWING')} > 0 AS near_gap FROM obs")
def near_gap(spark: SparkSession, sf: str) -> DataFrame:
    return obs(spark, sf).select(*KEY, K.near_gap(OBS, F.col("x").isNull().cast("int")).alias("near_gap"))


PRED = f"{FILLED}, pr AS (SELECT *, lag(x) OVER ({W}) AS predicted FROM v), df AS (SELECT *, avg(x) OVER {frame('1 PRECEDING', '1 FOLLOWING')} AS m FROM pr), dm AS (SELECT *, abs(x - predicted) / CASE WHEN abs(m) >= 1e-6 THEN m END AS diff FROM df)"


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    out = filled(spark, sf).withColumn("predicted", F.lag("x").over(OBS.window))
    return out.withColumn("diff", D.diff_mean(OBS, F.col("predicted")))


@query(f"WITH {PRED} SELECT {KEYS}, round(diff, 6) AS diff FROM dm")
def diffmean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(predicted(spark, sf).select(*KEY, "diff"), "diff")


@query(f"WITH {PRED} SELECT {KEYS}, round(x - predicted, 6) AS residual FROM pr")
def persistence_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return predicted(spark, sf).select(*KEY, F.round(F.col("x") - F.col("predicted"), 6).alias("residual"))


ERRORS = "round(avg(abs(x - predicted)), 6) AS mae, round(avg((x - predicted) * (x - predicted)), 4) AS mse, round(sqrt(avg((x - predicted) * (x - predicted))), 5) AS rmse, round(100 * avg(CASE WHEN abs(x) >= 1e-6 THEN abs((x - predicted) / x) END), 4) AS mape, count(x - predicted) AS n"


@query(f"WITH {PRED} SELECT variable, {ERRORS} FROM pr GROUP BY variable")
def forecast_error(spark: SparkSession, sf: str) -> DataFrame:
    from maregraph.operators.metrics import forecast_errors

    out = forecast_errors(predicted(spark, sf), F.col("x"), F.col("predicted"), ("variable",))
    return out.select("variable", F.round("mae", 6).alias("mae"), F.round("mse", 4).alias("mse"), F.round("rmse", 5).alias("rmse"), F.round("mape", 4).alias("mape"), "n")


@query(f"WITH {OBS_SQL}, {S1}, m AS (SELECT station, variable, median(classic) AS m FROM s1 GROUP BY ALL), n AS (SELECT station, variable, m, median(abs(classic - m)) AS d FROM s1 JOIN m USING (station, variable) GROUP BY ALL) SELECT s1.station, s1.variable, event_id, round(m + 6 * 1.4826 * d, 6) AS \"limit\", coalesce(classic > m + 6 * 1.4826 * d, false) AS spike FROM s1 JOIN n USING (station, variable)")
def traditional_spike(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.traditional_spike(obs(spark, sf), OBS).select(*KEY, "limit", "spike"), "limit")


T_SQL = f"{PRED}, ds AS (SELECT *, coalesce(diff, 0) AS s FROM dm), sc AS (SELECT station, variable, nullif(median(s), 0) / 0.7406970841126811 AS scale FROM ds GROUP BY ALL), tv AS (SELECT ds.*, s / scale AS t FROM ds JOIN sc USING (station, variable)), tp AS (SELECT *, 2 * (0.5 - 0.375 * (t / sqrt(1 + t * t / 4)) * (1 - t * t / (12 * (1 + t * t / 4)))) AS p FROM tv)"


@query(f"WITH {T_SQL} SELECT {KEYS}, round(p, 8) AS p_robust FROM tp")
def robust_t_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.robust_t(predicted(spark, sf), OBS.keys, "diff").select(*KEY, "p_robust"), "p_robust", digits=8)


@query(f"WITH {T_SQL} SELECT {KEYS}, round(1 - (rank() OVER ({PART} ORDER BY s) - 1) / count(*) OVER ({PART}), 8) AS p_rank FROM ds")
def empirical_tail_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.empirical_tail(predicted(spark, sf), OBS.keys, "diff").select(*KEY, "p_rank"), "p_rank", digits=8)


@query(f"WITH {T_SQL} SELECT variable, a.alpha, sum(coalesce(p < a.alpha, false)::INT)::BIGINT AS n_flagged, sum((event_id % 29 = 0)::INT)::BIGINT AS n_true, sum((coalesce(p < a.alpha, false) AND event_id % 29 = 0)::INT)::BIGINT AS hits FROM tp, (SELECT unnest([{', '.join(map(str, D.ALPHAS))}]::DOUBLE[]) AS alpha) a GROUP BY ALL")
def alpha_sweep(spark: SparkSession, sf: str) -> DataFrame:
    scored = D.robust_t(predicted(spark, sf), OBS.keys, "diff")
    return D.alpha_sweep(scored, ("variable",), "p_robust", F.col("event_id") % 29 == 0)


@query(f"WITH {SCORES} SELECT {KEYS}, round(mad_score, 6) AS mad_score, round(local_std, 5) AS local_std_score FROM sc")
def mad_score_chunked(spark: SparkSession, sf: str) -> DataFrame:
    """The rolling tests with every series cut into chunks, as for series that no task can hold."""
    out = in_chunks(obs(spark, sf), OBS, 64, classical.scores, F.to_date("ts"), rows=150)
    return out.select(*KEY, F.round("mad_score", 6).alias("mad_score"), F.round("local_std_score", 5).alias("local_std_score"))


@query(_list_median(f"WITH {FILLED}, src AS (SELECT * FROM e), {_trail('x')} SELECT {KEYS}, round(coalesce(abs(x - med) / (1.4826 * mad + 1e-6), 0), 5) AS level_score FROM td"))
def level_score_chunked(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(in_chunks(filled(spark, sf), OBS, 24, K.level_score, F.to_date("ts"), rows=100).select(*KEY, "level_score"), "level_score", digits=5)


@query(f"WITH {OBS_SQL}, {Q} SELECT {KEYS}, round(q, 6) AS q, q_dixon_flag FROM qf")
def qdixon_chunked(spark: SparkSession, sf: str) -> DataFrame:
    out = in_chunks(obs(spark, sf).filter("x is not null"), OBS, 10, classical.q_dixon, F.to_date("ts"), rows=100)
    return rounded(out.select(*KEY, "q", "q_dixon_flag"), "q")


@query(f"WITH {GRID}, o AS (SELECT date_trunc('hour', ts) AS hour, round(avg(value) FILTER (event_type = 'view'), 6) AS speed FROM events GROUP BY 1) SELECT variable, hour, value, speed FROM h LEFT JOIN o USING (hour)")
def wind_join(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly values beside a wind file that is written and read back."""
    path = f"{scratch(spark)}/wind-{uuid.uuid4().hex}"
    wind = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.avg(F.when(F.col("event_type") == "view", F.col("value"))), 6).alias("speed"))
    wind.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("datetime_utc"), F.col("speed").alias("wind_speed_10m"), F.lit(None).cast("double").alias("wind_direction_10m"), F.lit(None).cast("double").alias("wind_gusts_10m")).write.option("header", True).option("nullValue", "NULL").csv(path)
    gone_at_exit(spark, path)
    read = read_wind(spark, path).select(F.col("ts").cast("timestamp_ntz").alias("hour"), F.col("wind_speed_10m").alias("speed"))
    return grid(spark, sf).join(read, "hour", "left").select("variable", "hour", "value", "speed")


@query()
def lobo_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return M.leave_one_out_forecasts(filled(spark, sf), OBS, "x", "station")


GRID_POINTS = [f"(1 - 1e-6::DOUBLE) / top * {k / L.SIDE!r}::DOUBLE" for k in range(-L.SIDE, 0)] + ["0::DOUBLE"] + [f"10 / mean * {(k / L.SIDE) * (k / L.SIDE)!r}::DOUBLE" for k in range(1, L.SIDE + 1)]


def _fit_sql(source: str, score: str) -> str:
    """The tail of each series' `score` in `source` by the same grids: `gpd` with threshold, shape, scale, p_exceed, n_exceed."""
    out = f"""gs AS (SELECT station, variable, coalesce({score}, 0) AS s FROM {source}), gt AS (SELECT station, variable, quantile_cont(s, 0.9) AS threshold, count(*) AS n FROM gs GROUP BY ALL),
ge AS (SELECT station, variable, s - threshold AS z FROM gs JOIN gt USING (station, variable) WHERE s > threshold), ga AS (SELECT station, variable, count(*) AS m, avg(z) AS mean, max(z) AS top FROM ge GROUP BY ALL),
g0 AS (SELECT station, variable, m, mean, unnest([{', '.join(GRID_POINTS)}]) AS theta, unnest(range({2 * L.SIDE + 1})) AS k FROM ga)"""
    for r in range(L.ROUNDS + 1):
        out += f""",
p{r} AS (SELECT station, variable, k, theta, any_value(m) AS m, any_value(mean) AS mean, sum(ln(1 + theta * z)) / any_value(m) AS shape FROM g{r} JOIN ge USING (station, variable) GROUP BY ALL),
q{r} AS (SELECT *, CASE WHEN abs(theta) < 1e-12 THEN -m * (ln(mean) + 1) WHEN shape / theta > 0 THEN -m * (ln(shape / theta) + shape + 1) END AS fit FROM p{r}),
n{r} AS (SELECT *, coalesce(lag(theta) OVER w, theta) AS a, coalesce(lead(theta) OVER w, theta) AS b FROM q{r} WINDOW w AS (PARTITION BY station, variable ORDER BY k)),
b{r} AS (SELECT * FROM n{r} QUALIFY row_number() OVER (PARTITION BY station, variable ORDER BY fit DESC NULLS LAST, k) = 1)"""
        if r < L.ROUNDS:
            out += f", g{r + 1} AS (SELECT station, variable, m, mean, a + (b - a) * (j / {L.STEPS}.0::DOUBLE) AS theta, j AS k FROM b{r}, (SELECT unnest(range({L.STEPS + 1})) AS j))"
    return out + f", gpd AS (SELECT station, variable, threshold, CASE WHEN abs(theta) < 1e-12 THEN 0 ELSE shape END AS shape, CASE WHEN abs(theta) < 1e-12 THEN mean ELSE shape / theta END AS scale, m / n AS p_exceed, m AS n_exceed FROM b{L.ROUNDS} JOIN gt USING (station, variable))"


TRAIN_SQL = f"ti AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER ({PART}) AS n FROM dm), td AS (SELECT * FROM ti WHERE i < floor(n * 0.6::DOUBLE))"


def _tail_sql(sample: str, score: str = "diff", digits: int = 6, base: str = "dm") -> str:
    x = f"coalesce(d.{score}, 0)"
    inside = f"1 + shape * ({x} - threshold) / scale"
    return f"""un AS (SELECT station, variable, coalesce({score}, 0) AS s, event_id, 0 AS m FROM {base} UNION ALL SELECT station, variable, coalesce({score}, 0), NULL, 1 FROM {sample}),
ra AS (SELECT event_id, 1 - coalesce(sum(m) OVER (PARTITION BY station, variable ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(m) OVER (PARTITION BY station, variable, s), 0) / sum(m) OVER (PARTITION BY station, variable) AS p_rank FROM un)
SELECT d.station, d.variable, d.event_id, round(CASE WHEN {x} > threshold THEN p_exceed * CASE WHEN abs(shape) < 1e-9 THEN exp(-({x} - threshold) / scale) WHEN {inside} <= 0 THEN 0 ELSE ({inside}) ** (-1 / shape) END ELSE p_rank END, {digits}) AS p_gpd
FROM {base} d JOIN ra USING (event_id) LEFT JOIN gpd ON gpd.station = d.station AND gpd.variable = d.variable"""


@query(f"WITH {PRED}, {_fit_sql('dm', 'diff')} SELECT station, variable, round(threshold, 6) AS threshold, round(shape, 4) AS shape, round(scale, 4) AS scale, round(p_exceed, 8) AS p_exceed, n_exceed FROM gpd")
def gpd_fit(spark: SparkSession, sf: str) -> DataFrame:
    fit = L.gpd_fit(predicted(spark, sf), OBS.keys, "diff")
    return fit.withColumns({c: F.round(c, d) for c, d in (("threshold", 6), ("shape", 4), ("scale", 4), ("p_exceed", 8))})


@query(f"WITH {PRED}, {_fit_sql('dm', 'diff')}, {_tail_sql('dm')}")
def gpd_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(L.gpd_pvalues(predicted(spark, sf), OBS.keys, "diff").select(*KEY, "p_gpd"), "p_gpd")


@query(f"WITH {PRED}, {TRAIN_SQL}, {_fit_sql('td', 'diff')}, {_tail_sql('td')}")
def gpd_pvalue_train(spark: SparkSession, sf: str) -> DataFrame:
    """All rows judged by the tail and the ranks of each series' training part."""
    rows = split(predicted(spark, sf), OBS)
    return rounded(L.gpd_pvalues(rows, OBS.keys, "diff", train=F.col("part") == "train").select(*KEY, "p_gpd"), "p_gpd")


def _vector_sql(train: bool) -> str:
    """The vector from the SQL of its parts."""
    sample = "td" if train else "rm"
    base = f"{PRED}, rm AS (SELECT *, coalesce(x - predicted, 0) AS res FROM dm), {TRAIN_SQL.replace('FROM dm', 'FROM rm')}"
    e = f"{base}, {_fit_sql(sample, 'res')}, {_tail_sql(sample, 'res', 15, 'rm')}"
    parts = {"a": SQL["acc_score"], "l": SQL["level_score"], "r": SQL["rate_score"], "w": EWMA_SQL, "c": CUSUM_SQL, "s": SQL["rolling_slope"], "n": SQL["sign_persistence"], "g": f"WITH {e}"}
    joined = " ".join(f"JOIN ({sql}) {name} USING ({KEYS})" for name, sql in parts.items())
    return f"""WITH {base}, sc AS (SELECT station, variable, nullif(median(abs(res)), 0) / 0.7406970841126811 AS scale FROM {sample} GROUP BY ALL),
u AS (SELECT rm.station, rm.variable, rm.event_id, rm.x AS y, coalesce(predicted, rm.x) AS predicted, res AS residual, abs(res) AS abs_residual, (rm.x NOT BETWEEN 0 AND 250)::INT AS outside, res / scale AS t, (obs.x IS NULL)::INT AS missing_mask FROM rm JOIN sc USING (station, variable) JOIN obs USING (event_id))
SELECT {KEYS}, round(y, 6) AS y, round(predicted, 6) AS predicted, round(residual, 6) AS residual, round(abs_residual, 6) AS abs_residual, acc_score, level_score, rate_score AS rate, outside::DOUBLE AS outside,
round(coalesce(-ln(2 * (0.5 - 0.375 * (t / sqrt(1 + t * t / 4)) * (1 - t * t / (12 * (1 + t * t / 4)))) + 1e-12), 0), 4) AS mad_score, round(-ln(p_gpd + 1e-12), 4) AS gpd_score, ewma_0, ewma_1, ewma_2,
cusum_pos, cusum_neg, slope_6, slope_12, slope_24, slope_48, persistence::DOUBLE AS persistence, missing_mask::DOUBLE AS missing_mask FROM u {joined}"""


def vector(spark: SparkSession, sf: str, train: bool = False) -> DataFrame:
    rows = split(predicted(spark, sf), OBS).withColumn("missing", F.col("event_id") % 17 == 0)
    return causal_vector(rows, OBS, "predicted", F.col("missing"), ("event_id",), train=F.col("part") == "train" if train else None)


def _rounded_vector(df: DataFrame) -> DataFrame:
    digits = {"acc_score": 4, "level_score": 5, "mad_score": 4, "gpd_score": 4, "cusum_pos": 5, "cusum_neg": 5} | {f"slope_{w}": 5 for w in K.SLOPE_WINDOWS}
    return df.select(*KEY, *(F.round(c, digits.get(c, 6)).alias(c) for c in VECTOR))


@query(_vector_sql(False))
def causal_features(spark: SparkSession, sf: str) -> DataFrame:
    """The classifier's 21 features in their order, calibrated by the whole segment."""
    return _rounded_vector(vector(spark, sf))


@query(_vector_sql(True))
def causal_features_train(spark: SparkSession, sf: str) -> DataFrame:
    """The same, with tails and scales of the training parts."""
    return _rounded_vector(vector(spark, sf, train=True))


SAME = "station, variable, side"
PEAKS_SQL = f"""WITH RECURSIVE {PRED}, pv AS (SELECT station, variable, event_id, side, row_number() OVER (PARTITION BY {SAME} ORDER BY ts, event_id) - 1 AS i, coalesce(diff, 0) * side AS v FROM dm, (VALUES (1), (-1)) sides(side)),
nw AS (SELECT *, (v IS DISTINCT FROM lag(v) OVER (PARTITION BY {SAME} ORDER BY i))::INT AS new FROM pv), ru AS (SELECT *, sum(new) OVER (PARTITION BY {SAME} ORDER BY i) AS run FROM nw),
rg AS (SELECT {SAME}, run, min(i) AS b, max(i) AS e, min(v) AS v FROM ru GROUP BY ALL), rn AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS n FROM rg WINDOW r AS (PARTITION BY {SAME} ORDER BY run)),
ck AS (SELECT {SAME}, (b + e) // 2 AS i, row_number() OVER (PARTITION BY {SAME} ORDER BY v DESC, b + e DESC) AS k FROM rn WHERE l < v AND n < v AND v >= 1),
st AS (SELECT {SAME}, k, [i] AS stay FROM ck WHERE k = 1 UNION ALL SELECT ck.station, ck.variable, ck.side, ck.k, CASE WHEN len(list_filter(stay, lambda q: abs(q - i) < 50)) > 0 THEN stay ELSE list_append(stay, i) END FROM st JOIN ck ON ck.station = st.station AND ck.variable = st.variable AND ck.side = st.side AND ck.k = st.k + 1),
ls AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY {SAME} ORDER BY k DESC) = 1), fi AS (SELECT {SAME}, unnest(stay) AS i FROM ls), pk AS (SELECT pv.* FROM fi JOIN pv USING ({SAME}, i)),
hg AS (SELECT pk.station, pk.variable, pk.side, pk.event_id, pk.i, pk.v, coalesce(max(q.i) FILTER (q.i < pk.i AND q.v > pk.v), -1) AS a, min(q.i) FILTER (q.i > pk.i AND q.v > pk.v) AS b FROM pk JOIN pv q USING ({SAME}) GROUP BY ALL),
lw AS (SELECT hg.station, hg.variable, hg.side, hg.event_id, hg.v, min(q.v) FILTER (q.i > a AND q.i <= hg.i) AS lo, min(q.v) FILTER (q.i >= hg.i AND (b IS NULL OR q.i < b)) AS ro FROM hg JOIN pv q USING ({SAME}) GROUP BY ALL)
SELECT {KEYS}, round(v * side, 6) AS peak, side FROM lw WHERE v - greatest(lo, ro) >= 1"""


@query(PEAKS_SQL)
def lstm_peak(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(peaks(predicted(spark, sf), OBS, "diff").select(*KEY, "peak", "side"), "peak")


@query()
def iso_forest(spark: SparkSession, sf: str) -> DataFrame:
    return D.isolation_scores(predicted(spark, sf).withColumn("diff", F.coalesce("diff", F.lit(0.0))), ["x", "e", "diff"], list(KEY))


@query()
def forest_decision(spark: SparkSession, sf: str) -> DataFrame:
    """A forest of the training parts; a row is flagged where it is more isolated than all but 1 in 130 of theirs."""
    rows = split(predicted(spark, sf), OBS).withColumns({"diff": F.coalesce("diff", F.lit(0.0)), "fit": F.col("part") == "train"})
    scored = D.isolation_scores(rows, ["x", "e", "diff"], [*KEY, "fit"], train="fit")
    return D.isolation_flags(scored, F.col("fit")).select(*KEY, "fit", "isolation", "flagged")


@query()
def ar_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rows = split(filled(spark, sf), OBS)
    return M.lag_forecast(rows, OBS, "x", F.col("part") == "train").select(*KEY, "part", "x", "predicted")


@query()
def pca_recon(spark: SparkSession, sf: str) -> DataFrame:
    rows = split(filled(spark, sf), OBS)
    return M.component_residual(rows, OBS, "x", F.col("part") == "train").select(*KEY, "part", "residual")


def _unit(*of: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(of)})), 1, 12))::BIGINT / {1 << 48}.0::DOUBLE)"


def _pick(values: tuple, u: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[(floor({u} * {len(values)}) + 1)::INT]"


KEY_TEXT = ("station::VARCHAR", "variable")


@query(f"""WITH {FILLED}, n AS (SELECT v.*, row_number() OVER ({W}) - 1 AS i, count(*) OVER ({PART}) AS n, stddev_pop(x) OVER ({PART}) AS sd, {_unit("'p0'", *KEY_TEXT, 'event_id::VARCHAR')} AS u0, {_unit("'q0'", *KEY_TEXT, 'event_id::VARCHAR')} AS q FROM v),
r AS (SELECT *, CASE WHEN i >= 10 AND i < n - 10 THEN u0 END AS u FROM n), h AS (SELECT *, row_number() OVER ({PART} ORDER BY u ASC NULLS LAST, ts, event_id) <= greatest(1, round(n / 130.0)) AND u IS NOT NULL AS hit FROM r)
SELECT {KEYS}, x, round(CASE WHEN hit THEN greatest(0, x + CASE WHEN q < 0.5 THEN -1 ELSE 1 END * (3 + 3 * ((q * 2) % 1)) * sd) ELSE x END, 6) AS y, hit AS is_anomaly FROM h""")
def inject_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.point_anomalies(filled(spark, sf), OBS).select(*KEY, "x", "y", "is_anomaly"), "y")


_draw = lambda tag: _unit(f"'{tag}0'", *KEY_TEXT, "slot::VARCHAR")
EVENTS = f"""{FILLED}, ct AS (SELECT station, variable, count(*) AS n, least(28, count(*)) AS c FROM v GROUP BY ALL), sl AS (SELECT station, variable, n // c AS width, unnest(range(c))::INT AS slot FROM ct),
fa AS (SELECT *, ({list(I.FAMILIES)})[slot % 7 + 1] AS family FROM sl),
du AS (SELECT *, least(CASE WHEN family IN ('A_spike', 'B_mult', 'G_missing_sentinel') THEN 1 WHEN family IN ('C_level_shift', 'D_drift') THEN {_pick(I.LONG, _draw('d'))} ELSE {_pick(I.SHORT, _draw('d'))} END, greatest(width - 1, 1))::BIGINT AS duration FROM fa),
ev AS (SELECT station, variable, slot, family, duration, (slot * width + floor({_draw('s')} * greatest(width - duration, 1)))::BIGINT AS start, {_draw('u')} AS u, {_draw('v')} AS v FROM du)"""


@query(f"WITH {EVENTS} SELECT station, variable, slot, family, duration, start, round(u, 9) AS u, round(v, 9) AS v FROM ev")
def inject_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.events(filled(spark, sf), OBS), "u", "v", digits=9)


SF = "station, variable, f"
RESERVED = f"""{FILLED}, ri AS (SELECT station, variable, row_number() OVER ({W}) - 1 AS i, count(*) OVER ({PART}) AS n FROM v),
rk(f, family, long, most) AS (VALUES {', '.join(f"({k}, '{f}', {I.longest(f)}, {I.candidates_for(4, f, 6)})" for k, f in enumerate(I.FAMILIES))}),
rc AS (SELECT station, variable, f, family, long, i, {_unit("'o0'", *KEY_TEXT, 'family', 'i::VARCHAR')} AS u FROM ri, rk WHERE i >= 6 AND i < n - long - 6),
rr AS (SELECT rc.*, row_number() OVER (PARTITION BY {SF} ORDER BY u, i) AS k FROM rc), rq AS (SELECT rr.* FROM rr JOIN rk USING (f) WHERE k <= most),
rg AS (SELECT {SF}, long, k, [i] AS own FROM rq WHERE k = 1 UNION ALL SELECT rq.station, rq.variable, rq.f, rq.long, rq.k, CASE WHEN len(own) >= 4 OR len(list_filter(own, lambda q: abs(q - i) < rq.long + 12)) > 0 THEN own ELSE list_append(own, i) END FROM rg JOIN rq ON rq.station = rg.station AND rq.variable = rg.variable AND rq.f = rg.f AND rq.k = rg.k + 1),
rl AS (SELECT * FROM rg QUALIFY row_number() OVER (PARTITION BY {SF} ORDER BY k DESC) = 1),
rs AS (SELECT DISTINCT station, variable, -1 AS f, []::BIGINT[] AS free, []::STRUCT(lo BIGINT, hi BIGINT)[] AS kept FROM ri UNION ALL
SELECT station, variable, f + 1, free, list_concat(kept, list_transform(free, lambda q: {{'lo': q - 6, 'hi': q + long + 6}})) FROM (SELECT rs.station, rs.variable, rs.f, rk.long, rs.kept, list_filter(coalesce(rl.own, []), lambda q: len(list_filter(rs.kept, lambda z: q + rk.long + 6 > z.lo AND q - 6 < z.hi)) = 0) AS free
FROM rs JOIN rk ON rk.f = rs.f + 1 LEFT JOIN rl ON rl.station = rs.station AND rl.variable = rs.variable AND rl.f = rs.f + 1)),
re AS (SELECT station, variable, f, unnest(free) AS start FROM rs)"""
_drawn = lambda tag: _unit(f"'{tag}0'", *KEY_TEXT, "family", "start::VARCHAR")


@query(f"""WITH RECURSIVE {RESERVED} SELECT station, variable, family, start, (row_number() OVER (PARTITION BY station, variable ORDER BY start) - 1)::INT AS slot,
(CASE WHEN long = 1 THEN 1 WHEN long = {max(I.LONG)} THEN {_pick(I.LONG, _drawn('d'))} ELSE {_pick(I.SHORT, _drawn('d'))} END)::BIGINT AS duration, round({_drawn('u')}, 9) AS u, round({_drawn('v')}, 9) AS v FROM re JOIN rk USING (f)""")
def inject_reserved(spark: SparkSession, sf: str) -> DataFrame:
    """Events at drawn places with gaps; each family keeps clear of those before it."""
    return rounded(I.reserved_events(filled(spark, sf), OBS), "u", "v", digits=9)


def families(spark: SparkSession, sf: str) -> DataFrame:
    v = filled(spark, sf)
    return I.injected(v, OBS, I.events(v, OBS))


_own = lambda tag: _unit(f"'{tag}'", *KEY_TEXT, "slot::VARCHAR", "j::VARCHAR")


@query(f"""WITH {EVENTS}, ri AS (SELECT v.*, row_number() OVER ({W}) - 1 AS i, stddev_pop(x) OVER ({PART}) AS sd FROM v),
jo AS (SELECT ri.*, slot, family, duration, u, ev.v, i - start AS j FROM ri LEFT JOIN ev ON ri.station = ev.station AND ri.variable = ev.variable AND i >= start AND i < start + duration),
sv AS (SELECT *, CASE WHEN v < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign, CASE WHEN u < 0.5 THEN 1.0 + 1.5 * ((u * 2) % 1) ELSE 3.0 + ((u * 2) % 1) END AS severity, {_pick(I.SPIKES, 'u')}::DOUBLE AS spike, {_pick(I.FACTORS, 'u')}::DOUBLE AS factor, 0.5 + 2.0 * u AS noise,
last_value(CASE WHEN j = 0 THEN x END IGNORE NULLS) OVER {frame('24 PRECEDING', 'CURRENT ROW')} AS held FROM jo), dr AS (SELECT *, sign * severity * sd / greatest(1, duration - 1) * j AS drift FROM sv)
SELECT {KEYS}, x, round(CASE family WHEN 'A_spike' THEN greatest(0, x + sign * spike * sd) WHEN 'B_mult' THEN x * factor WHEN 'C_level_shift' THEN greatest(0, x + sign * severity * sd) WHEN 'D_drift' THEN greatest(0, x + drift) WHEN 'E_stuck' THEN held
WHEN 'F_burst_noise' THEN greatest(0, x + noise * sd * sqrt(-2 * ln(1 - {_own('f')})) * cos(6.283185307179586 * {_own('g')})) WHEN 'G_missing_sentinel' THEN CASE WHEN u < 1 / 3.0::DOUBLE THEN NULL WHEN u < 2 / 3.0::DOUBLE THEN -999.0 ELSE -0.1 - 0.9 * v END ELSE x END, 5) AS y,
CASE WHEN family IS NULL THEN -1 WHEN CASE family WHEN 'A_spike' THEN spike >= 3 WHEN 'C_level_shift' THEN severity >= 3 WHEN 'D_drift' THEN abs(drift) >= 3 * sd WHEN 'F_burst_noise' THEN noise >= 1.5 ELSE true END THEN 2 ELSE 1 END AS class_int, coalesce(family, '') AS family FROM dr""")
def inject_families(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(families(spark, sf).select(*KEY, "x", "y", "class_int", "family"), "y", digits=5)


@query(f"WITH {OBS_SQL} SELECT {KEYS}, CASE WHEN event_id % 41 = 0 THEN 2 WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS label FROM obs")
def transfer_label(spark: SparkSession, sf: str) -> DataFrame:
    touched = F.when(F.col("event_id") % 41 == 0, 2).when(F.col("event_id") % 37 == 0, 1).otherwise(-1)
    return obs(spark, sf).select(*KEY, I.transfer_labels(touched).alias("label"))


TOUCHED = "CASE WHEN event_id % 41 = 0 THEN 2 WHEN event_id % 37 = 0 THEN 1 ELSE -1 END"


@query(f"""WITH {T_SQL}, g AS (SELECT tp.*, {TOUCHED} AS ci, max((o.x IS NULL)::INT) OVER (PARTITION BY tp.station, tp.variable ORDER BY tp.ts, tp.event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) > 0 AS gap, abs(tp.x - (lag(tp.x) OVER k + lead(tp.x) OVER k) / 2) AS spike FROM tp JOIN obs o USING (station, variable, ts, event_id) WINDOW k AS (PARTITION BY tp.station, tp.variable ORDER BY tp.ts, tp.event_id)),
q AS (SELECT station, variable, quantile_cont(spike, 0.75) AS q75, quantile_cont(spike, 0.9) AS q90 FROM g GROUP BY ALL), l AS (SELECT g.*, q75, q90, coalesce(ci = -1 AND x BETWEEN 0 AND 250 AND spike < q75 AND p > 0.10 AND NOT gap, false) AS good FROM g JOIN q USING (station, variable))
SELECT {KEYS}, CASE WHEN ci <> -1 THEN ci WHEN NOT good AND (coalesce(p < 0.05, false) OR coalesce(spike > q90, false) OR gap) THEN 1 ELSE 0 END AS label, CASE WHEN ci = 2 THEN 1.0::DOUBLE WHEN ci = 1 THEN 0.5::DOUBLE WHEN good THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM l""")
def weak_label_v1(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.robust_t(predicted(spark, sf), OBS.keys, "diff").withColumn("spike", classic_spike(OBS))
    raw = obs(spark, sf).select(*KEY, F.col("x").alias("raw"), "ts")
    rows = rows.join(raw.drop("ts"), list(KEY)).withColumn("gap", K.near_gap(OBS, F.col("raw").isNull().cast("int")))
    rows = with_quantiles(stored(rows, "spikes"), OBS.keys, {"q75": ("spike", 0.75), "q90": ("spike", 0.9)})
    touched = F.when(F.col("event_id") % 41 == 0, 2).when(F.col("event_id") % 37 == 0, 1).otherwise(-1)
    label, confidence = I.weak_labels_v1(touched, F.col("x").between(0, 250), F.col("spike"), F.col("q75"), F.col("q90"), F.col("p_robust"), F.col("gap"))
    return rows.select(*KEY, label.alias("label"), confidence.alias("confidence"))


@query(f"""WITH {OBS_SQL}, s AS (SELECT station, variable, avg(x) AS m, stddev_pop(x) AS sd FROM obs GROUP BY ALL), g AS (SELECT obs.station, obs.variable, event_id, x, {TOUCHED} AS ci, abs((coalesce(x, m) - m) / (sd + 1e-6)) AS z, max((x IS NULL)::INT) OVER {frame('1 PRECEDING', '1 FOLLOWING').replace('BY station, variable', 'BY obs.station, obs.variable')} > 0 AS gap FROM obs JOIN s USING (station, variable)),
l AS (SELECT *, coalesce(ci = -1 AND x BETWEEN 0 AND 250 AND z < 1.5 AND NOT gap, false) AS good FROM g) SELECT {KEYS}, CASE WHEN ci <> -1 THEN ci WHEN NOT good AND (z >= 1.5 OR gap) THEN 1 ELSE 0 END AS label, CASE WHEN ci <> -1 OR good THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM l""")
def weak_label_v2(spark: SparkSession, sf: str) -> DataFrame:
    rows = over_key(obs(spark, sf), OBS.keys, m=F.avg("x"), sd=F.stddev_pop("x")).withColumn("gap", K.near_gap(OBS, F.col("x").isNull().cast("int")))
    z = F.abs((F.coalesce(F.col("x"), F.col("m")) - F.col("m")) / (F.col("sd") + 1e-6))
    touched = F.when(F.col("event_id") % 41 == 0, 2).when(F.col("event_id") % 37 == 0, 1).otherwise(-1)
    label, confidence = I.weak_labels_v2(touched, F.col("x").between(0, 250), z, F.col("gap"))
    return rows.select(*KEY, label.alias("label"), confidence.alias("confidence"))


@query(f"WITH {OBS_SQL}, s AS (SELECT variable, min(x) AS lo, max(x) AS hi FROM obs GROUP BY 1) SELECT {KEYS}, round(least(greatest((x - lo) / nullif(hi - lo, 0), 0), 1), 8) AS scaled FROM obs JOIN s USING (variable) WHERE x IS NOT NULL")
def minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_statistics(obs(spark, sf).filter("x is not null"), ("variable",), lo=F.min("x"), hi=F.max("x"))
    scaled = (F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return rows.select(*KEY, F.round(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)), 8).alias("scaled"))


@query(f"WITH {OBS_SQL}, k AS (SELECT station, variable FROM obs GROUP BY ALL HAVING count(x) > 300) SELECT station, variable, count(x) AS n_valid FROM obs SEMI JOIN k USING (station, variable) GROUP BY ALL")
def having_min_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf)
    long = o.groupBy("station", "variable").agg(F.count("x").alias("n")).filter("n > 300")
    return o.join(long, ["station", "variable"], "left_semi").groupBy("station", "variable").agg(F.count("x").alias("n_valid"))


@query("SELECT event_id, try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', 2020 + event_id % 5, 1 + event_id % 13, 1 + event_id % 31, event_id % 25, event_id % 60, event_id % 60) AS TIMESTAMP) AS ts FROM events")
def ts_from_parts(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    parts = [2020 + i % 5, 1 + i % 13, 1 + i % 31, i % 25, i % 60, i % 60]
    return table(spark, sf, "events").select("event_id", timestamp([p.cast("string") for p in parts]).cast("timestamp_ntz").alias("ts"))


@query("SELECT event_id, date_trunc('second', ts) AS ts, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS x FROM events WHERE event_id % 23 <> 0")
def scan_ocean(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as observation files (comments, missing tokens, bad times) and read back."""
    path = f"{scratch(spark)}/ocean-{uuid.uuid4().hex}"
    ts, i = F.col("ts").cast("timestamp"), F.col("event_id")
    parts = dict(zip(TIME_PARTS, (F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts)), strict=True))
    parts["MONTH"] = F.when(i % 23 == 0, 13).otherwise(parts["MONTH"])
    value = F.when(i % 17 == 0, F.element_at(F.array(*map(F.lit, ("NULL", "NaN", "null", "n/a"))), (F.pmod(i, F.lit(4)) + 1).cast("int"))).otherwise(F.col("value").cast("string"))
    line = F.concat_ws(",", *(parts[c].cast("string") for c in TIME_PARTS), i.cast("string"), value)
    table(spark, sf, "events").select(F.when(i % 50 == 0, F.concat(F.lit("/ note\n"), line)).otherwise(line).alias("value")).write.text(path)
    gone_at_exit(spark, path)
    read = read_observations(spark, path, ["event_id", "x"], header=False)
    return read.select(F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "x")


@query("WITH a AS (SELECT user_id, date_trunc('second', min(ts)) AS t0, list(round(value, 3) ORDER BY event_id) AS v FROM events GROUP BY user_id, ts::DATE) SELECT user_id, t0 + INTERVAL 1 HOUR * (k - 1) AS ts, v[k] AS speed FROM (SELECT *, unnest(range(1, len(v) + 1)) AS k FROM a)")
def json_arrays_explode(spark: SparkSession, sf: str) -> DataFrame:
    """All events of a user and day as one payload, parsed again."""
    e = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.date_trunc("second", F.min("ts")).alias("t0"), F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda s: F.round(s["value"], 3)).alias("v"))
    time = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda k: F.date_format(F.timestamp_add("HOUR", k, F.col("t0").cast("timestamp")), "yyyy-MM-dd HH:mm:ss"))
    rows = e.select("user_id", F.to_json(F.struct(F.struct(time.alias("time"), F.col("v").alias("speed")).alias("hourly"))).alias("payload"))
    return hourly_payload(rows, "payload", ["speed"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"WITH {OBS_SQL} SELECT variable, 'high' AS kind, count(*) AS n FROM obs WHERE x > 100 GROUP BY 1 UNION ALL SELECT variable, 'low' AS kind, count(*) AS n FROM obs WHERE x <= 1 GROUP BY 1")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf)
    part = lambda cond, kind: o.filter(cond).groupBy("variable").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return part("x > 100", "high").unionByName(part("x <= 1", "low"))


@query(f"WITH {OBS_SQL} SELECT {KEYS}, x FROM obs WHERE x IS NOT NULL ORDER BY md5(event_id || '|42'), event_id LIMIT 1500")
def det_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The scatter sample: 1,500 rows, the least by a seeded hash."""
    o = obs(spark, sf).filter("x is not null")
    return o.withColumn("h", F.md5(F.concat(F.col("event_id").cast("string"), F.lit("|42")).cast("binary"))).orderBy("h", "event_id").limit(1500).select(*KEY, "x")


@query(f"WITH {OBS_SQL} SELECT DISTINCT station, variable FROM obs EXCEPT SELECT DISTINCT station, variable FROM obs WHERE x > 400")
def set_difference(spark: SparkSession, sf: str) -> DataFrame:
    o = obs(spark, sf)
    return o.select("station", "variable").subtract(o.filter("x > 400").select("station", "variable"))


@query(f"WITH {OBS_SQL}, i AS (SELECT *, row_number() OVER ({W}) - 1 AS i, count(*) OVER ({PART}) AS n FROM obs) SELECT {KEYS}, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM i")
def chrono_split_70(spark: SparkSession, sf: str) -> DataFrame:
    return split(obs(spark, sf), OBS, 0.7, 0.0).select(*KEY, "part")


@query(f"""WITH {OBS_SQL}, s AS (SELECT {KEYS}, x, list(x) OVER {frame('13 PRECEDING', '2 PRECEDING')} AS a, lag(x) OVER ({W}) AS before, lead(x) OVER ({W}) AS after FROM obs WHERE x IS NOT NULL)
SELECT {KEYS}, a[12] AS newest, before, x AS target, after, round(a[12] + 2 * (a[12] - a[11]), 6) AS predicted FROM s WHERE len(a) = 12 AND before IS NOT NULL AND after IS NOT NULL""")
def three_step_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that end two rows before; three steps along their last slope, averaged for the middle row."""
    out = three_step_sequences(obs(spark, sf).filter("x is not null"), OBS, 12)
    last, step = F.col("history")[11], F.col("history")[11] - F.col("history")[10]
    mean = mean_of_steps(*(last + k * step for k in (1, 2, 3)))
    t = F.col("targets")
    return out.select(*KEY, last.alias("newest"), t[0].alias("before"), t[1].alias("target"), t[2].alias("after"), F.round(mean, 6).alias("predicted"))


TRAINED = f"tr AS (SELECT *, row_number() OVER ({W}) - 1 < floor(count(*) OVER ({PART}) * 0.6::DOUBLE) AS train FROM v)"


@query(f"WITH {FILLED}, {TRAINED}, m AS (SELECT *, avg(x) FILTER (train) OVER ({PART}) AS mu, stddev_pop(x) FILTER (train) OVER ({PART}) AS sd FROM tr) SELECT {KEYS}, round((x - mu) / coalesce(nullif(sd, 0), 1), 6) AS z FROM m")
def frozen_z(spark: SparkSession, sf: str) -> DataFrame:
    """z of every row by the moments of its series' training part."""
    rows = split(filled(spark, sf), OBS).withColumn("z", F.col("x"))
    return rounded(M.standard_scaled(rows, ["z"], F.col("part") == "train", OBS.keys).select(*KEY, "z"), "z")


@query(f"WITH {FILLED}, {TRAINED}, q AS (SELECT quantile_cont(x, [0.005, 0.25, 0.5, 0.75, 0.995]) AS q FROM tr WHERE train) SELECT {KEYS}, round((greatest(least(x, q[5]), q[1]) - q[3]) / coalesce(nullif(q[4] - q[2], 0), 1), 6) AS scaled FROM tr, q")
def robust_scaling(spark: SparkSession, sf: str) -> DataFrame:
    """Values cut to outer percentiles, less the median, over the quartile range, all of the training parts."""
    rows = split(filled(spark, sf), OBS).withColumn("scaled", F.col("x"))
    return rounded(M.robust_scaled(rows, ["scaled"], F.col("part") == "train").select(*KEY, "scaled"), "scaled")


@query(f"""WITH {FILLED}, {TRAINED}, rs AS (SELECT *, x - lag(x) OVER ({W}) AS r FROM tr), ab AS (SELECT *, abs(coalesce(r, 0)) AS a, abs(x - (lag(x) OVER ({W}) + lead(x) OVER ({W})) / 2) AS spike FROM rs),
sc AS (SELECT *, nullif(median(a) FILTER (train) OVER ({PART}), 0) / 0.7406970841126811 AS k FROM ab), tt AS (SELECT *, a / k AS t FROM sc)
SELECT {KEYS}, round(coalesce(spike, 0), 6) AS spike, round(coalesce(abs(r), 0), 6) AS rate, (NOT x BETWEEN 0 AND 250)::INT AS outside, round(-ln(greatest(2 * (0.5 - 0.375 * (t / sqrt(1 + t * t / 4)) * (1 - t * t / (12 * (1 + t * t / 4)))), 0) + 1e-12), 4) AS mad_score FROM tt""")
def stat_vector(spark: SparkSession, sf: str) -> DataFrame:
    """The first classifier's statistics, its tail by the training part's scale; the Pareto score is in causal_features."""
    rows = split(filled(spark, sf), OBS).withColumn("residual", F.col("x") - F.lag("x").over(OBS.window))
    out = D.stat_vector(rows, OBS, "residual", F.col("part") == "train")
    return out.select(*KEY, F.round("spike", 6).alias("spike"), F.round("rate", 6).alias("rate"), "outside", F.round("mad_score", 4).alias("mad_score"))


@query(f"WITH {FILLED}, f AS (SELECT *, abs(x - (lag(x) OVER ({W}) + lead(x) OVER ({W})) / 2) AS s, abs(x - lag(x) OVER ({W})) AS p FROM v) SELECT {KEYS}, x AS y, round(coalesce(s, 0), 6) AS spike, round(coalesce(p, 0), 6) AS persistence_residual, (NOT x BETWEEN 0 AND 250)::INT AS outside FROM f")
def features_without_forecaster(spark: SparkSession, sf: str) -> DataFrame:
    """Feature set F."""
    rows = filled(spark, sf).withColumn("y", F.col("x")).withColumns({"spike": F.coalesce(classic_spike(OBS), F.lit(0.0)), "persistence_residual": K.rate(OBS), "outside": (~F.col("x").between(0, 250)).cast("int")})
    return rounded(rows.select(*KEY, *D.feature_set("F", covariates=())), "spike", "persistence_residual")


@query(f"WITH {OBS_SQL} SELECT variable, event_id, x FROM obs WHERE variable IN ('click', 'view')")
def load_variables(spark: SparkSession, sf: str) -> DataFrame:
    """One file a variable, of which one isn't there."""
    path = f"{scratch(spark)}/variables-{uuid.uuid4().hex}"
    o = obs(spark, sf)
    for v in ("click", "view"):
        o.filter(F.col("variable") == v).select("event_id", "x").write.option("header", True).option("nullValue", "NULL").csv(f"{path}/{v}")
    gone_at_exit(spark, path)
    return load_each(spark, {v: f"{path}/{v}" for v in ("click", "missing", "view")}, "event_id long, x double")


@query(f"WITH {OBS_SQL} SELECT event_id, ts, station, variable, x FROM obs")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Observations through the CSV sink, with its header and its word for missing values, and back."""
    path = f"{scratch(spark)}/sink-{uuid.uuid4().hex}"
    rows = obs(spark, sf).select("event_id", "ts", "station", "variable", "x")
    write_csv(rows, path)
    return read_csv(spark, gone_at_exit(spark, path), rows.schema)
