"""Queries of the classical branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maregraph.functions.scalar import bad_share_text, gap_share_text, season
from maregraph.operators import classical as C
from maregraph.operators.quantiles import exact_quantiles
from maregraph.operators.series import dedup_time, with_statistics
from maregraph.plans.registry import KEY, KEYS, OBS, OBS_SQL, PART, W, frame, obs, query, rounded, table

S1 = f"""s1 AS (SELECT *, abs(x - (lag(x) OVER w + lead(x) OVER w) / 2) AS classic, abs(lead(x) OVER w - 2 * x + lag(x) OVER w) AS second,
  abs(x - lag(x) OVER w) AS dx, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3.6e9 AS dt FROM obs WINDOW w AS ({W}))"""
SCORES = f"""{OBS_SQL}, {S1},
d AS (SELECT station, variable, CASE WHEN median(dt) > 0 THEN median(dt) ELSE 0.5 END AS step FROM s1 GROUP BY ALL),
s2 AS (SELECT s1.*, dx / step AS roc, CASE WHEN count(classic) OVER c >= 12 THEN median(classic) OVER c END AS med,
  CASE WHEN count(classic) OVER c >= 12 THEN avg(classic) OVER c END AS mean49, CASE WHEN count(classic) OVER c >= 12 THEN stddev_samp(classic) OVER c END AS std49
  FROM s1 JOIN d USING (station, variable) WINDOW c AS {frame("24 PRECEDING", "24 FOLLOWING")}),
s3 AS (SELECT *, abs(classic - med) AS dev FROM s2),
s4 AS (SELECT *, CASE WHEN count(dev) OVER c >= 12 THEN median(dev) OVER c END AS mad FROM s3 WINDOW c AS {frame("24 PRECEDING", "24 FOLLOWING")}),
sc AS (SELECT *, classic / nullif(1.4826 * mad, 0) AS mad_score, abs(classic - mean49) / nullif(std49, 0) AS local_std FROM s4)"""
FLAGS = f"""{SCORES},
t AS (SELECT station, variable, quantile_cont(classic, 0.995) AS p995, quantile_cont(second, 0.995) AS s995, quantile_cont(roc, 0.995) AS rl, quantile_cont(x, 0.001) AS lo, quantile_cont(x, 0.999) AS hi FROM sc GROUP BY ALL),
f1 AS (SELECT sc.*, p995, s995, rl, lo, hi, coalesce(classic > p995, false) AS f_classic, coalesce(mad_score > 6, false) AS f_mad, coalesce(second > s995, false) AS f_second, coalesce(mad_score > 8, false) AS f_qartod,
  coalesce(roc > rl, false) AS f_roc, coalesce(local_std > 4, false) AS f_local, coalesce(x < lo OR x > hi, false) AS f_range,
  greatest(classic / nullif(p995, 0), mad_score / 8, second / nullif(s995, 0), roc / nullif(rl, 0), local_std / 4) AS parts FROM sc JOIN t USING (station, variable)),
f2 AS (SELECT *, f_classic::BIGINT + f_mad::BIGINT + f_second::BIGINT + f_qartod::BIGINT + f_roc::BIGINT + f_local::BIGINT + f_range::BIGINT AS flag_count, CASE WHEN parts IS NULL THEN NULL WHEN parts < 0 THEN 0 ELSE parts END AS comp FROM f1),
top AS (SELECT station, variable, coalesce(nullif(quantile_cont(comp, 0.999), 0), 1) AS top FROM f2 GROUP BY ALL),
f AS (SELECT f2.*, f_range OR flag_count >= 3 AS removed, flag_count >= 1 AS suspect, CASE WHEN comp IS NULL THEN NULL ELSE least(greatest(100 * (1 - comp / top), 0), 100) END AS qi FROM f2 JOIN top USING (station, variable)),
fq AS (SELECT *, CASE WHEN qi <= 50 THEN 'Bad' WHEN qi <= 75 THEN 'Suspect' WHEN qi <= 90 THEN 'Good' WHEN qi IS NOT NULL THEN 'Excellent' END AS qc FROM f)"""
Z = f"""zs AS (SELECT station, variable, avg(x) AS mu, stddev_samp(x) AS sigma, min(x) AS lo_x, max(x) AS hi_x FROM obs GROUP BY ALL),
z AS (SELECT obs.*, mu, sigma, (x - mu) / nullif(sigma, 0) AS z FROM obs JOIN zs USING (station, variable) WHERE x IS NOT NULL),
zf AS (SELECT *, CASE WHEN abs(z) <= 3 THEN 'GOOD' WHEN abs(z) <= 4 THEN 'SUSPECT' WHEN abs(z) > 4 THEN 'BAD' ELSE 'MISSING' END AS dixon_flag FROM z)"""
Q = f"""qa AS (SELECT *, list(x) OVER {frame("5 PRECEDING", "5 FOLLOWING")} AS a FROM obs WHERE x IS NOT NULL),
qb AS (SELECT *, list_sort(a) AS o, a[len(a) // 2 + 1] AS c FROM qa),
q AS (SELECT * EXCLUDE (a, o, c), CASE WHEN len(a) < 5 THEN NULL WHEN o[1] = o[-1] THEN 0 WHEN c = o[-1] THEN (o[-1] - o[-2]) / (o[-1] - o[1]) WHEN c = o[1] THEN (o[2] - o[1]) / (o[-1] - o[1]) ELSE 0 END AS q FROM qb),
qf AS (SELECT *, CASE WHEN q < 0.412 THEN 'GOOD' WHEN q <= 0.517 THEN 'SUSPECT' WHEN q > 0.517 THEN 'BAD' ELSE 'MISSING' END AS q_dixon_flag FROM q)"""
FULL = f"""{FLAGS}, {Z}, {Q},
j AS (SELECT fq.*, coalesce(zf.dixon_flag, 'MISSING') AS dixon_flag, coalesce(qf.q_dixon_flag, 'MISSING') AS q_dixon_flag FROM fq LEFT JOIN zf USING (station, variable, ts, event_id) LEFT JOIN qf USING (station, variable, ts, event_id)),
dec AS (SELECT *, CASE WHEN x IS NULL OR f_range OR coalesce(qc = 'Bad', false) OR dixon_flag = 'BAD' OR q_dixon_flag = 'BAD' OR removed THEN 'remove'
  WHEN f_classic OR f_mad OR f_second OR f_qartod OR f_roc OR f_local OR dixon_flag = 'SUSPECT' OR q_dixon_flag = 'SUSPECT' OR coalesce(qi < 75, false) THEN 'review' ELSE 'use' END AS decision FROM j)"""
TEST_FLAGS = [f"flag_{t}" for t in C.TESTS]


def flags(spark: SparkSession, sf: str) -> DataFrame:
    return C.tested(obs(spark, sf), OBS)


@query(f"WITH {OBS_SQL}, {S1} SELECT {KEYS}, round(classic, 6) AS classic_score FROM s1")
def classic_spike(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(obs(spark, sf).select(*KEY, C.classic_spike(OBS).alias("classic_score")), "classic_score")


@query(f"WITH {OBS_SQL}, {S1} SELECT {KEYS}, round(second, 6) AS score FROM s1")
def second_difference(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(obs(spark, sf).select(*KEY, C.second_difference(OBS).alias("score")), "score")


@query(f"WITH {SCORES} SELECT {KEYS}, round(mad_score, 6) AS mad_score FROM sc")
def mad_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.scores(obs(spark, sf), OBS).select(*KEY, "mad_score"), "mad_score")


@query(f"WITH {FLAGS} SELECT {KEYS}, round(roc, 4) AS roc_per_hour, f_roc AS flag_roc FROM fq")
def roc_test(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(flags(spark, sf).select(*KEY, "roc_per_hour", "flag_roc"), "roc_per_hour", digits=4)


@query(f"WITH {SCORES} SELECT {KEYS}, round(local_std, 5) AS local_std_score FROM sc")
def local_std_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.scores(obs(spark, sf), OBS).select(*KEY, "local_std_score"), "local_std_score", digits=5)


@query(f"WITH {FLAGS} SELECT {KEYS}, f_range AS flag_range, round(lo, 6) AS range_min, round(hi, 6) AS range_max FROM fq")
def range_test(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(flags(spark, sf).select(*KEY, "flag_range", "range_min", "range_max"), "range_min", "range_max")


@query(f"WITH {FLAGS} SELECT {KEYS}, f_classic AS flag_classic, f_mad AS flag_mad, f_second AS flag_second_difference, f_qartod AS flag_qartod, f_roc AS flag_roc, f_local AS flag_local_std, f_range AS flag_range, flag_count, removed, suspect FROM fq")
def qc_flags(spark: SparkSession, sf: str) -> DataFrame:
    return flags(spark, sf).select(*KEY, *TEST_FLAGS, "flag_count", "removed", "suspect")


@query(f"WITH {FLAGS} SELECT {KEYS}, round(qi, 4) AS quality_index, qc AS quality_class FROM fq")
def quality_index(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(flags(spark, sf).select(*KEY, "quality_index", "quality_class"), "quality_index", digits=4)


@query(f"WITH {OBS_SQL}, {S1}, m AS (SELECT station, variable, month(ts) AS month, quantile_cont(classic, 0.99) AS l FROM s1 GROUP BY ALL) SELECT {KEYS}, round(l, 6) AS month_limit FROM s1 JOIN m ON s1.station = m.station AND s1.variable = m.variable AND month(s1.ts) = m.month".replace("SELECT station, variable, event_id, round(l", "SELECT s1.station, s1.variable, event_id, round(l"))
def p99_month(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.month_quantile(obs(spark, sf), OBS).select(*KEY, "month_limit"), "month_limit")


@query(f"WITH {OBS_SQL}, {Z} SELECT {KEYS}, round(z, 6) AS z, dixon_flag FROM zf")
def dixon_flags(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.global_z(obs(spark, sf), OBS).select(*KEY, "z", "dixon_flag"), "z")


def _counts(flag: str) -> list:
    return [F.count_if(F.col(flag) == k).alias(f"n_{k.lower()}") for k in ("GOOD", "SUSPECT", "BAD")]


@query(f"""WITH {OBS_SQL}, {Z}, g AS (SELECT station, variable, count(*) AS n, avg(x) AS mu, stddev_samp(x) AS sigma, min(x) AS lo, max(x) AS hi, count(*) FILTER (dixon_flag = 'GOOD') AS n_good, count(*) FILTER (dixon_flag = 'SUSPECT') AS n_suspect, count(*) FILTER (dixon_flag = 'BAD') AS n_bad FROM zf GROUP BY ALL)
SELECT station, variable, n, round(mu, 6) AS mu, round(sigma, 6) AS sigma, lo, hi, round(mu - 4 * sigma, 6) AS limit_low, round(mu + 4 * sigma, 6) AS limit_high, n_good, n_suspect, n_bad, round(100.0 * n_bad / n, 6) AS bad_pct,
CASE WHEN 100.0 * n_bad / n < 0.1 THEN 'very low' WHEN 100.0 * n_bad / n < 1 THEN 'low' WHEN 100.0 * n_bad / n < 5 THEN 'moderate' ELSE 'high' END AS reading FROM g""")
def dixon_summary(spark: SparkSession, sf: str) -> DataFrame:
    z = C.global_z(obs(spark, sf), OBS)
    out = z.groupBy("station", "variable").agg(F.count("*").alias("n"), F.avg("x").alias("mu"), F.stddev_samp("x").alias("sigma"), F.min("x").alias("lo"), F.max("x").alias("hi"), *_counts("dixon_flag"))
    out = out.withColumns({"limit_low": F.col("mu") - 4 * F.col("sigma"), "limit_high": F.col("mu") + 4 * F.col("sigma"), "bad_pct": 100.0 * F.col("n_bad") / F.col("n")})
    return rounded(out.withColumn("reading", bad_share_text(F.col("bad_pct"))), "mu", "sigma", "limit_low", "limit_high", "bad_pct")


@query(f"WITH {OBS_SQL}, {Q} SELECT {KEYS}, round(q, 6) AS q, q_dixon_flag FROM qf")
def qdixon_flags(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.q_dixon(obs(spark, sf), OBS).select(*KEY, "q", "q_dixon_flag"), "q")


@query(f"""WITH {OBS_SQL}, {Q} SELECT station, variable, count(*) AS n, count(*) FILTER (q_dixon_flag = 'GOOD') AS n_good, count(*) FILTER (q_dixon_flag = 'SUSPECT') AS n_suspect, count(*) FILTER (q_dixon_flag = 'BAD') AS n_bad,
min(x) AS lo, max(x) AS hi, round(median(q), 6) AS median_q, round(quantile_cont(q, 0.95), 6) AS p95_q, round(max(q), 6) AS max_q, CASE WHEN 100.0 * count(*) FILTER (q_dixon_flag = 'BAD') / count(*) < 0.1 THEN 'few isolated extremes, excellent' WHEN 100.0 * count(*) FILTER (q_dixon_flag = 'BAD') / count(*) < 1 THEN 'few isolated extremes, good'
WHEN 100.0 * count(*) FILTER (q_dixon_flag = 'BAD') / count(*) < 5 THEN 'look into it locally' ELSE 'instrument, processing or a limit too tight' END AS reading FROM qf GROUP BY ALL""")
def qdixon_summary(spark: SparkSession, sf: str) -> DataFrame:
    q = C.q_dixon(obs(spark, sf), OBS)
    out = q.groupBy("station", "variable").agg(F.count("*").alias("n"), *_counts("q_dixon_flag"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.median("q").alias("median_q"), F.percentile("q", F.lit(0.95)).alias("p95_q"), F.max("q").alias("max_q")).withColumn("reading", gap_share_text(100.0 * F.col("n_bad") / F.col("n")))
    return rounded(out, "median_q", "p95_q", "max_q")


QUANTILES = (0.001, 0.9, 0.95, 0.99, 0.995, 0.999)


@query(f"WITH {OBS_SQL} SELECT variable, " + ", ".join(f"round(quantile_cont(x, {p}), 6) AS p{str(p)[2:]}" for p in QUANTILES) + " FROM obs GROUP BY ALL")
def quantiles(spark: SparkSession, sf: str) -> DataFrame:
    names = {f"p{str(p)[2:]}": ("x", p) for p in QUANTILES}
    return rounded(exact_quantiles(obs(spark, sf), ("variable",), names), *names)


def _events_sql(source: str, flag: str, score: str) -> str:
    return f"""e1 AS (SELECT *, {flag} = 'BAD' AS bad FROM {source}), e2 AS (SELECT *, (bad IS DISTINCT FROM lag(bad) OVER ({W}))::INT AS new FROM e1), e3 AS (SELECT *, sum(new) OVER ({W}) AS run FROM e2)
SELECT station, variable, min(ts) AS start, max(ts) AS "end", count(*) AS n_points, min(x) AS min_value, max(x) AS max_value, round(max(abs({score})), 6) AS max_score, CASE WHEN count(*) >= 2 THEN 'possible_physical_event' ELSE 'possible_instrumental_spike' END AS event_type FROM e3 WHERE bad GROUP BY station, variable, run"""


@query(f"WITH {OBS_SQL}, {Z}, {_events_sql('zf', 'dixon_flag', 'z')}")
def bad_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.bad_events(C.global_z(obs(spark, sf), OBS), OBS, "dixon_flag", "z"), "max_score")


@query(f"WITH {OBS_SQL}, {Q}, {_events_sql('qf', 'q_dixon_flag', 'q')}")
def qdixon_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.bad_events(C.q_dixon(obs(spark, sf), OBS), OBS, "q_dixon_flag", "q"), "max_score")


FLAG_SQL = {"classic": "f_classic", "mad": "f_mad", "second_difference": "f_second", "qartod": "f_qartod", "roc": "f_roc", "local_std": "f_local", "range": "f_range"}


@query(f"WITH {FLAGS} SELECT variable, count(x) AS n, " + ", ".join(f"round(100.0 * count(*) FILTER ({c}) / nullif(count(x), 0), 6) AS pct_{t}" for t, c in FLAG_SQL.items()) + ", round(100.0 * count(*) FILTER (removed) / nullif(count(x), 0), 6) AS pct_removed, round(median(qi) FILTER (x IS NOT NULL), 4) AS median_qi FROM fq GROUP BY variable")
def qc_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count("x")
    share = lambda c: F.round(100.0 * F.count_if(F.col(c)) / F.nullif(n, F.lit(0)), 6)
    return flags(spark, sf).groupBy("variable").agg(n.alias("n"), *(share(f"flag_{t}").alias(f"pct_{t}") for t in C.TESTS), share("removed").alias("pct_removed"), F.round(F.median(F.when(F.col("x").isNotNull(), F.col("quality_index"))), 4).alias("median_qi"))


@query(f"WITH {FLAGS} " + " UNION ALL ".join(f"SELECT '{t}' AS test, count(*) FILTER ({c} AND flag_count = 1) AS n_unique, count(*) FILTER ({c} AND flag_count > 1) AS n_shared, count(*) FILTER ({c}) AS n_total FROM fq" for t, c in FLAG_SQL.items()))
def test_performance(spark: SparkSession, sf: str) -> DataFrame:
    long = flags(spark, sf).select("flag_count", F.explode(F.filter(F.array(*(F.when(F.col(f"flag_{t}"), t) for t in C.TESTS)), lambda t: t.isNotNull())).alias("test"))
    return long.groupBy("test").agg(F.count_if(F.col("flag_count") == 1).alias("n_unique"), F.count_if(F.col("flag_count") > 1).alias("n_shared"), F.count("*").alias("n_total"))


test_performance.__test__ = False


@query(f"WITH {FLAGS} " + " UNION ALL ".join(f"SELECT variable, '{t}' AS test, round(100.0 * count(*) FILTER ({c}) / count(*), 6) AS rate_pct FROM fq GROUP BY variable" for t, c in FLAG_SQL.items()))
def firing_rates(spark: SparkSession, sf: str) -> DataFrame:
    rates = flags(spark, sf).groupBy("variable").agg(*(F.round(100.0 * F.count_if(F.col(f"flag_{t}")) / F.count("*"), 6).alias(t) for t in C.TESTS))
    return rates.unpivot("variable", list(C.TESTS), "test", "rate_pct")


@query(f"WITH {FLAGS} " + " UNION ALL ".join(f"SELECT '{a}' AS given, '{b}' AS test, round(100.0 * count(*) FILTER ({ca} AND {cb}) / nullif(count(*) FILTER ({ca}), 0), 1) AS pct FROM fq" for a, ca in FLAG_SQL.items() for b, cb in FLAG_SQL.items()))
def flag_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    given = lambda a, b: F.round(100.0 * F.count_if(F.col(f"flag_{a}") & F.col(f"flag_{b}")) / F.nullif(F.count_if(F.col(f"flag_{a}")), F.lit(0)), 1)
    row = flags(spark, sf).agg(*(given(a, b).alias(f"{a}|{b}") for a in C.TESTS for b in C.TESTS))
    long = row.unpivot([], row.columns, "pair", "pct")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("given"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("test"), "pct")


@query(f"WITH {FLAGS} SELECT variable, count(*) AS n, count(*) FILTER (NOT f_range) AS after_range, count(*) FILTER (NOT f_classic) AS after_classic, count(*) FILTER (NOT f_mad) AS after_mad, count(*) FILTER (NOT f_roc) AS after_roc, count(*) FILTER (NOT removed) AS after_all FROM fq GROUP BY variable")
def survival_curve(spark: SparkSession, sf: str) -> DataFrame:
    left = lambda c: F.count_if(~F.col(c))
    return flags(spark, sf).groupBy("variable").agg(F.count("*").alias("n"), left("flag_range").alias("after_range"), left("flag_classic").alias("after_classic"), left("flag_mad").alias("after_mad"), left("flag_roc").alias("after_roc"), left("removed").alias("after_all"))


@query(f"WITH {SCORES} SELECT variable, least(floor(round(least(mad_score, 30), 6) / 0.375), 79)::BIGINT AS bin, count(*) AS n FROM sc WHERE mad_score IS NOT NULL GROUP BY ALL")
def mad_histogram(spark: SparkSession, sf: str) -> DataFrame:
    b = F.least(F.floor(F.round(F.least(F.col("mad_score"), F.lit(30.0)), 6) / 0.375), F.lit(79)).cast("long")
    return C.scores(obs(spark, sf), OBS).filter("mad_score is not null").groupBy("variable", b.alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {FULL} SELECT {KEYS}, dixon_flag, q_dixon_flag, decision, CASE decision WHEN 'remove' THEN 'Bad' WHEN 'review' THEN 'Suspect' ELSE coalesce(qc, 'Excellent') END AS final_class FROM dec")
def qc_decision(spark: SparkSession, sf: str) -> DataFrame:
    return C.consolidated(obs(spark, sf), OBS).select(*KEY, "dixon_flag", "q_dixon_flag", "decision", "final_class")


@query(f"WITH {FULL} SELECT variable, count(*) FILTER (decision = 'use') AS \"use\", count(*) FILTER (decision = 'review') AS review, count(*) FILTER (decision = 'remove') AS remove, round(100.0 * count(*) FILTER (decision = 'remove') / count(*), 6) AS remove_pct FROM dec GROUP BY variable")
def decision_pivot(spark: SparkSession, sf: str) -> DataFrame:
    out = C.consolidated(obs(spark, sf), OBS).groupBy("variable").pivot("decision", ["use", "review", "remove"]).agg(F.count(F.lit(1))).fillna(0)
    return out.withColumn("remove_pct", F.round(100.0 * F.col("remove") / (F.col("use") + F.col("review") + F.col("remove")), 6))


@query(f"WITH {FULL} SELECT station, decision, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY station), 6) AS pct FROM dec GROUP BY station, decision")
def class_dist(spark: SparkSession, sf: str) -> DataFrame:
    n = C.consolidated(obs(spark, sf), OBS).groupBy("station", "decision").agg(F.count("*").alias("n"))
    return with_statistics(n, ("station",), t=F.sum("n")).select("station", "decision", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))


@query(f"WITH {OBS_SQL}, {Z}, k AS (SELECT *, row_number() OVER ({PART} ORDER BY z DESC, ts, event_id) AS rank FROM zf) SELECT {KEYS}, round(z, 6) AS z, rank::INT AS rank FROM k WHERE rank <= 10")
def top_positive(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.top_rows(C.global_z(obs(spark, sf), OBS), OBS.keys, "z", OBS.order).select(*KEY, "z", "rank"), "z")


@query(f"WITH {OBS_SQL}, {Z}, k AS (SELECT *, row_number() OVER ({PART} ORDER BY z, ts, event_id) AS rank FROM zf) SELECT {KEYS}, round(z, 6) AS z, rank::INT AS rank FROM k WHERE rank <= 10")
def top_negative(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(C.top_rows(C.global_z(obs(spark, sf), OBS), OBS.keys, "z", OBS.order, largest=False).select(*KEY, "z", "rank"), "z")


@query(f"WITH {OBS_SQL} SELECT {KEYS} FROM (SELECT *, row_number() OVER ({PART}, date_trunc('hour', ts) ORDER BY event_id) AS n FROM (SELECT * REPLACE (date_trunc('hour', ts) AS ts) FROM obs)) WHERE n = 1")
def dedup_ts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_time(obs(spark, sf).withColumn("ts", F.date_trunc("hour", "ts")), OBS).select(*KEY)


ORDER_STATS = "count(*) AS n, round(100.0 * count(*) FILTER (o_totalprice > 300000) / count(*), 6) AS pct_high, round(median(o_totalprice), 4) AS median_price, round(quantile_cont(o_totalprice, 0.95), 4) AS p95_price"


def _rollup(spark: SparkSession, sf: str, by) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy(by).agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(price > 300000) / F.count("*"), 6).alias("pct_high"), F.round(F.median(price), 4).alias("median_price"), F.round(F.percentile(price, F.lit(0.95)), 4).alias("p95_price"))


@query(f"SELECT year(o_orderdate)::INT AS year, {ORDER_STATS} FROM orders GROUP BY 1")
def by_year(spark: SparkSession, sf: str) -> DataFrame:
    return _rollup(spark, sf, F.year("o_orderdate").alias("year"))


@query(f"SELECT month(o_orderdate)::INT AS month, {ORDER_STATS} FROM orders GROUP BY 1")
def by_month(spark: SparkSession, sf: str) -> DataFrame:
    return _rollup(spark, sf, F.month("o_orderdate").alias("month"))


@query(f"SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'verao' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'outono' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'inverno' ELSE 'primavera' END AS season, {ORDER_STATS} FROM orders GROUP BY 1")
def by_season(spark: SparkSession, sf: str) -> DataFrame:
    return _rollup(spark, sf, season(F.col("o_orderdate")).alias("season"))


@query("SELECT year(o_orderdate)::INT AS year, dayofyear(o_orderdate)::INT AS day, count(*) AS n, round(median(o_totalprice), 4) AS median_price, count(*) FILTER (o_totalprice > 300000) AS n_high FROM orders GROUP BY ALL")
def annual_stack(spark: SparkSession, sf: str) -> DataFrame:
    """The years one under another: a row for each year and day of the year."""
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.round(F.median(price), 4).alias("median_price"), F.count_if(price > 300000).alias("n_high"))


@query("SELECT year(o_orderdate)::INT AS year, " + ", ".join(f"round(100.0 * count(*) FILTER (month(o_orderdate) = {m} AND o_totalprice > 300000) / nullif(count(*) FILTER (month(o_orderdate) = {m}), 0), 6) AS m{m}" for m in range(1, 13)) + " FROM orders GROUP BY 1")
def heatmap_month_year(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.concat(F.lit("m"), F.month("o_orderdate")).alias("m"), (F.col("o_totalprice") > 300000).cast("double").alias("hit"))
    return rows.groupBy("year").pivot("m", [f"m{m}" for m in range(1, 13)]).agg(F.round(100.0 * F.sum("hit") / F.count("hit"), 6))
