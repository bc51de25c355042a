"""Hand fixtures for the rules that are easy to get wrong."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maregraph.functions import scalar as R
from maregraph.operators import causal, classical, detectors, inject, metrics, models, tails
from maregraph.operators.series import Series, interpolated
from maregraph.sources.tables import exists, load_each, markdown, number, read_observations, write_csv

S = Series(("k",), ("t",), "x")


def frame(spark, values, key="a"):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "k string, t int, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("k", "t").collect()]


@pytest.mark.parametrize("gap, left", [(3, 0), (6, 0), (7, 1)])
def test_gap_filling(spark, gap, left):
    got = column(frame(spark, [1.0, *[None] * gap, 10.0]).withColumn("f", interpolated(None, S)), "f")
    assert got.count(None) == left
    if not left:
        assert np.allclose(got, np.linspace(1, 10, gap + 2))


def test_gap_filling_at_ends(spark):
    got = column(frame(spark, [*[None] * 5, 2.0, 3.0, *[None] * 5]).withColumn("f", interpolated(None, S)), "f")
    assert got == [None, None, 2.0, 2.0, 2.0, 2.0, 3.0, 3.0, 3.0, 3.0, None, None]


def test_whole_gaps_only(spark):
    got = column(frame(spark, [1.0, None, None, 4.0, *[None] * 4, 9.0]).withColumn("f", interpolated(None, S, mode="max_gap")), "f")
    assert got[1:3] == [2.0, 3.0] and got[4:8] == [None] * 4


def test_constant_series(spark):
    df = frame(spark, [5.0] * 60)
    assert set(column(classical.scores(df, S), "mad_score")) == {None}
    assert set(column(classical.q_dixon(df, S), "q")) == {0.0}
    assert set(column(causal.rolling_slope(df, S, "x"), "slope_6")) == {0.0}


def test_tied_extreme_has_no_gap(spark):
    got = column(classical.q_dixon(frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 9.0, 9.0, 4.0, 3.0, 2.0, 1.0]), S), "q")
    assert got[5] == 0.0


def test_q_dixon_edges(spark):
    values = [1.0, 2.0, 3.0, 9.0, 4.0, 5.0, 6.0]
    cut, exact = (column(classical.q_dixon(frame(spark, values), S, edges=e), "q") for e in ("cut", "exact"))
    assert cut[0] == pytest.approx(4 / 8)  # six rows in the frame: its fourth is read as the centre
    assert exact[0] == pytest.approx(1 / 8)


def test_quality_bins(spark):
    df = spark.createDataFrame([(50.0,), (75.0,), (90.0,), (90.1,), (None,)], "q double").select(R.quality_class(F.col("q")).alias("c"))
    assert [r.c for r in df.collect()] == ["Bad", "Suspect", "Good", "Excellent", None]


def test_sign_persistence(spark):
    assert column(causal.sign_persistence(frame(spark, [1.0, 2.0, 0.0, 1.0, -1.0, -2.0]), S, "x"), "persistence") == [1, 2, 1, 1, 1, 2]


def test_bad_runs(spark):
    df = frame(spark, [1.0, 9.0, 1.0, 8.0, 8.0, 8.0, 1.0]).withColumn("f", F.when(F.col("x") > 5, "BAD").otherwise("GOOD"))
    got = [(r.n_points, r.event_type) for r in classical.bad_events(df, S, "f", "x").orderBy("start").collect()]
    assert got == [(1, "possible_instrumental_spike"), (3, "possible_physical_event")]


def test_cusum_resets(spark):
    e = [0.0, *[1.0] * 200, *[0.0] * 2]
    sigma = np.std(e, ddof=1)
    up, want = 0.0, []
    for t, v in enumerate(e):
        up = 0.0 if t == 0 else max(0.0, up + v - 0.5 * sigma)
        up = 0.0 if up > 20 * sigma else up
        want.append(up)
    assert 0.0 in want[2:50]
    assert np.allclose(column(causal.recursive_memory(frame(spark, e), S, "x", ("t",)), "cusum_pos"), want)


def test_no_look_ahead(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60).tolist()
    changed = [*x[:41], 50.0, *x[42:]]
    for make in (lambda d: causal.level_score(d, S), lambda d: causal.acceleration_score(d, S), lambda d: causal.rolling_slope(d, S, "x")):
        name = next(c for c in make(frame(spark, x)).columns if c not in ("k", "t", "x"))
        assert column(make(frame(spark, x)), name)[:41] == column(make(frame(spark, changed)), name)[:41]


def test_student_tail(spark):
    row = spark.range(1).select(R.t4_sf(F.lit(2.1318467863)).alias("a"), R.t4_sf(F.lit(0.7406970841126811)).alias("b")).first()
    assert row.a == pytest.approx(0.05, abs=1e-9) and row.b == pytest.approx(0.25, abs=1e-9)


def test_pareto_fit_finds_its_parameters(spark):
    rng = np.random.default_rng(5)
    z = 2.0 / 0.3 * ((1 - rng.random(20000)) ** -0.3 - 1)
    df = spark.createDataFrame([("a", float(v)) for v in np.concatenate([np.ones(80000), z + 1])], "k string, x double")
    row = tails.gpd_fit(df, ("k",), "x", 0.8).first()
    assert row["shape"] == pytest.approx(0.3, abs=0.05) and row["scale"] == pytest.approx(2.0, rel=0.3)


def test_ranking_with_ties(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.5), ("a", 0, 0.1)], "k string, y int, s double")
    row = metrics.ranking(df, F.col("y"), "s", ("k",)).first()
    assert row.auroc == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert row.average_precision == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_stream_metrics(spark):
    truth = ["GOOD", "GOOD", "BAD", "BAD", "GOOD", "SUSPECT"]
    said = ["GOOD", "BAD", "GOOD", "BAD", "SUSPECT", "GOOD"]
    df = spark.createDataFrame([("a", i, 0.0, t, p) for i, (t, p) in enumerate(zip(truth, said, strict=True))], "k string, t int, x double, truth string, said string")
    row = metrics.stream_metrics(df, S, "truth", "said").first()
    assert (row.n_clean, row.false_alarms, row.n_episodes, row.mean_coverage_pct) == (3, 2, 2, 25.0)


def test_variance_shares_add_up(spark):
    df = spark.createDataFrame([(a, b, a + b / 100) for a in (1, 2, 3) for b in range(10, 60, 10)], "a int, b int, v double")
    row = metrics.variance_allocation(df, "a", "b", "v").first()
    assert sum(row) == pytest.approx(100) and row.pct_rest == pytest.approx(0, abs=1e-6)


def test_injection_touches_only_its_events(spark):
    rng = np.random.default_rng(2)
    df = frame(spark, (20 + rng.normal(size=1500)).tolist())
    drawn = inject.events(df, S)
    rows = inject.injected(df, S, drawn).collect()
    assert len(rows) == 1500
    assert all((r.class_int == -1) == (r.family == "") for r in rows)
    assert all(r.y == r.x for r in rows if r.family == "")
    assert {r.family for r in rows} - {""} == set(inject.FAMILIES)
    assert sum(r.family != "" for r in rows) == drawn.agg(F.sum("duration")).first()[0]


@pytest.mark.parametrize("n", [1, 5, 20, 27, 28, 60])
def test_injection_of_short_series(spark, n):
    df = frame(spark, [float(k) for k in range(n)])
    drawn = inject.events(df, S)
    rows = inject.injected(df, S, drawn).collect()
    assert len(rows) == n and sorted(r.t for r in rows) == list(range(n))
    starts = [(r.start, r.duration) for r in drawn.orderBy("start").collect()]
    assert len(starts) == min(n, 28) and all(a + d <= b for (a, d), (b, _) in zip(starts, starts[1:], strict=False)) and sum(starts[-1]) <= n


def test_bootstrap_depends_on_ids_alone(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(5, 2, 400)
    df = spark.createDataFrame([(i, "a", float(v)) for i, v in enumerate(x)] + [(1000, "b", 1.0), (1001, "b", None)], "i int, g string, v double")
    a, b = ({r.g: r for r in metrics.bootstrap_mean(df.repartition(k), ("g",), "v", ("i",)).collect()} for k in (1, 5))
    assert all(a[g][:2] == b[g][:2] and np.allclose(a[g][1:], b[g][1:], rtol=1e-12) for g in "ab")
    half = 1.96 * 2 / 20
    assert a["a"].lo == pytest.approx(x.mean() - half, abs=0.03) and a["a"].hi == pytest.approx(x.mean() + half, abs=0.03)
    assert a["b"].lo == a["b"].hi == 1.0
    assert metrics.POISSON[-1] == pytest.approx(1, abs=1e-15)


def test_sums_with_resets_are_those_of_a_loop():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 9000):
        steps, start, limit = rng.normal(0.05, 1, n), 0.7, 6.0
        p, want = start, []
        for v in steps:
            p = max(0.0, p + v)
            p = 0.0 if p > limit else p
            want.append(p)
        assert np.allclose(causal.clipped_sums(steps, start, limit), want, atol=1e-9)


def test_clipped_maps_are_those_of_a_loop():
    """A chunk's map against sums from any start, with resets, for drifts up, down and none, and maps one after the other."""
    rng = np.random.default_rng(11)
    for n in (0, 1, 2, 50, 400):
        for drift in (-0.3, 0.0, 0.1, 1.0):
            steps, limit = rng.normal(drift, 1, n), 6.0
            found = causal.clipped_map(steps, limit)
            half = causal.clipped_map(steps[: n // 2], limit), causal.clipped_map(steps[n // 2 :], limit)
            for start in [0.0, limit, *rng.uniform(0, limit, 40)]:
                want = start
                for v in steps:
                    want = max(0.0, want + v)
                    want = 0.0 if want > limit else want
                assert causal.through(start, *found) == pytest.approx(want, abs=1e-9)
                assert causal.through(causal.through(start, *half[0]), *half[1]) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("rows", [1, 7, 100, 10_000])
def test_memory_in_chunks_of_any_size(spark, rows):
    rng = np.random.default_rng(7)
    series = {"a": rng.normal(0.4, 1, 333), "b": rng.normal(0, 3, 120), None: rng.normal(0, 1, 20), "c": np.array([2.5])}
    rng.shuffle(series["a"])
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, t int, x double").repartition(5)
    got = {(r.k, r.t): r for r in causal.recursive_memory(df, S, "x", ("t",), reset=2.0, rows=rows).collect()}
    assert len(got) == df.count()
    resets = 0
    for k, x in series.items():
        sigma = np.std(x, ddof=1) if len(x) > 1 else 1e-6
        average, sums = x[0], [0.0, 0.0]
        for t, v in enumerate(x):
            if t:
                average = 0.1 * v + 0.9 * average
                for i, sign in enumerate((1, -1)):
                    sums[i] = max(0.0, sums[i] + sign * v - 0.5 * sigma)
                    resets += sums[i] > 2 * sigma
                    sums[i] = 0.0 if sums[i] > 2 * sigma else sums[i]
            r = got[k, t]
            assert (r.ewma_0, r.cusum_pos, r.cusum_neg) == pytest.approx((average, *sums), abs=1e-8)
    assert resets > 5


def test_memory_goes_on_from_batch_to_batch(spark):
    rng = np.random.default_rng(5)
    e = rng.normal(0.2, 1, 700)
    df = spark.createDataFrame([(k, i, float(v)) for k in "ab" for i, v in enumerate(e)], "k string, t int, x double").repartition(7)
    had = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = causal.recursive_memory(df, S, "x", ("t",)).filter("k = 'b'").orderBy("t").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)
    average, down, sigma = e[0], 0.0, np.std(e, ddof=1)
    for t, v in enumerate(e):
        if t:
            average, down = 0.3 * v + 0.7 * average, max(0.0, down - v - 0.5 * sigma)
            down = 0.0 if down > 20 * sigma else down
        assert (rows[t].ewma_1, rows[t].cusum_neg) == pytest.approx((average, down), abs=1e-9)


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    from datetime import datetime

    from maregraph.streaming.quality import causal_scores

    source, schema = tmp_path / "in", "station long, ts timestamp, event_id long, x double"
    at = lambda m: datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(1, at(10), 1, 4.0), (1, at(20), 2, 8.0)], schema).coalesce(1).write.parquet(str(source / "a"))
    for turn in range(2):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
        stream = causal_scores(stream, slack=1.0, reset=1000.0)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        if not turn:
            spark.createDataFrame([(1, at(15), 3, 99.0), (1, at(30), 4, 6.0), (2, at(5), 5, 1.0)], schema).coalesce(1).write.parquet(str(source / "b"))
    got = {r.event_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert got[4].ewma == pytest.approx(0.3 * 6 + 0.7 * (0.3 * 8 + 0.7 * 4)) and got[4].rate == 2.0 and got[4].cusum_pos == 7 + 5


def test_lag_forecast_finds_a_recursion(spark):
    rng = np.random.default_rng(1)
    x = [1.0]
    for _ in range(400):
        x.append(0.6 * x[-1] + 3 + rng.normal(0, 0.5))
    df = frame(spark, x)
    got = models.lag_forecast(df, S, "x", F.col("t") < 300, lags=2).orderBy("t").collect()
    assert len(got) == 399
    e = np.array([r.predicted - (0.6 * x[r.t - 1] + 3) for r in got])
    assert np.abs(e[20:]).mean() < 0.15  # the noise has a deviation of 0.5


def test_components_hold_what_they_were_fitted_on(spark):
    t = np.arange(500)
    x = np.sin(t / 7) + 0.5 * np.cos(t / 7)
    x[450] += 5
    got = {r.t: r.residual for r in models.component_residual(frame(spark, x.tolist()), S, "x", F.col("t") < 400, lags=6, k=2).collect()}
    assert max(v for k, v in got.items() if k <= 450) < 1e-6 and got[453] > 1


def test_collapsed_metrics_of_few_rows(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (2, 0)], "truth int, predicted int")
    got = metrics.collapsed(df, "truth", "predicted").first()
    assert (got.precision, got.recall, got.binary_f1) == (0.5, 0.5, 0.5)
    assert got.macro_f1 == pytest.approx((0.5 + 0 + 0) / 3) and got.balanced_accuracy == pytest.approx((0.5 + 0 + 0) / 3)
    none = metrics.collapsed(df.limit(0), "truth", "predicted").first()
    assert none.macro_f1 is None and none.balanced_accuracy is None and (none.precision, none.recall, none.binary_f1) == (0, 0, 0)


def test_forest_isolates_what_is_apart(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 2))
    x[590:] = [[9, 9], [-9, 8], [8, -9], [10, 0], [0, 11], [-11, 1], [9, -8], [-9, -9], [12, 3], [3, 12]]
    df = spark.createDataFrame([(i, *map(float, v), i < 590) for i, v in enumerate(x)], "i int, a double, b double, fit boolean")
    scored = detectors.isolation_scores(df, ["a", "b"], ["i", "fit"], train="fit")
    flagged = {r.i for r in detectors.isolation_flags(scored, F.col("fit"), 0.02).filter("flagged").collect()}
    assert set(range(590, 600)) <= flagged and len(flagged) - 10 <= 0.02 * 590 + 1


def test_heads_learn_separable_classes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(c), float(c * 4 + rng.normal(0, 0.5)), float(rng.normal()), i % 3 > 0) for i, c in enumerate(rng.choice(3, 600, p=[0.7, 0.2, 0.1]))]
    df = spark.createDataFrame(rows, "i int, label int, a double, b double, fit boolean")
    scaled = models.standard_scaled(models.robust_scaled(df, ["a"], F.col("fit")), ["a", "b"], F.col("fit"))
    m = scaled.filter("fit").agg(F.avg("a"), F.stddev_pop("a")).first()
    assert m[0] == pytest.approx(0, abs=1e-9) and m[1] == pytest.approx(1)
    for head in (models.ordinal_head, models.softmax_head):
        got = head(scaled, ["a", "b"], "label", F.col("fit")).filter("not fit").collect()
        assert all(r.p_good + r.p_suspect + r.p_bad == pytest.approx(1) for r in got)
        assert np.mean([int(np.argmax([r.p_good, r.p_suspect, r.p_bad])) == r.label for r in got]) > 0.95
    weights = {r.label: r.weight for r in models.class_weights(df, "label").select("label", "weight").distinct().collect()}
    n = {c: sum(r[1] == c for r in rows) for c in range(3)}
    assert weights == {c: pytest.approx(600 / (3 * n[c])) for c in range(3)}


def test_calibrations_are_those_of_their_sample(spark, tmp_path):
    """Ranks, scale and tail of a training part, the same after writing and reading; rows of keys it lacks have none."""
    rng = np.random.default_rng(9)
    rows = [(k, i, float(np.round(v, 1)), i < 200) for k in ("a", None) for i, v in enumerate(rng.standard_t(3, 300))] + [("b", 1, 2.0, False)]
    df = spark.createDataFrame(rows, "k string, t int, x double, train boolean")
    made = tails.Calibration.of(df.filter("train"), ("k",), "x")
    made.write(str(tmp_path / "c"))
    read = tails.Calibration.read(spark, str(tmp_path / "c"), ("k",))
    got, again = ({(r.k, r.t): r for r in c.judge(df, "x").collect()} for c in (made, read))
    assert got == again and len(got) == len(rows)
    assert got["b", 1].p_gpd is None and got["b", 1].p_robust is None
    fit = {r.k: r for r in tails.gpd_fit(df, ("k",), "x", train=df["train"]).collect()}
    for k in ("a", None):
        sample = np.array([x for key, _, x, train in rows if key == k and train])
        f = fit[k]
        assert f.threshold == pytest.approx(np.quantile(sample, 0.9)) and f.n_exceed == (sample > f.threshold).sum()
        for key, t, x, _ in rows:
            if key == k and x <= f.threshold:
                assert got[k, t].p_gpd == pytest.approx((sample >= x).mean(), abs=1e-12)
            elif key == k:
                inside = 1 + f["shape"] * (x - f.threshold) / f.scale
                assert got[k, t].p_gpd == pytest.approx(f.p_exceed * inside ** (-1 / f["shape"]) if inside > 0 else 0, abs=1e-9)


def test_likelihood_of_fits_is_the_best(spark):
    """No shape and scale near the fitted ones, nor any on a coarse grid, are likelier."""
    rng = np.random.default_rng(12)
    values = {"heavy": rng.pareto(2, 900), "light": rng.uniform(0, 1, 700), "expo": rng.exponential(2, 800)}
    df = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x], "k string, x double")

    def likelihood(z, shape, scale):
        inside = 1 + shape * z / scale
        return -np.inf if inside.min() <= 0 or scale <= 0 else -len(z) * np.log(scale) - (1 + 1 / shape) * np.log(inside).sum()

    for r in tails.gpd_fit(df, ("k",), "x", 0.5).collect():
        z = values[r.k][values[r.k] > r.threshold] - r.threshold
        best = likelihood(z, r["shape"], r.scale)
        around = [likelihood(z, r["shape"] + a, r.scale * b) for a in (-0.05, -0.01, 0.01, 0.05) for b in (0.9, 0.98, 1.0, 1.02, 1.1)]
        assert best >= max(around) - 1e-3 * len(z) ** 0.5, r.k


def test_feature_sets_and_steps():
    assert detectors.feature_set("E", ("h0", "h1"), ("w",)) == ["h0", "h1", "y", "predicted", "residual", "abs_residual", "spike", "mad_score", "gpd_score", "rate", "outside", "w", "missing_mask"]
    assert detectors.feature_set("C")[:4] == detectors.feature_set("B") and detectors.feature_set("D", ("h",))[1:] == detectors.feature_set("B")


def test_files_that_are_not_there(spark, tmp_path):
    assert not exists(spark, str(tmp_path / "no")) and exists(spark, str(tmp_path))
    assert load_each(spark, {"a": str(tmp_path / "no")}, "x double").count() == 0
    text = markdown(spark.range(5), 3)
    assert "First 3 rows" in text and text.count("|") == 2 * 5 and "First" not in markdown(spark.range(3), 3)


def test_models_are_stored_with_their_parameters(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    fitted = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="x")]).fit(spark.createDataFrame([(1.0,)], "a double"))
    models.save_model(fitted, str(tmp_path / "m"), {"tau": 0.7})
    again, parameters = models.load_model(str(tmp_path / "m"))
    assert parameters == {"tau": 0.7} and again.transform(spark.createDataFrame([(2.0,)], "a double")).first().x[0] == 2.0


def test_threshold_is_the_middle_of_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.1, 0)], "p double, y int")
    row = models.tuned_threshold(models.by_threshold(df, "p", F.col("y") == 1)).first()
    assert row.f1 == 1.0 and row.tau == pytest.approx(0.525)


def test_observation_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("/ note\nYEAR,MONTH,DAY,HOUR,MINUTE,SECOND,v\n/ more\n2020,1,2,3,4,5,1.5\n2020,13,2,3,4,5,2.5\n2020,1,2,3,4,6,NULL\n2020,1,2,3,4,7,NaN\n")
    rows = read_observations(spark, str(tmp_path / "a.csv"), ["v"]).orderBy("ts").collect()
    assert [r.v for r in rows] == [1.5, None, None]
    assert "| v |" in markdown(spark.createDataFrame([(1.0,)], "v double"))
    write_csv(spark.createDataFrame([(None,), (2.0,)], "v double"), str(tmp_path / "out"))
    assert spark.range(1).select(number(F.lit("n/a"))).first()[0] is None


def test_leave_one_out_has_every_fold(spark):
    rng = np.random.default_rng(2)
    x, folds = np.cumsum(rng.normal(size=2600)) + 300, 1200
    df = spark.createDataFrame([(0, i, float(v), i % folds if i % folds else None) for i, v in enumerate(x)], "k int, t long, x double, f long")
    got = {r["fold"]: r for r in models.leave_one_out_forecasts(df, Series(("k",), ("t",), "x"), "x", "f", lags=2).collect()}
    assert len(got) == folds and sum(r["n"] for r in got.values()) == 2598
    y, a = x[2:], np.column_stack([np.ones(2598), x[1:-1], x[:-2]])
    f = np.arange(2, 2600) % folds
    for k in (0, 1, 77, 1199):
        w = np.linalg.lstsq(a[f != k], y[f != k], rcond=None)[0]
        assert got[k or None]["mae"] == pytest.approx(np.abs(y - a @ w)[f == k].mean(), rel=1e-7)
    one = models.leave_one_out_forecasts(df.withColumn("f", F.lit(1)), Series(("k",), ("t",), "x"), "x", "f").collect()
    assert [(r["fold"], r["mae"], r["n"]) for r in one] == [(1, None, 2597)]


def test_reserved_events_are_those_of_a_plain_draw(spark):
    """Against a loop over every start in drawn order; gaps hold, short series get fewer, and injected rows are inside events only."""
    import hashlib

    sizes = {"a": 2500, "b": 260, "c": 150, "d": 14, "e": 3}
    df = spark.createDataFrame([(k, i, float(i % 7)) for k, n in sizes.items() for i in range(n)], "k string, t int, x double")
    drawn = inject.reserved_events(df, S, per_family=3, gap=6)
    got = {(r.k, r.family, r.start) for r in drawn.collect()}
    u = lambda *of: int(hashlib.md5("|".join(map(str, of)).encode()).hexdigest()[:12], 16) / 2**48
    want = set()
    for k, n in sizes.items():
        used = np.zeros(n + 200, bool)
        for family in inject.FAMILIES:
            long, own, mine = inject.longest(family), [], np.zeros(n + 200, bool)
            for i in sorted(range(6, n - long - 6), key=lambda i: (u("o0", k, family, i), i)):  # noqa: B023
                if len(own) < 3 and not mine[i - 6 : i + long + 6].any():
                    mine[i - 6 : i + long + 6] = True
                    own.append(i)
            free = [i for i in own if not used[i - 6 : i + long + 6].any()]
            for i in free:
                used[i - 6 : i + long + 6] = True
            want |= {(k, family, i) for i in free}
    assert got == want and len({f for k, f, _ in got if k == "a"}) == 7 and not [g for g in got if g[0] == "e"]
    rows = inject.injected(df, S, drawn).collect()
    inside = {(r.k, r.start + j) for r in drawn.collect() for j in range(r.duration)}
    assert {(r.k, r.t) for r in rows if r.class_int >= 0} == inside and len(rows) == sum(sizes.values())


def test_streams_close_what_is_over(spark, tmp_path):
    """Medians and sessions go out once, when the watermark has passed; state is empty afterwards; a silent station starts anew."""
    from datetime import datetime, timedelta

    from maregraph.streaming import quality

    start, schema = datetime(2024, 1, 1), "station long, ts timestamp, event_id long, x double"
    at = lambda m: start + timedelta(minutes=m)
    batches = [[(1, at(5), 1, 1.0), (1, at(50), 2, 3.0), (1, at(70), 3, 9.0), (2, at(20), 4, 5.0)], [(1, at(80), 5, 7.0), (2, at(25), 6, None)], [(1, at(400), 7, 2.0)], [(1, at(10), 8, 100.0), (1, at(60 * 24 * 9), 9, 4.0)], [(3, at(60 * 24 * 30), 10, 0.0)]]
    made = {"medians": lambda e: quality.hourly_medians(e, "ts", "station", "x"), "sessions": lambda e: quality.sessions(e, "ts", "station"), "scores": lambda e: quality.causal_scores(e, slack=1.0, reset=1000.0, silence="5 days")}
    left = {}
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        for name, make in made.items():
            stream = make(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
            run = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"state-{name}")).trigger(availableNow=True).start()
            run.awaitTermination()
            left[name] = run.lastProgress["stateOperators"][0]["numRowsTotal"]
    got = {name: spark.read.parquet(str(tmp_path / name)).collect() for name in made}
    medians = sorted((r.station, (r.hour - start).total_seconds() / 3600, r.value) for r in got["medians"])
    assert medians == [(1, 0.0, 2.0), (1, 1.0, 8.0), (1, 6.0, 2.0), (1, 216.0, 4.0), (2, 0.0, 5.0)]
    sessions = sorted((r.station, (r.start - start).total_seconds() / 60, (r.end - start).total_seconds() / 60, r.n) for r in got["sessions"])
    assert sessions == [(1, 5.0, 35.0, 1), (1, 50.0, 110.0, 3), (1, 400.0, 430.0, 1), (1, 12960.0, 12990.0, 1), (2, 20.0, 55.0, 2)]
    scores = {r.event_id: r for r in got["scores"]}
    assert set(scores) == {1, 2, 3, 4, 5, 6, 7, 9, 10}
    assert scores[5].ewma == pytest.approx(0.3 * 7 + 0.7 * (0.3 * 9 + 0.7 * (0.3 * 3 + 0.7 * 1))) and scores[9].ewma == 4.0 and scores[9].rate == 0.0
    assert all(n <= 6 for n in left.values()), left


def test_stream_scores_go_out_in_bounded_frames(monkeypatch):
    """A station's rows of a micro-batch, in any order, are sent ROWS at a time, with the values of one frame."""
    from maregraph.streaming import quality

    class State:
        value = None
        exists, get, update = (lambda self: self.value is not None), (lambda self: self.value), (lambda self, v: setattr(self, "value", v))

    class Handle:
        getValueState, listTimers, registerTimer = (lambda self, *a: State()), (lambda self: []), (lambda self, t: None)

    rng = np.random.default_rng(3)
    minutes = np.cumsum(rng.choice([0, 1, 60 * 24 * 40], 500, p=[0.2, 0.78, 0.02]))
    rows = pd.DataFrame({"station": 7, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, unit="min"), "event_id": np.arange(500), "x": np.where(rng.random(500) < 0.1, np.nan, rng.normal(0, 30, 500))}).sample(frac=1, random_state=1)
    found = []
    for size in (10_000, 7):
        monkeypatch.setattr(quality, "ROWS", size)
        scores = quality.CausalScores(25.0, 100.0, 0.3, 30 * 24 * 3_600_000)
        scores.init(Handle())
        frames = list(scores.handleInputRows((7,), iter([rows[:200], rows[200:]]), None))
        assert max(map(len, frames)) <= size
        found.append(pd.concat(frames, ignore_index=True))
    pd.testing.assert_frame_equal(*found)
    assert found[0]["event_id"].tolist() == list(range(500)) and len(found[0].query("persistence > 1"))


def test_trailing_frames_are_sorted_without_comparators(spark):
    """array_sort calls an interpreted comparator for every pair of every frame."""
    df = spark.range(9).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("x"))
    plan = causal.level_score(df, Series(("k",), ("t",), "x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
