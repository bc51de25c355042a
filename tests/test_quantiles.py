"""Exact quantiles against sorted values, and their keys against the bits of doubles."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from maregraph.operators import quantiles, work
from maregraph.operators.quantiles import exact_quantiles, of_key, ordered_key, with_quantiles

HARD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1e-310, 1.0, -1.0, math.nextafter(1, 0), math.nextafter(2, 3), 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), -float("inf"), 0.1, 1 / 3, 1e300, 2.0**52 + 1]


def bits(x: float) -> int:
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_keys_are_the_bits_of_doubles(spark):
    rng = np.random.default_rng(1)
    drawn = [x for x in np.frombuffer(rng.bytes(8 * 20_000)).tolist() if x == x]
    around = [math.nextafter(s * 2.0**k, t) for k in range(-1074, 1024) for s in (1, -1) for t in (0, s * math.inf)] + [2.0**k for k in range(-1074, 1024)]
    xs = HARD + drawn + around
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ordered_key(F.col("x")).alias("k")).withColumn("back", of_key(F.col("k"))).collect()
    assert len(got) == len(xs)
    for r in got:
        assert r.k == bits(r.x) and r.back == r.x
    none = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(ordered_key(F.col("x")).alias("k")).collect()
    assert [r.k for r in none] == [None, None]


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {
        "normal": rng.normal(size=501), "ties": rng.integers(0, 3, 400).astype(float), "one": np.array([7.5]), "two": np.array([1.0, -1e300]), "same": np.full(90, -0.25),
        "wide": np.exp(rng.normal(scale=60, size=333)) * rng.choice([-1, 1], 333), "near": 1 + rng.integers(0, 50, 200) * 2.0**-52, None: rng.normal(size=40), "none": np.array([np.nan] * 5),
    }
    rows = [(k, float(x) if x == x else None, float(-2 * x) if x == x else float("nan")) for k, v in groups.items() for x in v.tolist()]
    rng.shuffle(rows)
    df = spark.createDataFrame([(None if k is None else str(k), None if x is None else float(x), float(y)) for k, x, y in rows], "k string, x double, y double").repartition(5)
    points = {"a": ("x", 0.0), "b": ("x", 0.25), "c": ("x", 0.5), "d": ("x", 0.995), "e": ("x", 1.0), "f": ("y", 0.5), "g": ("y", 0.999)}
    got = {r.k: r for r in exact_quantiles(df, ("k",), points).collect()}
    assert set(got) == set(groups) - {"none"}
    for k, r in got.items():
        for name, (column, q) in points.items():
            v = np.sort(groups[k] if column == "x" else -2 * groups[k]).tolist()
            at = (len(v) - 1) * q
            lo, hi = v[math.floor(at)], v[math.ceil(at)]
            assert r[name] == (lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi)
    joined = with_quantiles(df, ("k",), {"m": ("x", 0.5)}).groupBy("k").agg(F.count("*").alias("n"), F.max("m").alias("m")).collect()
    assert {r.k: r.n for r in joined} == {k: len(v) for k, v in groups.items()}
    assert all(r.m == got[r.k].c for r in joined if r.k != "none") and next(r for r in joined if r.k == "none").m is None


def test_quantiles_without_keys_and_of_nothing(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"))
    assert exact_quantiles(df, (), {"m": ("x", 0.5), "p": ("x", 0.123)}).first() == (500.0, 123.0)
    assert exact_quantiles(df.limit(0), ("x",), {"m": ("x", 0.5)}).count() == 0
    assert with_quantiles(df.limit(0), (), {"m": ("x", 0.5)}).columns == ["x", "m"]


def test_no_pass_gathers_a_group(spark, monkeypatch):
    """No plan of a pass holds a percentile, a list or a sort of rows; its windows are over counted buckets only."""
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return work.stored(df, name)

    monkeypatch.setattr(quantiles, "stored", seen)
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.rand(1).alias("x"))
    exact_quantiles(df, ("k",), {"m": ("x", 0.5)})
    assert len(plans) == 4 and "Window" not in plans[0]
    for text in plans[1:]:
        assert "percentile" not in text and "collect" not in text
        rows = [line for line in text.split("\n") if "Window" in line]
        assert rows and all("_p#" in line or "sum(_m" in line for line in rows)


def test_tests_of_series_hold_no_whole_key(spark):
    """The plans of the tests, over stored scores, have neither percentiles nor windows."""
    from maregraph.operators.classical import tested
    from maregraph.operators.series import Series

    df = spark.range(400).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 1800).alias("t"), F.col("id").alias("e"), F.rand(2).alias("x"), F.lit("v").alias("variable"))
    text = tested(df, Series(("k",), ("t", "e"), "x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in text and "Window" not in text


def test_interpolation_is_that_of_the_sql(spark, tmp_path):
    """Between ranks that lie an ulp apart every rounding decides on which side rows fall: the same as DuckDB, to the bit, of columns and of their ratios."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(5)
    cents = rng.integers(0, 30_000, (400, 30, 2)) / 100
    rows = [(k, float(abs(a - b)), 0.7 + k / 1000) for k in range(400) for a, b in cents[k]]
    df = spark.createDataFrame(rows, "k long, x double, h double")
    df.write.parquet(f"{tmp_path}/x")
    sql = f"SELECT k, quantile_cont(x, 0.995) AS a, quantile_cont(x, 0.9) AS b, quantile_cont(x / h, 0.995) AS c FROM '{tmp_path}/x/*.parquet' GROUP BY k"
    got = exact_quantiles(df, ("k",), {"c": ("x", 0.995), "a": ("x", 0.995), "b": ("x", 0.9), "h": ("h", 0.5)}, per={"c": lambda x: x / F.col("h")})
    assert sorted(map(tuple, got.select("k", "a", "b", "c").collect())) == sorted(duckdb.sql(sql).fetchall())


def test_weak_labels_at_a_quantile_are_those_of_the_sql(spark, tmp_path):
    """Values in tenths whose 90 per cent point lies between spikes an ulp apart."""
    duckdb = pytest.importorskip("duckdb")
    from maregraph.plans import causal  # noqa: F401
    from maregraph.plans.registry import QUERIES, SQL

    x = np.round(np.random.default_rng(333).integers(0, 40, 241) / 10, 1).tolist()
    rows = [(k, 0, "a", v) for k, v in enumerate(x)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60))
    events.write.parquet(f"{tmp_path}/events.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["weak_label_v1"](spark, str(tmp_path)).collect())) == sorted(duckdb.sql(SQL["weak_label_v1"]).fetchall())


@pytest.mark.parametrize("waiting", [1 << 20, 7])
def test_columns_without_keys_are_counted_in_arrays(spark, monkeypatch, waiting):
    """No row becomes one for each column; the quantiles are those of a single key's, whatever the values."""
    monkeypatch.setattr(quantiles, "WAITING", waiting)
    rng = np.random.default_rng(5)
    near = (1 + rng.integers(0, 50, 400) * 2.0**-52).tolist()
    drawn = [x for x in np.frombuffer(rng.bytes(8 * 400)).tolist() if x == x]
    xs = (HARD * 30)[:400]
    rows = [("k", x, y, z, None if i % 3 else float("nan"), i % 4) for i, (x, y, z) in enumerate(zip(xs, near, drawn, strict=False))]
    df = spark.createDataFrame(rows, "k string, x double, near double, drawn double, none double, n int").repartition(4)
    points = {f"{c}_{k}": (c, q) for c in ("x", "near", "drawn", "none", "n") for k, q in enumerate((0.0, 0.005, 0.25, 0.5, 0.995, 1.0))}
    sizes, keep = [], quantiles.stored
    monkeypatch.setattr(quantiles, "stored", lambda table, name: (out := keep(table, name), sizes.append((name, out.count())))[0])
    got = exact_quantiles(df, (), points).first().asDict()
    assert dict(sizes)["keys"] == len(rows)
    want = exact_quantiles(df, ("k",), points).first().asDict()
    same = lambda a, b: a == b or (a != a and b != b)
    assert all(same(got[c], want[c]) for c in points) and got["none_0"] is None and got["x_3"] is not None
