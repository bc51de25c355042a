"""Peaks found chunk by chunk against a plain search."""

from __future__ import annotations

import numpy as np
import pytest

from maregraph.operators.peaks import peaks, walk_left
from maregraph.operators.series import Series

S = Series(("k",), ("t",), "x")


def plain(x, height=1.0, distance=50, prominence=1.0):
    """Row by row: runs, then the highest first (of equal ones the last), then prominence."""
    n, found, i = len(x), [], 0
    while i < n:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if i > 0 and j < n - 1 and x[i - 1] < x[i] > x[j + 1] and x[i] >= height:
            found.append((i + j) // 2)
        i = j + 1
    stay = []
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in stay):
            stay.append(p)
    out = []
    for p in sorted(stay):
        lows = []
        for way in (-1, 1):
            q, low = p, x[p]
            while 0 <= q < n and x[q] <= x[p]:
                low, q = min(low, x[q]), q + way
            lows.append(low)
        if x[p] - max(lows) >= prominence:
            out.append(p)
    return out


def both(x, **options):
    return {(p, x[p], 1) for p in plain(x, **options)} | {(p, x[p], -1) for p in plain([-v for v in x], **options)}


def series(seed=0):
    rng = np.random.default_rng(seed)
    return {
        "noise": rng.normal(0, 2, 300).tolist(), "steps": rng.integers(-3, 4, 260).astype(float).tolist(), "flat": np.repeat(rng.integers(-3, 4, 25), rng.integers(1, 30, 25)).astype(float).tolist(),
        "up": np.where(np.arange(240) % 2, np.arange(240) * 0.1, 0.0).tolist(), "down": np.where(np.arange(240) % 2, 24 - np.arange(240) * 0.1, 0.0).tolist(), "slow": (3 * np.sin(np.arange(300) / 9) + np.sin(np.arange(300) / 2)).tolist(),
        "one": [4.0], "two": [0.0, 5.0], "same": [2.0] * 70, None: [0.0, 3.0, 3.0, 0.0, 5.0, 0.0, -4.0, -4.0, 0.0],
    }


@pytest.mark.parametrize(("rows", "distance", "prominence"), [(10_000, 50, 1.0), (19, 50, 1.0), (40, 3, 2.5)])
def test_peaks_of_chunks_are_those_of_a_plain_search(spark, rows, distance, prominence):
    named = series()
    df = spark.createDataFrame([(k, i, float(v)) for k, x in named.items() for i, v in enumerate(x)], "k string, t int, x double").repartition(6)
    got = peaks(df, S, "x", 1.0, distance, prominence, rows=rows).collect()
    for k, x in named.items():
        assert {(r.t, r.peak, r.side) for r in got if r.k == k} == both(x, distance=distance, prominence=prominence), k
    assert len(got) == sum(len(both(x, distance=distance, prominence=prominence)) for x in named.values()) > 10


def test_missing_values_count_as_zero(spark):
    x = [0.0] * 200
    x[10], x[30], x[100], x[101], x[150] = 3.0, 5.0, 2.0, 2.0, 0.5
    rows = [("a", i, v or None) for i, v in enumerate(x)] + [("b", i, float("inf") if i == 3 else 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, t int, x double")
    assert {(r.k, r.t, r.peak) for r in peaks(df, S, "x").collect()} == {("a", 30, 5.0), ("a", 100, 2.0)}
    assert peaks(df.limit(0), S, "x").count() == 0


def test_walks_against_a_loop():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 8, 33, 100):
        x = rng.integers(0, 9, n).astype(float)
        at, v = rng.integers(0, n + 1, 60), rng.integers(0, 10, 60).astype(float)
        stop, least = walk_left(x, x, at, v)
        for a, h, s, m in zip(at, v, stop, least, strict=True):
            q, low = a - 1, np.inf
            while q >= 0 and x[q] <= h:
                low, q = min(low, x[q]), q - 1
            assert (s, m) == (q, low)
