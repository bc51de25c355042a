"""Exact quantiles of groups of any size, by histograms of ordered keys that are refined where the wanted ranks lie.

A double is read as a whole number that is ordered as the doubles are. A first pass counts
the rows of each value of the leading bits, in partial sums; the wanted ranks fall into a
few of these buckets, whose rows the next pass counts by further bits, until all 64 are
known. No pass sorts or gathers the values of a group, and no state grows with them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maregraph.operators.work import matched, stored

#: Bits that remain unknown after each pass: the first has few buckets, as all of them are looked at.
SHIFTS = (48, 24, 0)
MANTISSA = 52


#: Values of a task that wait to be counted, in passes after the first.
WAITING = 1 << 20


def _ordered(values: np.ndarray) -> np.ndarray:
    bits = values.view(np.int64)
    return np.where(bits < 0, -(bits & np.iinfo(np.int64).max), bits)


@F.arrow_udf(T.LongType())
def _bits(x: pa.Array) -> pa.Array:
    values = x.fill_null(math.nan).to_numpy(zero_copy_only=False)
    return pa.array(_ordered(values), mask=np.isnan(values))


def ordered_key(x: Column) -> Column:
    """A long that is ordered as x is, one for each double (0.0 and -0.0 have the same); null for null and NaN.

    It is the exponent and the mantissa, negative for negative x: the double's own bits.
    """
    return _bits(x.cast("double"))


@F.arrow_udf(T.DoubleType())
def between(low: pa.Array, high: pa.Array, part: pa.Array) -> pa.Array:
    """low * (1 - part) + high * part with one rounding of the first product and the sum, as DuckDB computes it. For tables of one row a key."""

    def one(a: float | None, b: float | None, d: float) -> float | None:
        if a is None or a == b:
            return a
        return math.fma(a, 1 - d, b * d) if math.isfinite(a) and math.isfinite(b) else a * (1 - d) + b * d

    return pa.array([one(*x) for x in zip(low.to_pylist(), high.to_pylist(), part.to_pylist(), strict=True)], pa.float64())


def of_key(key: Column) -> Column:
    """The double of an ordered key."""
    size = F.abs(key)
    exponent, mantissa = F.shiftright(size, MANTISSA), size.bitwiseAND(F.lit((1 << MANTISSA) - 1)).cast("double")
    found = F.when(exponent == 0, mantissa * 2.0**-1000 * 2.0**-74).when(exponent == 2047, float("inf")).otherwise((1 + mantissa / float(1 << MANTISSA)) * F.pow(F.lit(2.0), (exponent - 1023).cast("double")))
    return F.when(key < 0, -found).otherwise(found)


def _tallied(values: DataFrame, shift: int, known: int = 0, buckets: dict[int, np.ndarray] | None = None) -> DataFrame:
    """Rows `_c, _p, _m`: how many keys of each column of `values` (doubles) have the leading bits `_p`, those after `shift`.

    Of all rows, or of those whose bits after `known` are among a column's buckets
    (sorted). Each task counts in arrays, so a row is never one row for each column.
    """
    half = 1 << (63 - SHIFTS[0])

    def rows(c: int, p: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(p), c, np.int32)), pa.array(p), pa.array(m)], ["_c", "_p", "_m"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for c, column in enumerate(batch.columns):
                x = column.fill_null(math.nan).to_numpy(zero_copy_only=False)
                yield c, _ordered(x[~np.isnan(x)])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for c, key in keys(batches):
            if len(key):
                p = (key >> shift) + half
                low, m = int(p.min()), np.bincount(p - p.min())
                total.setdefault(c, np.zeros(2 * half, np.int64))[low : low + len(m)] += m
        for c, m in total.items():
            at = np.flatnonzero(m)
            yield rows(c, at - half, m[at])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = {}
        n = 0
        for c, key in keys(batches):
            if c in buckets:
                q = key >> known
                at = np.minimum(np.searchsorted(buckets[c], q), len(buckets[c]) - 1)
                waiting.setdefault(c, []).append(key[buckets[c][at] == q] >> shift)
                n += len(waiting[c][-1])
            if n >= WAITING:
                for k, parts in waiting.items():
                    yield rows(k, *np.unique(np.concatenate(parts), return_counts=True))
                waiting, n = {}, 0
        for k, parts in waiting.items():
            yield rows(k, *np.unique(np.concatenate(parts), return_counts=True))

    return values.mapInArrow(every if buckets is None else inside, "_c int, _p long, _m long")


def exact_quantiles(df: DataFrame, keys: tuple[str, ...], wanted: dict[str, tuple[str, float]], per: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Rows `keys` and the names of `wanted`: of each the quantile of its column, linear between ranks (nulls and NaN left out; null without values).

    `per` gives quantiles of rising functions of a column, which may read quantiles that
    are named before: the function of the two ranks' values is what is interpolated.

    One row for each key with any value, computed when called. Without keys there is one
    row, or none. df is read once: its keys are stored, and the passes read those. Buckets that hold wanted ranks meet the rows by a join that Spark broadcasts
    only if they are few; beyond that rows are dealt by bucket, never by key alone. Without
    keys they are at most two for each wanted quantile, and tasks know them.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    points = [sorted({q for c, q in wanted.values() if c == column}) for column in columns]
    if keys:
        values = df.select(*keys, *(ordered_key(F.col(c)).alias(f"_key{k}") for k, c in enumerate(columns)))
        values = values.select(*keys, F.posexplode(F.array(*(f"_key{k}" for k in range(len(columns))))).alias("_c", "_key")).filter("_key is not null")
    else:
        values = df.select(*(F.col(c).cast("double").alias(f"_key{k}") for k, c in enumerate(columns)))
    values = stored(values, "keys")
    own = [*keys, "_c"]

    def holding(counted: DataFrame, group: list[str], before: Column, ranks: Column) -> DataFrame:
        """Of the buckets `_p`, those with wanted ranks: `_before` rows come before, `_ranks` are in."""
        w = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        out = counted.withColumn("_at", before + F.coalesce(F.sum("_m").over(w), F.lit(0)))
        out = out.withColumn("_in", F.filter(ranks, lambda r: (r >= F.col("_at")) & (r < F.col("_at") + F.col("_m"))))
        return out.filter(F.size("_in") > 0).select(*own, "_p", "_n", F.col("_at").alias("_before"), F.col("_in").alias("_ranks"))

    of_column = F.element_at(F.array(*(F.array(*map(F.lit, p)) for p in points)), F.col("_c") + 1)
    place = lambda q, n: (n - 1) * q
    ranks = F.array_distinct(F.flatten(F.transform(of_column, lambda q: F.array(F.floor(place(q, F.col("_n"))), F.ceil(place(q, F.col("_n")))))))
    if keys:
        counted = values.groupBy(*own, F.shiftright("_key", SHIFTS[0]).alias("_p")).agg(F.count("*").alias("_m"))
    else:
        counted = _tallied(values, SHIFTS[0]).groupBy("_c", "_p").agg(F.sum("_m").alias("_m"))
    counted = counted.withColumn("_n", F.sum("_m").over(Window.partitionBy(*own)))
    found = holding(counted, own, F.lit(0), ranks)
    for known, shift in zip(SHIFTS, SHIFTS[1:], strict=False):
        buckets = stored(found, "buckets").select(*(F.col(k).alias(f"_of_{i}") for i, k in enumerate(own)), F.col("_p").alias("_q"), "_n", "_before", "_ranks")
        if keys:
            rows, prefix, size = values, F.shiftright("_key", shift), F.count("*")
            same = F.shiftright("_key", known) == F.col("_q")
        else:
            few: dict[int, list[int]] = {}
            for c, q in buckets.select("_of_0", "_q").collect():
                few.setdefault(c, []).append(q)
            rows, prefix, size = _tallied(values, shift, known, {c: np.array(sorted(q), np.int64) for c, q in few.items()}), F.col("_p"), F.sum("_m")
            same = F.shiftright("_p", known - shift) == F.col("_q")
        for i, k in enumerate(own):
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{i}"))
        inside = rows.join(F.broadcast(buckets) if not keys else buckets, same).groupBy(*own, "_q", prefix.alias("_p"))
        counted = inside.agg(size.alias("_m"), *(F.any_value(c).alias(c) for c in ("_n", "_before", "_ranks")))
        found = holding(counted, [*own, "_q"], F.col("_before"), F.col("_ranks"))
    picked = []
    for name, (column, q) in wanted.items():
        of = F.col("_c") == columns.index(column)
        at = lambda rank: F.max(F.when(of & F.array_contains("_ranks", rank), of_key(F.col("_p"))))  # noqa: B023, E731
        at_n = place(F.lit(q), F.max(F.when(of, F.col("_n"))))
        low, high = (at(f(place(F.lit(q), F.col("_n")))) for f in (F.floor, F.ceil))
        picked.append(F.struct(low.alias("low"), high.alias("high"), (at_n - F.floor(at_n)).alias("part")).alias(name))
    out = found.groupBy(*keys).agg(*picked)
    out = out.withColumns({name: between(F.col(f"{name}.low"), F.col(f"{name}.high"), F.col(f"{name}.part")) for name in wanted if name not in (per or {})})
    for name in filter((per or {}).__contains__, wanted):
        out = out.withColumn(name, between(*(per[name](F.col(f"{name}.{end}")) for end in ("low", "high")), F.col(f"{name}.part")))
    return stored(out, "quantiles")


def with_quantiles(df: DataFrame, keys: tuple[str, ...], wanted: dict[str, tuple[str, float]], per: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """df with exact_quantiles() of its keys (null keys are keys, too)."""
    found = exact_quantiles(df, keys, wanted, per)
    if not keys:
        return df.join(found, how="left") if found.count() else df.withColumns({name: F.lit(None).cast("double") for name in wanted})  # one row
    return matched(df, found, keys, "left")
