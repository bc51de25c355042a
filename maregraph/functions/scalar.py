"""Column functions of the quality-control rules: null in, null out unless a rule says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the rules.
MAD_TO_SIGMA = 1.4826
Q_SUSPECT, Q_BAD = 0.412, 0.517
T4_QUARTILE = 0.7406970841126811  # upper quartile of Student's t with 4 degrees of freedom
CLASS_RANK = {"GOOD": 0, "SUSPECT": 1, "BAD": 2}


def clean(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def flag(condition: Column) -> Column:
    """A test that can't be made isn't failed."""
    return F.coalesce(condition, F.lit(False))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def z_class(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size <= 3, "GOOD").when(size <= 4, "SUSPECT").when(size > 4, "BAD").otherwise("MISSING")


def q_class(q: Column) -> Column:
    return F.when(q < Q_SUSPECT, "GOOD").when(q <= Q_BAD, "SUSPECT").when(q > Q_BAD, "BAD").otherwise("MISSING")


def quality_class(qi: Column) -> Column:
    """Right-closed bins."""
    return F.when(qi <= 50, "Bad").when(qi <= 75, "Suspect").when(qi <= 90, "Good").when(qi.isNotNull(), "Excellent")


def season(ts: Column) -> Column:
    """Southern seasons by month."""
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "verao").when(m.isin(3, 4, 5), "outono").when(m.isin(6, 7, 8), "inverno").otherwise("primavera")


def bad_share_text(pct: Column) -> Column:
    return F.when(pct < 0.1, "very low").when(pct < 1, "low").when(pct < 5, "moderate").otherwise("high")


def gap_share_text(pct: Column) -> Column:
    """The reading of Q-Dixon's share of BAD rows."""
    return F.when(pct < 0.1, "few isolated extremes, excellent").when(pct < 1, "few isolated extremes, good").when(pct < 5, "look into it locally").otherwise("instrument, processing or a limit too tight")


def t4_sf(t: Column) -> Column:
    """Upper tail of Student's t with 4 degrees of freedom."""
    u = 1 + t * t / 4
    return 0.5 - 0.375 * (t / F.sqrt(u)) * (1 - t * t / (12 * u))


def gpd_sf(z: Column, shape: Column, scale: Column) -> Column:
    """Upper tail of the generalised Pareto distribution at z >= 0."""
    inside = 1 + shape * z / scale
    return F.when(F.abs(shape) < 1e-9, F.exp(-z / scale)).when(inside <= 0, 0.0).otherwise(F.pow(inside, -1 / shape))


def rank_of(label: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, k in CLASS_RANK.items():
        out = F.when(label == name, k).otherwise(out)
    return out


def label_of(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, k in CLASS_RANK.items():
        out = F.when(rank == k, name).otherwise(out)
    return out


def decision(value: Column, range_flag: Column, quality: Column, dixon: Column, q_dixon: Column, removed: Column, any_flag: Column, qi: Column) -> Column:
    """use, review or remove: the first rule that holds."""
    remove = value.isNull() | range_flag | flag(quality == "Bad") | (dixon == "BAD") | (q_dixon == "BAD") | removed
    review = any_flag | (dixon == "SUSPECT") | (q_dixon == "SUSPECT") | flag(qi < 75)
    return F.when(remove, "remove").when(review, "review").otherwise("use")


def final_class(decided: Column, quality: Column) -> Column:
    return F.when(decided == "remove", "Bad").when(decided == "review", "Suspect").otherwise(F.coalesce(quality, F.lit("Excellent")))


def ordinal_probabilities(q1: Column, q2: Column) -> tuple[Column, Column, Column]:
    """P(GOOD), P(SUSPECT), P(BAD) from P(>= SUSPECT) and P(BAD | >= SUSPECT)."""
    return 1 - q1, q1 * (1 - q2), q1 * q2


def ordinal_decision(p_good: Column, p_suspect: Column, p_bad: Column, tau: Column | float, sentinel: Column | None = None) -> Column:
    out = F.when(p_bad >= tau, "BAD").when(p_suspect >= p_good, "SUSPECT").otherwise("GOOD")
    return out if sentinel is None else F.when(sentinel, "BAD").otherwise(out)


def is_sentinel(observed: Column) -> Column:
    """Missing, -999 or negative raw values."""
    return observed.isNull() | flag(observed < 0)
