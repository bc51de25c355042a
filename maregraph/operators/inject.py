"""Synthetic anomalies drawn by hashes, and the labels of rows touched and untouched.

An event is a row number, a family, a duration and a signed size. Every draw is a hash
of the series' key and the event's number, so a run repeats and no random state moves
between tasks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maregraph.operators.series import Series, over_key

# Fixed values of the injection.
FAMILIES = ("A_spike", "B_mult", "C_level_shift", "D_drift", "E_stuck", "F_burst_noise", "G_missing_sentinel")
SHORT, LONG = (3, 6, 12, 24), (12, 24, 48, 72)
FACTORS, SPIKES = (5.0, 10.0, 0.2, 0.1), (0.5, 1.0, 2.0, 3.0, 4.0, 6.0)
MARGIN = 10


def unit(*of: Column) -> Column:
    """A number in [0, 1) that the columns decide."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in of)).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def pick(values: tuple, u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def point_anomalies(df: DataFrame, s: Series, seed: int = 0, every: int = 130, low: float = 3.0, high: float = 6.0) -> DataFrame:
    """df with `y` and `is_anomaly`: one row in `every` (at least one), away from the ends, moved by 3 to 6 deviations and floored at 0."""
    key = [F.col(c) for c in (*s.keys, s.order[-1])]
    out = over_key(df.withColumn("_i", F.row_number().over(s.window) - 1), s.keys, _n=F.count("*"), _sd=F.stddev_pop(s.value))
    inside = (F.col("_i") >= MARGIN) & (F.col("_i") < F.col("_n") - MARGIN)
    out = out.withColumns({"_u": F.when(inside, unit(F.lit(f"p{seed}"), *key)), "_v": unit(F.lit(f"q{seed}"), *key)})
    rank = F.row_number().over(Window.partitionBy(*s.keys).orderBy(F.asc_nulls_last("_u"), *s.order))
    hit = (rank <= F.greatest(F.lit(1), F.round(F.col("_n") / every))) & F.col("_u").isNotNull()
    out = out.withColumn("is_anomaly", hit)
    move = (F.when(F.col("_v") < 0.5, -1).otherwise(1)) * (low + (high - low) * F.pmod(F.col("_v") * 2, F.lit(1.0))) * F.col("_sd")
    return out.withColumn("y", F.when(F.col("is_anomaly"), F.greatest(F.lit(0.0), s.x + move)).otherwise(s.x)).drop("_i", "_n", "_sd", "_u", "_v")


def events(df: DataFrame, s: Series, per_family: int = 4, seed: int = 0) -> DataFrame:
    """Rows `keys, slot, start, duration, family, u, v`: slots of equal width, one event in each, so that none overlap. A series of fewer rows than slots has a slot a row."""
    count = F.least(F.lit(per_family * len(FAMILIES)), F.col("n"))
    spans = df.groupBy(*s.keys).agg(F.count("*").alias("n"))
    slots = spans.select(*s.keys, "n", count.alias("count"), F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("slot"))
    key = [F.col(c) for c in s.keys]
    draw = lambda tag: unit(F.lit(f"{tag}{seed}"), *key, F.col("slot"))
    width = F.floor(F.col("n") / F.col("count"))
    out = slots.withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES)), F.pmod(F.col("slot"), F.lit(len(FAMILIES))) + 1))
    long, single = F.col("family").isin("C_level_shift", "D_drift"), F.col("family").isin("A_spike", "B_mult", "G_missing_sentinel")
    duration = F.when(single, 1).when(long, pick(LONG, draw("d"))).otherwise(pick(SHORT, draw("d")))
    out = out.withColumns({"duration": F.least(duration, F.greatest(width - 1, F.lit(1))).cast("long"), "u": draw("u"), "v": draw("v")})
    start = F.col("slot") * width + F.floor(draw("s") * F.greatest(width - F.col("duration"), F.lit(1)))
    return out.withColumn("start", start.cast("long")).drop("n", "count")


def longest(family: str) -> int:
    """Rows that an event of the family may take."""
    return 1 if family in ("A_spike", "B_mult", "G_missing_sentinel") else max(LONG if family in ("C_level_shift", "D_drift") else SHORT)


def candidates_for(per_family: int, family: str, gap: int) -> int:
    """So many starts by drawn priority surely hold `per_family` that keep their distance, if the series does: an accepted start rules out less than two intervals of others."""
    return max(1, (per_family - 1) * (2 * (longest(family) + 2 * gap) - 1) + 1)


def reserved_events(df: DataFrame, s: Series, per_family: int = 4, gap: int = 6, seed: int = 0) -> DataFrame:
    """Rows `keys, slot, start, duration, family, u, v`: events at drawn places, no two nearer than the gap.

    Each family looks at its starts in a drawn order and takes one when its interval, of
    the family's longest duration and the gap on both sides, meets none that it has
    taken, until it has `per_family`. Then those go whose interval meets one that an earlier
    family keeps, so later families may get fewer. The order is that of hashes of key,
    family and place. Only a bounded number of starts can matter (candidates_for), and
    these alone reach the task of their series.
    """
    keys = [F.col(c) for c in s.keys]
    placed = df.select(*s.keys, (F.row_number().over(s.window) - 1).alias("start"), F.count("*").over(s.whole).alias("_n"))
    kinds = F.array(*(F.struct(F.lit(k).alias("_f"), F.lit(f).alias("family"), F.lit(longest(f)).alias("_long"), F.lit(candidates_for(per_family, f, gap)).alias("_most")) for k, f in enumerate(FAMILIES)))
    spread = placed.withColumn("_kind", F.explode(kinds)).select(*s.keys, "start", "_n", "_kind.*")
    spread = spread.filter((F.col("start") >= gap) & (F.col("start") < F.col("_n") - F.col("_long") - gap)).withColumn("_u", unit(F.lit(f"o{seed}"), *keys, F.col("family"), F.col("start")))
    rank = F.row_number().over(Window.partitionBy(*s.keys, "_f").orderBy("_u", "start"))
    few = spread.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_most")).filter(F.col("_rank") <= max(candidates_for(per_family, f, gap) for f in FAMILIES))

    def choose(rows: pa.Table) -> pa.Table:
        order = rows.sort_by([("_f", "ascending"), ("_rank", "ascending")])
        f, start = order["_f"].to_pylist(), order["start"].to_pylist()
        kept: list[tuple[int, int]] = []  # intervals of earlier families, gaps included
        chosen: list[int] = []
        for k, family in enumerate(FAMILIES):
            own: list[int] = []
            reach = longest(family) + 2 * gap
            for row in (i for i, x in enumerate(f) if x == k):
                if len(own) == per_family:
                    break
                if all(abs(start[row] - start[other]) >= reach for other in own):
                    own.append(row)
            free = [r for r in own if all(start[r] + longest(family) + gap <= lo or start[r] - gap >= hi for lo, hi in kept)]
            kept += [(start[r] - gap, start[r] + longest(family) + gap) for r in free]
            chosen += free
        return order.take(chosen).select([*s.keys, "_f", "_rank", "start", "family"])

    fields = [df.schema[c] for c in s.keys]
    schema = T.StructType([*fields, T.StructField("_f", T.IntegerType()), T.StructField("_rank", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("family", T.StringType())])
    taken = few.select(*s.keys, "_f", "_rank", "start", "family").groupBy(*s.keys).applyInArrow(choose, schema)
    draw = lambda tag: unit(F.lit(f"{tag}{seed}"), *keys, F.col("family"), F.col("start"))
    long, single = F.col("family").isin("C_level_shift", "D_drift"), F.col("family").isin("A_spike", "B_mult", "G_missing_sentinel")
    duration = F.when(single, 1).when(long, pick(LONG, draw("d"))).otherwise(pick(SHORT, draw("d"))).cast("long")
    # events are numbered along their series
    slot = F.row_number().over(Window.partitionBy(*s.keys).orderBy("start")) - 1
    return taken.select(*s.keys, slot.alias("slot"), F.col("start").cast("long").alias("start"), duration.alias("duration"), "family", draw("u").alias("u"), draw("v").alias("v"))


def injected(df: DataFrame, s: Series, drawn: DataFrame) -> DataFrame:
    """df with `y`, `class_int` (-1 untouched, 1 SUSPECT, 2 BAD) and `family`: events meet the rows of their spans."""
    rows = over_key(df.withColumn("_i", F.row_number().over(s.window) - 1), s.keys, _sd=F.stddev_pop(s.value))
    spans = drawn.withColumn("_i", F.explode(F.sequence("start", F.col("start") + F.col("duration") - 1))).withColumn("_j", F.col("_i") - F.col("start"))
    out = rows.join(spans.withColumnRenamed("_i", "_at"), [rows[k] == spans[k] for k in s.keys] + [rows["_i"] == F.col("_at")], "left").select(*(rows[c] for c in rows.columns), "family", "duration", "u", "v", "_j", "slot")
    sd, u, v, j = (F.col(c) for c in ("_sd", "u", "v", "_j"))
    sign = F.when(v < 0.5, -1.0).otherwise(1.0)
    severity = F.when(u < 0.5, 1.0 + 1.5 * F.pmod(u * 2, F.lit(1.0))).otherwise(3.0 + F.pmod(u * 2, F.lit(1.0)))
    spike, factor = pick(SPIKES, u), pick(FACTORS, u)
    drift = sign * severity * sd / F.greatest(F.lit(1), F.col("duration") - 1) * j
    noise = 0.5 + 2.0 * u
    first = F.when(j == 0, s.x)
    held = F.last(first, True).over(s.window.rowsBetween(-max(SHORT), 0))
    family = F.col("family")
    own = lambda tag: unit(F.lit(tag), *(F.col(k) for k in s.keys), F.col("slot"), j)
    floor0 = lambda c: F.greatest(F.lit(0.0), c)
    y = (
        F.when(family == "A_spike", floor0(s.x + sign * spike * sd))
        .when(family == "B_mult", s.x * factor)
        .when(family == "C_level_shift", floor0(s.x + sign * severity * sd))
        .when(family == "D_drift", floor0(s.x + drift))
        .when(family == "E_stuck", held)
        .when(family == "F_burst_noise", floor0(s.x + noise * sd * F.sqrt(-2 * F.ln(1 - own("f"))) * F.cos(6.283185307179586 * own("g"))))
        .when(family == "G_missing_sentinel", F.when(u < 1 / 3, None).when(u < 2 / 3, -999.0).otherwise(-0.1 - 0.9 * v))
        .otherwise(s.x)
    )
    bad = (
        F.when(family == "A_spike", spike >= 3)
        .when(family == "C_level_shift", severity >= 3)
        .when(family == "D_drift", F.abs(drift) >= 3 * sd)
        .when(family == "F_burst_noise", noise >= 1.5)
        .otherwise(F.lit(True))
    )
    label = F.when(family.isNull(), -1).when(bad, 2).otherwise(1)
    return out.select(*df.columns, y.alias("y"), label.alias("class_int"), F.coalesce(family, F.lit("")).alias("family"))


def weak_labels_v1(class_int: Column, in_range: Column, spike: Column, spike_p75: Column, spike_p90: Column, p: Column, gap: Column) -> tuple[Column, Column]:
    """(class, confidence) from a spike score and a tail probability for rows that no event touched."""
    untouched = class_int == -1
    good = F.coalesce(untouched & in_range & (spike < spike_p75) & (p > 0.10) & ~gap, F.lit(False))
    suspect = untouched & ~good & (F.coalesce(p < 0.05, F.lit(False)) | F.coalesce(spike > spike_p90, F.lit(False)) | gap)
    label = F.when(~untouched, class_int).when(suspect, 1).otherwise(0)
    confidence = F.when(~untouched, F.when(class_int == 2, 1.0).when(class_int == 1, 0.5).otherwise(0.0)).when(good, 1.0).otherwise(0.5)
    return label, confidence


def transfer_labels(class_int: Column) -> Column:
    """Labels of a station a model is carried to: rows that no event touched are GOOD, without weak labels."""
    return F.when(class_int == -1, 0).otherwise(class_int)


def weak_labels_v2(class_int: Column, in_range: Column, z: Column, gap: Column) -> tuple[Column, Column]:
    """(class, confidence): events are certain, quiet rows in range certainly good, others weakly labelled by z."""
    untouched = class_int == -1
    good = F.coalesce(untouched & in_range & (z < 1.5) & ~gap, F.lit(False))
    suspect = untouched & ~good & (F.coalesce(z >= 1.5, F.lit(False)) | gap)
    label = F.when(~untouched, class_int).when(suspect, 1).otherwise(0)
    return label, F.when(~untouched | good, 1.0).otherwise(0.5)
