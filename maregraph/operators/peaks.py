"""Peaks of series of any length: high, far apart and prominent, found chunk by chunk.

A series is cut into chunks of rows. Plateaus at the borders of chunks are put together
from the chunks' first and last runs; suppression by taller peaks goes in rounds, each of
which settles all that doesn't wait for a neighbouring chunk; prominences go from chunk to
chunk by the chunks' extremes, and only to the chunk in which a higher row ends them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maregraph.functions.scalar import clean
from maregraph.operators.chunked import chunked
from maregraph.operators.series import Series
from maregraph.operators.work import stored


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal values."""
    edges = np.flatnonzero(x[1:] != x[:-1])
    return np.concatenate([[0], edges + 1]), np.concatenate([edges, [len(x) - 1]])


def walk_left(low: np.ndarray, high: np.ndarray, at: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each place `at` (not included) to the left while `high` is at most v: the place that stops it (-1: none) and the least `low` on the way (inf: none).

    Strides are powers of two with their extremes, so a walk takes as many looks as its
    length has bits.
    """
    place, least = at.copy(), np.full(len(at), np.inf)
    if not len(low):
        return place - 1, least
    levels, step = [(low, high)], 1
    while 2 * step <= len(low):
        a, b = levels[-1]
        levels.append((np.minimum(a[:-step], a[step:]), np.maximum(b[:-step], b[step:])))
        step *= 2
    for a, b in reversed(levels):
        to = np.maximum(place - step, 0)
        can = (place >= step) & (b[np.minimum(to, len(b) - 1)] <= v)
        least = np.where(can, np.minimum(least, a[np.minimum(to, len(a) - 1)]), least)
        place = np.where(can, to, place)
        step //= 2
    return place - 1, least


def settled(place: np.ndarray, height: np.ndarray, own: np.ndarray, state: np.ndarray, distance: int) -> np.ndarray:
    """States (0 open, 1 stays, 2 goes) after all that can be told here: a peak stays when all higher ones nearer than `distance` go, and goes when one stays. Later places win ties. Those that aren't `own` are settled elsewhere."""
    state, order = state.copy(), np.argsort(place, kind="stable")
    where = place[order]
    for k in np.lexsort((place, height))[::-1].tolist():
        if state[k] or not own[k]:
            continue
        near = order[np.searchsorted(where, place[k] - distance, "right") : np.searchsorted(where, place[k] + distance, "left")]
        if (state[near] == 1).any():
            state[k] = 2
            continue
        higher = near[(height[near] > height[k]) | ((height[near] == height[k]) & (place[near] > place[k]))]
        if (state[higher] == 2).all():
            state[k] = 1
    return state


def peaks(df: DataFrame, s: Series, value: str, height: float = 1.0, distance: int = 50, prominence: float = 1.0, sides: tuple[int, ...] = (1, -1), rows: int = 100_000, bucket: Column | None = None) -> DataFrame:
    """Rows `keys, order, peak, side` of the peaks of value (side 1) and of -value (side -1).

    A peak is a run of equal values (its middle row, the earlier of two) between lower
    ones, of `height` at least. Of peaks fewer than `distance` rows apart the highest
    stays, of equal ones the last; then those go that don't stand `prominence` above the
    higher of the two lowest points between them and the next higher rows (or ends).
    Nulls and infinities count as 0. Series of any length: a task holds `rows` rows; what
    waits for other chunks is told by border runs, open peaks and chunk extremes.
    """
    kept = [*dict.fromkeys([*s.keys, *s.order])]
    spread = df.select(*kept, F.coalesce(clean(F.col(value).cast("double")), F.lit(0.0)).alias("_v"), F.explode(F.array(*map(F.lit, sides))).alias("side")).withColumn("_v", F.col("_v") * F.col("side"))
    series = Series((*s.keys, "side"), s.order, "_v")
    ranked = stored(chunked(spread, series, rows, bucket).select("*", F.row_number().over(Series((*series.keys, "_chunk"), s.order, "_v").window).alias("_i")).withColumn("_i", F.col("_chunk") * rows + F.col("_i") - 1), "chunks")
    keys, group = [*series.keys], [*series.keys, "_chunk"]
    fields = [ranked.schema[c] for c in keys]
    of = lambda *more: T.StructType([*fields, *(T.StructField(c, {"_chunk": T.LongType(), "_i": T.LongType(), "side_": T.IntegerType()}.get(c, T.DoubleType())) for c in more)])

    def head(table: pa.Table, n: int, columns: list[str]) -> dict:
        return {c: table[c].take(pa.array(np.zeros(n, np.int64))) for c in columns}

    # places of runs: inside a chunk they are told as peaks (`_from` null), at its borders as runs
    def found(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("_i")
        x, i = chunk["_v"].to_numpy(), chunk["_i"].to_numpy()
        begin, end = runs_of(x)
        v = x[begin]
        inner = np.zeros(len(v), bool)
        inner[1:-1] = True
        top = np.flatnonzero(inner & (v > np.concatenate([[np.inf], v[:-1]])) & (v > np.concatenate([v[1:], [np.inf]])) & (v >= height))
        border = np.unique([0, len(v) - 1])
        n = len(top) + len(border)
        none = [None] * len(top)
        columns = {"_i": np.concatenate([i[(begin[top] + end[top]) // 2], i[end[border]]]), "_v": np.concatenate([v[top], v[border]])}
        left, right = ([None if not 0 <= k + d < len(v) else float(v[k + d]) for k in border.tolist()] for d in (-1, 1))
        return pa.table(head(chunk, n, keys) | {c: pa.array(a) for c, a in columns.items()} | {"_from": pa.array(none + i[begin[border]].astype(float).tolist(), pa.float64()), "_left": pa.array(none + left, pa.float64()), "_right": pa.array(none + right, pa.float64())})

    seen = stored(ranked.groupBy(*group).applyInArrow(found, of("_i", "_v", "_from", "_left", "_right")), "runs")

    def across(borders: pa.Table) -> pa.Table:
        """Border runs of a series, two a chunk, put together where they go on."""
        whole: list[list] = []
        for r in borders.sort_by([("_i", "ascending"), ("_from", "ascending")]).to_pylist():
            if whole and whole[-1][1] == r["_i"]:
                continue  # a chunk of one run
            if whole and whole[-1][1] + 1 == r["_from"] and whole[-1][2] == r["_v"]:
                whole[-1][1], whole[-1][4] = r["_i"], r["_right"]
                continue
            if whole and whole[-1][1] + 1 == r["_from"]:
                whole[-1][4] = r["_v"]
                r["_left"] = whole[-1][2]
            whole.append([int(r["_from"]), r["_i"], r["_v"], r["_left"], r["_right"]])
        top = [((a + b) // 2, v) for a, b, v, left, right in whole if left is not None and right is not None and left < v > right and v >= height]
        return pa.table(head(borders, len(top), keys) | {"_i": pa.array([i for i, _ in top], pa.int64()), "_v": pa.array([v for _, v in top], pa.float64())})

    tops = seen.filter("_from is null").select(*keys, "_i", "_v").union(seen.filter("_from is not null").groupBy(*keys).applyInArrow(across, of("_i", "_v")))
    state = stored(tops.withColumns({"_chunk": F.floor(F.col("_i") / rows), "_state": F.lit(0)}), "tops")

    def settle(near: pa.Table) -> pa.Table:
        own = np.array(near["_chunk"].to_numpy() == near["_home"].to_numpy())
        told = settled(near["_i"].to_numpy(), near["_v"].to_numpy(), own, near["_state"].to_numpy().astype(np.int32), distance)
        mine = near.select([*keys, "_i", "_v", "_home"]).append_column("_state", pa.array(told)).filter(pa.array(own))
        return mine.rename_columns([*keys, "_i", "_v", "_chunk", "_state"])

    schema = T.StructType([*of("_i", "_v", "_chunk").fields, T.StructField("_state", T.IntegerType())])
    while not state.filter("_state = 0").isEmpty():
        reach = F.sequence(F.greatest(F.floor((F.col("_i") - distance + 1) / rows), F.lit(0).cast("long")), F.floor((F.col("_i") + distance - 1) / rows))
        spread = state.withColumn("_home", F.col("_chunk")).withColumn("_chunk", F.explode(reach))
        state = stored(spread.groupBy(*group).applyInArrow(settle, schema), "tops")
    tall = state.filter("_state = 1").drop("_state")

    # lowest points on both sides, in the peak's own chunk; a side that meets no higher row there asks on
    def inside(chunk: pa.Table, mine: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("_i")
        x, i, at = chunk["_v"].to_numpy(), mine["_i"].to_numpy(), mine["_i"].to_numpy() - (chunk["_i"][0].as_py() if chunk.num_rows else 0)
        v, n = mine["_v"].to_numpy(), len(x)
        stop, left = walk_left(x, x, at, v)
        stop_, right = walk_left(x[::-1], x[::-1], n - 1 - at, v)
        columns = {"_i": i, "_v": v, "_chunk": mine["_chunk"].to_numpy(), "_left": np.minimum(left, v), "_right": np.minimum(right, v), "_open_left": (stop < 0).astype(float), "_open_right": (stop_ < 0).astype(float)}
        return pa.table({c: mine[c] for c in keys} | {c: pa.array(a) for c, a in columns.items()})

    sided = of("_i", "_v", "_chunk", "_left", "_right", "_open_left", "_open_right")
    lows = stored(ranked.groupBy(*group).cogroup(tall.groupBy(*group)).applyInArrow(inside, sided), "lows")
    extremes = ranked.groupBy(*group).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    asks = [lows.filter(f"_open_{side} = 1").select(*keys, "_chunk", "_i", "_v", F.lit(d).alias("_way")) for side, d in (("left", -1), ("right", 1))]

    def between(chunks: pa.Table, asking: pa.Table) -> pa.Table:
        """How far each ask goes on over whole chunks of its series, and the chunk that ends it (-1: none)."""
        chunks = chunks.sort_by("_chunk")
        low, high, first = chunks["_low"].to_numpy(), chunks["_high"].to_numpy(), chunks["_chunk"][0].as_py() if chunks.num_rows else 0
        at, v, way = asking["_chunk"].to_numpy() - first, asking["_v"].to_numpy(), asking["_way"].to_numpy()
        to, least = walk_left(low, high, at, v)
        to_, least_ = walk_left(low[::-1], high[::-1], len(low) - 1 - at, v)
        target = np.where(way < 0, to + np.where(to < 0, 0, first), np.where(to_ < 0, -1, len(low) - 1 - to_ + first))
        return pa.table({c: asking[c] for c in keys} | {"_i": asking["_i"], "_v": asking["_v"], "_way": pa.array(way.astype(float)), "_chunk": pa.array(target), "_least": pa.array(np.where(way < 0, least, least_))})

    gone = stored(extremes.groupBy(*keys).cogroup(asks[0].union(asks[1]).groupBy(*keys)).applyInArrow(between, of("_i", "_v", "_way", "_chunk", "_least")), "asks")

    def ended(chunk: pa.Table, asking: pa.Table) -> pa.Table:
        """The rest of a walk, inside the chunk that holds a higher row."""
        x, v, way = chunk.sort_by("_i")["_v"].to_numpy(), asking["_v"].to_numpy(), asking["_way"].to_numpy()
        far = np.full(len(v), len(x))
        least = np.where(way < 0, walk_left(x, x, far, v)[1], walk_left(x[::-1], x[::-1], far, v)[1]) if len(x) else np.zeros(0)
        return pa.table({c: asking[c] for c in keys} | {c: asking[c] for c in ("_i", "_way")} | {"_least": pa.array(np.minimum(least, asking["_least"].to_numpy()))})

    last = ranked.groupBy(*group).cogroup(gone.filter("_chunk >= 0").groupBy(*group)).applyInArrow(ended, of("_i", "_way", "_least"))
    rest = last.union(gone.filter("_chunk < 0").select(*keys, "_i", "_way", "_least")).groupBy(*keys, "_i")
    rest = rest.agg(*(F.min(F.when(F.col("_way") == d, F.col("_least"))).alias(f"_{side}_on") for side, d in (("left", -1), ("right", 1))))
    place = [*keys, "_i"]
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in place]
    wide = lows.join(rest, same(lows, rest), "left").select(*(lows[c] for c in [*place, "_v"]), F.least("_left", F.coalesce("_left_on", "_left")).alias("_l"), F.least("_right", F.coalesce("_right_on", "_right")).alias("_r"))
    chosen = wide.filter(F.col("_v") - F.greatest("_l", "_r") >= prominence)
    named = ranked.select(*kept, "side", "_i")
    return named.join(chosen, same(named, chosen)).select(*(named[c] for c in kept), (chosen["_v"] * chosen["side"]).alias("peak"), chosen["side"])
