"""Hard negatives by block products over two dimensions, in the manner of SUMMA.

Rows are sharded into blocks, anchors into blocks of their own, and the vectors of both
into chunks of dimensions. The chunks of a pair of blocks meet in a shuffle; their
products, partial tiles of scores, are added where the tile stays, and each finished tile
is reduced to the few rows that its anchors may want, so only vectors and candidates move
and no tile does. The first pass multiplies rows that share a label and finds positives,
the second all rows and finds negatives inside each positive's window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maregraph.llm.common import persisted

#: Rows to a block at least, blocks of rows at most as long as CELLS allows, and dimensions to a chunk.
BLOCK, BLOCKS, DIMS = 4096, 32, 32

#: Components to a block of rows at most (half as many to one of anchors), and scores to a tile: 16 MB.
CELLS, TILE = 1 << 23, 1 << 21

#: Widths in which stored blocks are sent.
KINDS = (np.int8, np.int16, np.int32, np.int64)


def narrow(x: np.ndarray) -> tuple[str, bytes]:
    """The name of the narrowest type that holds x, and its bytes."""
    lo, hi = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in KINDS if np.iinfo(k).min <= lo and hi <= np.iinfo(k).max)
    return np.dtype(kind).str, x.astype(kind).tobytes()


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T in int64. Through doubles where every sum is below 2^53, so exact."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * x.shape[1]
    if most < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * score <= 100 * s <= high * score, both ends included."""
    return -((-low * score) // 100), (high * score) // 100


def best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of `at` with the highest scores, ties by place."""
    if len(at) > k:
        s = scores[at]
        at = at[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return at[np.argsort(-scores[at], kind="stable")[:k]]


def usable(vectors: DataFrame, anchors: Column, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """Rows `vec_id, label, vector, anchor` that take part, one for each id."""
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"), finite.alias("ok"))
    rows = rows.filter(F.col("ok") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector", "anchor")).alias("row")).select("vec_id", "row.*")


def block_sizes(n: int, width: int) -> tuple[int, int]:
    """Rows and anchors to a block. A row moves once for each block of anchors, an anchor once for each of rows: n rows have BLOCKS blocks until these are as large as a task should hold."""
    most = max(1, CELLS // width)
    return min(most, max(BLOCK, -(-n // BLOCKS))), max(1, most // 2)


def blocks(rows: DataFrame, count: int, scale: float, width: int, dims: int) -> DataFrame:
    """Rows `at, k, ids, labels, kind, cells`: one chunk of one of `count` blocks, its rows by id. Rows are dealt by the hash of their ids, so neither a hot label nor a hot vector is a hot block."""
    chunks = -(-width // dims) or 1
    limit = isqrt(((1 << 63) - 1) // max(1, width))
    cut = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda k: F.slice(F.col("vector"), k * dims + 1, F.lit(dims)))
    spread = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias("at"), "vec_id", "label", F.posexplode(cut).alias("k", "part"))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        part = rows["part"].combine_chunks()
        lens = np.diff(part.offsets.to_numpy())
        cells = np.zeros((rows.num_rows, dims))
        cells[np.arange(dims) < lens[:, None]] = part.flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(scale * cells), -limit, limit).astype(np.int64)
        kind, data = narrow(np.clip(whole, -limit, limit))
        ids, labels = (rows[c].to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label"))
        return pa.table({"at": rows["at"][:1], "k": rows["k"][:1], "ids": [ids], "labels": [labels], "kind": [kind], "cells": [data]})

    return spread.groupBy("at", "k").applyInArrow(pack, "at int, k int, ids binary, labels binary, kind string, cells binary")


class Pair:
    """A block of anchors and one of rows, with what the anchors ask for."""

    def __init__(self, left: pa.Table, right: pa.Table, dims: int) -> None:
        left, right = left.sort_by("k"), right.sort_by("k")
        self.ids, self.labels, self.owners, self.positives, self.window = (np.frombuffer(left[c][0].as_py() or b"", np.int64) for c in ("ids", "labels", "owners", "positives", "scores"))
        self.rows, self.row_labels = (np.frombuffer(right[c][0].as_py(), np.int64) for c in ("ids", "labels"))
        matrices = lambda side: [np.frombuffer(x.as_buffer(), kind.as_py()).reshape(-1, dims).astype(np.int64) for x, kind in zip(side["cells"], side["kind"], strict=True)]
        self.chunks = list(zip(matrices(left), matrices(right), strict=True))

    def tiles(self, alike: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of anchors, places of rows and their scores, TILE at a time (an anchor at least): of all rows, or of those that share the anchors' label. A tile is the sum of its chunks' partial tiles."""
        groups = [(np.arange(len(self.ids)), np.arange(len(self.rows)))]
        if alike:
            sides = [(np.argsort(x, kind="stable"), np.sort(x)) for x in (self.labels, self.row_labels)]
            groups = [tuple(at[np.searchsorted(x, v) : np.searchsorted(x, v, "right")] for at, x in sides) for v in np.intersect1d(self.labels, self.row_labels)]
        for anchors, rows in groups:
            chunks = [(x, y if len(rows) == len(y) else y[rows]) for x, y in self.chunks]
            step = max(1, TILE // len(rows))
            for at in range(0, len(anchors), step):
                some = anchors[at : at + step]
                yield some, rows, sum(product(x[some], y) for x, y in chunks)


def met(left: DataFrame, right: DataFrame, dims: int, reduce: Callable[[Pair], pa.Table], schema: str) -> DataFrame:
    """`reduce` of every Pair: rows of left carry `i` and the blocks `to` of the other side, those of right `j` and `to`. What describes a block goes with chunk 0."""
    told = ("ids", "labels", "owners", "positives", "scores")
    only = lambda c: F.when(F.col("k") == 0, F.col(c)).alias(c)
    a = left.select("i", "k", "kind", "cells", *map(only, told), F.explode("to").alias("j"))
    b = right.select("j", "k", "kind", "cells", only("ids"), only("labels"), F.explode("to").alias("i"))
    empty = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(", ")]).empty_table()

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return reduce(Pair(left, right, dims)) if left.num_rows and right.num_rows else empty

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(one, schema)


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: float = 256.0,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int | None = None, anchor_block: int | None = None, dims: int = DIMS,
) -> DataFrame:
    """Rows `anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    A score is the inner product of components floor(scale * x). An anchor's positives
    are its `positives` best other rows of its label, its negatives for each the
    `negatives` best rows of other labels whose scores are from `low` to `high` per cent
    of the positive's; ties go to the smaller id. Rows whose id or label is null, or
    whose vector is null or holds null or non-finite components, take no part. Of rows
    that share an id the least by label, then vector, does. Shorter vectors count as
    followed by zeros; components are cut to what keeps sums of products within 64 bits.
    An empty table, or one without anchors, gives no rows; other columns are ignored.

    Labels are whole numbers (`label`, by default the column of that name). The score
    matrix, anchors times rows, is the work; a task holds one pair of blocks (`block` rows
    and `anchor_block` anchors on average, by default block_sizes()) and one tile of their
    scores, and its anchors' candidates go on.
    """
    rows = persisted(usable(vectors, anchors, id_col, vector_col, F.col("label") if label is None else label), "vectors")
    n, m, width = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("vector"))).first()
    width = max(1, width or 0)
    usual = block_sizes(n, width)
    side, anchor_side = -(-n // (block or usual[0])) or 1, -(-m // (anchor_block or usual[1])) or 1
    every = lambda k: F.sequence(F.lit(0), F.lit(k - 1))
    all_rows = persisted(blocks(rows, side, scale, width, dims), "row-blocks").withColumnRenamed("at", "j").withColumn("to", every(anchor_side))
    asking = persisted(blocks(rows.filter("anchor"), anchor_side, scale, width, dims), "anchor-blocks").withColumnRenamed("at", "i").withColumn("to", every(side))

    def listed(found: list[tuple], *names: str) -> pa.Table:
        columns = zip(*found, strict=True) if found else [()] * len(names)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, columns, strict=True)})

    def nearest(pair: Pair) -> pa.Table:
        found = []
        for anchors, rows, scores in pair.tiles(alike=True):
            ids = pair.rows[rows]
            for own, s in zip(pair.ids[anchors].tolist(), scores, strict=True):
                at = best(s, np.flatnonzero(ids != own), positives)
                found += [(own, p, x) for p, x in zip(ids[at].tolist(), s[at].tolist(), strict=True)]
        return listed(found, "anchor_id", "positive_id", "positive_score")

    nothing = {c: F.lit(None).cast("binary") for c in ("owners", "positives", "scores")}
    near = met(asking.withColumns(nothing), all_rows, dims, nearest, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = persisted(near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= positives).drop("r"), "positives")

    def windows(found: pa.Table) -> pa.Table:
        sent = {to: [found[c].to_numpy().astype(np.int64).tobytes()] for to, c in (("owners", "anchor_id"), ("positives", "positive_id"), ("scores", "positive_score"))}
        return pa.table({"i": found["i"][:1], **sent})

    def hardest(pair: Pair) -> pa.Table:
        found, asked = [], {}
        for own, positive, score in zip(pair.owners.tolist(), pair.positives.tolist(), pair.window.tolist(), strict=True):
            lo, hi = window_of(score, low, high)
            if lo <= hi:
                asked.setdefault(own, []).append((positive, score, lo, hi))
        for anchors, _, scores in pair.tiles(alike=False):
            for a, s in zip(anchors.tolist(), scores, strict=True):
                own = int(pair.ids[a])
                if own not in asked:
                    continue
                inside = np.flatnonzero((s >= min(w[2] for w in asked[own])) & (s <= max(w[3] for w in asked[own])) & (pair.row_labels != pair.labels[a]))
                t = s[inside]
                for positive, score, lo, hi in asked[own]:
                    at = best(s, inside[(t >= lo) & (t <= hi)], negatives)
                    found += [(own, positive, v, score, x) for v, x in zip(pair.rows[at].tolist(), s[at].tolist(), strict=True)]
        return listed(found, "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")

    numbered = chosen.withColumn("i", F.pmod(F.xxhash64("anchor_id"), F.lit(anchor_side)).cast("int"))
    asked = asking.join(numbered.groupBy("i").applyInArrow(windows, "i int, owners binary, positives binary, scores binary"), "i")
    hard = met(asked, all_rows, dims, hardest, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
