"""Embedding near-dedup by cross-polytope hashing.

A vector is turned by random signs and fast Hadamard transforms, three times each; the
coordinate of largest magnitude, with its sign, is the hash. A table's bucket joins
several such hashes. Every vector lives in one bucket of each table and also visits the
buckets that a near neighbour would most likely live in. Pairs that meet are verified
by their cosine in double precision. Whatever the number of joined hashes, there are
as many tables as it takes for a pair at the least cosine to be missed by all of them
with a probability of MISS at most; how many hashes are joined only weighs rows moved
against pairs compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maregraph.llm.common import looked_up, persisted, salts_for, with_totals
from maregraph.llm.components import connected_components

#: Tables at least, buckets visited beside the own one, least cosine of a link.
TABLES, VISITS, COSINE = 2, 2, 0.9
#: Most probable share of the pairs at the least cosine that meet in no table, for any number of vectors.
MISS = 0.005
#: Rows of a bucket that are compared with as many others in one block, rows of a block compared at once, bytes of a call, all about.
BLOCK, TILE, CALL_BYTES = 2048, 256, 8 << 20
#: What a row moved to a bucket costs, in compared pairs of 64 places.
ROW_PAIRS = 2000

def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix of their length (a power of two), not scaled."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d)


def bucket_keys(x: np.ndarray, tables: int, hashes: int, visits: int, seed: int = 11) -> np.ndarray:
    """Bucket numbers, shape rows x tables x (1 + visits): the own bucket, then the likeliest others."""
    n, d0 = x.shape
    d = 1 << max(1, (d0 - 1).bit_length())
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, d))
    padded = np.zeros((n, d))
    padded[:, :d0] = x
    out = np.empty((n, tables, 1 + visits), np.int64)
    depth = min(d - 1, visits)
    for t in range(tables):
        own, moves, losses = np.zeros(n, np.int64), [], []
        for k in range(hashes):
            y = padded
            for s in signs[t, k]:
                y = hadamard(y * s) / math.sqrt(d)
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, : depth + 1]
            rows = np.arange(n)[:, None]
            code = 2 * top + (y[rows, top] < 0)
            height = size[rows, top]
            base = (2 * d) ** k
            own += code[:, 0] * base
            moves.append((code[:, 1:] - code[:, :1]) * base)
            losses.append((height[:, :1] - height[:, 1:]) ** 2)
        move, loss = np.concatenate(moves, axis=1), np.concatenate(losses, axis=1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :visits]
        out[:, t, 0] = own
        out[:, t, 1 : 1 + best.shape[1]] = own[:, None] + np.take_along_axis(move, best, 1)
        out[:, t, 1 + best.shape[1] :] = own[:, None]
    return out


def _met(keys_a: np.ndarray, keys_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs, by table: whether they meet, and the smallest bucket where they do (one of them at home there)."""
    home_a, home_b = keys_a[:, :, :1], keys_b[:, :, :1]
    at_a, at_b = (keys_b == home_a).any(axis=2), (keys_a == home_b).any(axis=2)
    far = np.iinfo(np.int64).max
    return at_a | at_b, np.minimum(np.where(at_a, home_a[:, :, 0], far), np.where(at_b, home_b[:, :, 0], far))


def pairs_at(cosine: float, n: int, width: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of unit vectors at just this cosine, in directions drawn evenly."""
    a, b = np.random.default_rng(seed).standard_normal((2, n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * b


@lru_cache(maxsize=64)
def tables_needed(width: int, hashes: int, visits: int, cosine: float, miss: float = MISS) -> float:
    """Tables in which pairs at `cosine` all fail to meet with a probability of `miss` at most; infinite if none will do.

    Tables are drawn apart, so it follows from the share of pairs that meet in one, here
    of drawn pairs in 32 tables of other seeds, less two standard errors.
    """
    width = max(2, width)
    n, drawn = max(64, min(512, (1 << 17) // width)), 32
    a, b = pairs_at(cosine, n, width)
    met = _met(bucket_keys(a, drawn, hashes, visits, seed=12), bucket_keys(b, drawn, hashes, visits, seed=12))[0].mean()
    least = met - 2 * math.sqrt(met * (1 - met) / (n * drawn))
    return math.inf if least <= 0 else 1 if least >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - least)))


def hashes_and_tables(n: int, width: int, tables: int, visits: int, cosine: float, hashes: int | None = None) -> tuple[int, int]:
    """Joined hashes for n vectors (or as given) and tables, `tables` at least, that keep to MISS: of all numbers of hashes, the cheapest by rows moved and pairs compared."""
    d = 1 << max(1, (width - 1).bit_length())
    plans = []
    for h in [hashes] if hashes else range(1, int(62 / math.log2(2 * d)) + 1):
        need = tables_needed(width, h, visits, min(cosine, 1.0))
        if need < math.inf:
            rows = max(tables, int(need)) * (1 + visits)
            plans.append((rows * (ROW_PAIRS + (1 + visits) * n / (2 * d) ** h * max(1, d / 64)), h, max(tables, int(need))))
        if need == math.inf or n <= (2 * d) ** h:
            break  # more hashes only empty the buckets
    if not plans:
        raise ValueError(f"pairs at a cosine of {cosine} are too far apart to meet by hashes")
    return min(plans)[1:]


def code_type(width: int, hashes: int) -> str:
    """The narrowest whole number that holds every bucket number."""
    bits = hashes * math.log2(2 << max(1, (width - 1).bit_length()))
    return "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<i8"


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least row of each row's component so far, by row) after links a-b."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        least = np.minimum(x, y)
        np.minimum.at(labels, x, least)
        np.minimum.at(labels, y, least)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, visits: int = VISITS, id_col: str = "vec_id", vector_col: str = "embedding", hashes: int | None = None) -> DataFrame:
    """Rows `vec_id, n_links, component_id, kept`, one for each row of vectors.

    Two vectors link if they meet in a bucket and their cosine is `cosine` or more; a
    pair at just `cosine` meets in none with a probability of MISS at most. `tables` is
    the least number of tables, `hashes` (by default chosen by what it costs) that of
    joined hashes. Identical vectors always link: they are one class while others are
    sought, and repeated rows count as other vectors, also those that repeat an id with another vector. Null and zero vectors, vectors
    with null or non-finite components and rows with a null id link with nothing.
    Vectors of unlike lengths are never compared; of any length they are read whole. An
    empty table gives no rows; other columns are ignored; ids are cast to long. A bucket
    of any size is dealt into blocks, and a pair that meets several times counts in the
    first place only.
    """
    double = isinstance(vectors.schema[vector_col].dataType.elementType, T.DoubleType)
    kind = "<f8" if double else "<f4"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = raw = None
                if i is not None and v and None not in v:
                    x = np.array(v, kind) + 0  # -0.0 is 0.0
                    wide = x.astype(np.float64)
                    if np.isfinite(wide).all() and wide.any():
                        raw = x.tobytes()
                        key = hashlib.blake2b(raw, digest_size=16).digest()
                keys.append(key)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "key", "raw"])

    rows = persisted(vectors.select(id_col, vector_col).mapInArrow(read, "vec_id long, key binary, raw binary"), "vectors")
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.min("raw").alias("raw"))
    # a number of its own for each class, fixed once written: ids may repeat with other vectors
    classes = persisted(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    size = int(kind[2])
    n, widest, held = classes.agg(F.count("*"), F.max(F.length("raw")), F.coalesce(F.sum(F.length("raw")), F.lit(0))).first()
    hashes, tables = hashes_and_tables(n, max(1, (widest or 0) // size), tables, visits, cosine, hashes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, m, raw = (batch.column(i) for i in range(3))
            widths = np.array([len(r) for r in raw.to_pylist()], np.int64)
            for width in np.unique(widths):
                own = pa.array(np.flatnonzero(widths == width))
                x = np.frombuffer(b"".join(raw.take(own).to_pylist()), kind).reshape(len(own), -1).astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                keys = bucket_keys(x, tables, hashes, visits).astype(code_type(int(width) // size, hashes))
                yield pa.RecordBatch.from_arrays([rep.take(own), m.take(own), raw.take(own), pa.array([k.tobytes() for k in keys], pa.binary())], ["rep", "m", "raw", "keys"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, widths, packed = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                keys = np.frombuffer(b"".join(packed[i] for i in own.tolist()), code_type(int(width) // size, hashes)).reshape(len(own), tables, 1 + visits).astype(np.int64)
                for t in range(tables):
                    at, place = np.nonzero(np.concatenate([np.ones((len(own), 1), bool), keys[:, t, 1:] != keys[:, t, :1]], axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), width)), pa.array(np.full(len(at), t, np.int32)), pa.array(keys[at, t, place]), pa.array(place == 0), rep.take(pa.array(own[at]))], ["width", "t", "bucket", "home", "rep"])

    signed = persisted(classes.select("rep", "m", "raw").mapInArrow(sign, "rep long, m long, raw binary, keys binary"), "signed-vectors")
    place = ["width", "t", "bucket"]
    visits_ = signed.select("rep", F.length("raw").cast("long").alias("width"), "keys").mapInArrow(visit, "width long, t int, bucket long, home boolean, rep long")
    sizes = visits_.groupBy(*place).agg(F.count("*").alias("c"), F.max("home").alias("lived_in")).filter("c > 1 and lived_in").drop("lived_in")
    # only ids meet by bucket; the vectors go to the blocks once
    blocks = F.ceil(F.col("c") / BLOCK)
    met = looked_up(visits_, place, sizes, "rep", salts_for(n)).withColumn("own", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = met.select(*place, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "home", "rep")
    calls = 1 + tables * (1 + visits) * held // CALL_BYTES
    spread = met.join(signed, "rep").withColumn("call", F.pmod(F.xxhash64(*place, "i", "j"), F.lit(calls)))

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in (*place, "i", "j", "rep")])
        width, t, bucket, i, j, own, home, rep, m = (group[c].to_numpy() for c in (*place, "i", "j", "own", "home", "rep", "m"))
        tags = np.stack([width, t, bucket, i, j], axis=1)
        cuts = np.concatenate([[0], 1 + np.flatnonzero((tags[1:] != tags[:-1]).any(axis=1)), [len(tags)]]) if len(tags) else np.zeros(1, int)
        nodes, counts, a_out, b_out = [], [], [], []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo < 2 or not home[lo:hi].any():
                continue
            x = np.frombuffer(b"".join(group["raw"][lo:hi].to_pylist()), kind).reshape(hi - lo, -1).astype(np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            seen = np.frombuffer(b"".join(group["keys"][lo:hi].to_pylist()), code_type(int(width[lo]) // size, hashes)).reshape(hi - lo, tables, 1 + visits).astype(np.int64)
            add, labels = np.zeros(hi - lo), np.arange(hi - lo)
            for begin in range(0, hi - lo, TILE):
                a, b = np.nonzero(np.triu(x[begin : begin + TILE] @ x[begin:].T >= cosine, 1))
                a, b = a + begin, b + begin
                if i[lo] != j[lo]:
                    across = own[lo + a] != own[lo + b]  # pairs of one block have a block pair of their own
                    a, b = a[across], b[across]
                labels = _join(labels, a, b)
                for at in range(0, len(a), 20_000):
                    p, q = a[at : at + 20_000], b[at : at + 20_000]
                    meet, where = _met(seen[p], seen[q])
                    first = meet.argmax(axis=1)
                    here = meet.any(axis=1) & (first == t[lo]) & (where[np.arange(len(first)), first] == bucket[lo])
                    add += np.bincount(p[here], m[lo + q[here]], hi - lo) + np.bincount(q[here], m[lo + p[here]], hi - lo)
            some, led = np.flatnonzero(add), np.flatnonzero(labels != np.arange(hi - lo))
            nodes += rep[lo + some].tolist()
            counts += add[some].astype(np.int64).tolist()
            a_out += rep[lo + led].tolist()
            b_out += rep[lo + labels[led]].tolist()
        return pa.table({"a": pa.array(nodes + a_out, pa.int64()), "b": pa.array([None] * len(nodes) + b_out, pa.int64()), "n": pa.array(counts + [None] * len(a_out), pa.int64())})

    found = persisted(spread.groupBy("call").applyInArrow(verify, "a long, b long, n long"), "verified")
    links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("far"))
    roots = connected_components(found.filter("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "root")
    rooted = persisted(classes.select("key", "rep", "least", "m").join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "rooted")
    known = with_totals(rooted, ["root"], component=F.min("least"))
    out = looked_up(rows.select("vec_id", "key"), ["key"], known, "vec_id", salts_for(n), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("m") - 1 + F.coalesce("far", F.lit(0)), F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
