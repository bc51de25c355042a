"""Small classifier nets, trained by gradients that Spark sums, for one model or for all folds side by side, and stored as pipeline stages."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maregraph.functions.scalar import ordinal_decision, ordinal_probabilities
from maregraph.operators.models import TAUS
from maregraph.operators.quantiles import exact_quantiles
from maregraph.operators.work import stored

#: Widths of the hidden layers, rows to a shard, rows whose layers are held at once, sums that reach the driver in a step, files of shards for each core.
HIDDEN, SHARD, STRETCH, SUMS, FILES = (64, 32), 4096, 256, 16, 4


class Room:
    """Arrays that are written again for every stretch of rows. Fresh ones of this size would be taken from the system and given back each time, which costs more than the sums."""

    def __init__(self) -> None:
        self.held: dict = {}

    def __call__(self, name: tuple, shape: tuple[int, ...], kind: type = np.float64) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, kind)
        return self.held[name][:size].reshape(shape)


@dataclass
class Net:
    """Dense layers for F models at once: arrays (F, inputs, outputs) and (F, outputs). kind: `ordinal` (two sigmoids) or `softmax` (three classes)."""

    kind: str
    layers: list[np.ndarray]

    @classmethod
    def drawn(cls, kind: str, inputs: int, models: int = 1, hidden: tuple[int, ...] = HIDDEN, seed: int = 1) -> Net:
        """The same first weights for every model."""
        rng = np.random.default_rng(seed)
        sizes = [inputs, *hidden, 2 if kind == "ordinal" else 3]
        layers: list[np.ndarray] = []
        for a, b in zip(sizes, sizes[1:], strict=False):
            layers += [np.repeat(rng.normal(0, (2 / a) ** 0.5, (1, a, b)), models, axis=0), np.zeros((models, b))]
        return cls(kind, layers)

    def forward(self, x: np.ndarray, room: Room | None = None) -> list[np.ndarray]:
        """Outputs of all layers for rows x; the last are probabilities (F, rows, outputs). They hold until the room is used again."""
        out, room = [x[None]], room or Room()
        for k in range(0, len(self.layers), 2):
            z = np.matmul(out[-1], self.layers[k], out=room(("out", k), (len(self.layers[k]), len(x), self.layers[k].shape[2])))
            z += self.layers[k + 1][:, None]
            if k < len(self.layers) - 2:
                np.maximum(z, 0, out=z)
            elif self.kind == "ordinal":
                z = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            else:
                e = np.exp(z - z.max(axis=2, keepdims=True))
                z = e / e.sum(axis=2, keepdims=True)
            out.append(z)
        return out

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, room: Room | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Summed cross-entropy of each model and its gradients. y: (rows, outputs), w: (F, rows, outputs), where softmax reads the first weight of a row."""
        room = room or Room()
        outs = self.forward(x, room)
        loss, delta = self._loss(outs[-1], y, w), (w if self.kind == "ordinal" else w[..., :1]) * (outs[-1] - y)
        gradients: list[np.ndarray] = []
        for k in range(len(self.layers) - 2, -1, -2):
            gradients = [np.swapaxes(outs[k // 2], 1, 2) @ delta, delta.sum(axis=1), *gradients]
            if k:
                shape = outs[k // 2].shape
                delta = np.matmul(delta, np.swapaxes(self.layers[k], 1, 2), out=room(("delta", k), shape))
                delta *= np.greater(outs[k // 2], 0, out=room(("open", k), shape, np.bool_))
        return loss, gradients

    def _loss(self, p: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-12, 1 - 1e-12)
        if self.kind == "ordinal":
            return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum(axis=(1, 2))
        return -(w[..., :1] * y * np.log(p)).sum(axis=(1, 2))

    def loss(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, room: Room | None = None) -> np.ndarray:
        """Summed cross-entropy of each model, without a gradient."""
        return self._loss(self.forward(x, room)[-1], y, w)

    def flat(self) -> list[float]:
        return np.concatenate([a.ravel() for a in self.layers]).tolist()

    def shapes(self) -> list[int]:
        return [self.layers[0].shape[1], *(b.shape[1] for b in self.layers[1::2])]

    @classmethod
    def of(cls, kind: str, sizes: list[int], values: list[float]) -> Net:
        layers, at = [], 0
        for a, b in zip(sizes, sizes[1:], strict=False):
            layers += [np.array(values[at : at + a * b]).reshape(1, a, b), np.array(values[at + a * b : at + a * b + b]).reshape(1, b)]
            at += a * b + b
        return cls(kind, layers)

    def one(self, k: int) -> Net:
        return Net(self.kind, [a[k : k + 1] for a in self.layers])

    def but(self, k: int) -> Net:
        """All models but the k-th; all, if k is 0, as the first has seen every row."""
        return Net(self.kind, [np.delete(a, k, axis=0) for a in self.layers]) if k else self


def targets(kind: str, label: np.ndarray) -> np.ndarray:
    """Of classes 0, 1, 2: for `ordinal` whether at least 1, and whether 2; for `softmax` one of three."""
    return np.column_stack([label >= 1, label >= 2] if kind == "ordinal" else [label == k for k in range(3)]).astype(np.float64)


def balance(kind: str, counts: np.ndarray) -> np.ndarray:
    """Weights (F, 3 classes, outputs) that balance each output's classes; an ordinal net's second output learns from rows of class 1 and 2 only. counts: (F, 3)."""
    n = np.maximum(counts, 1e-9)[:, :, None]
    total = counts.sum(axis=1)[:, None, None]
    if kind == "softmax":
        return np.repeat(total / ((counts > 0).sum(axis=1)[:, None, None] * n), 3, axis=2)
    rest = n[:, 1:].sum(axis=1, keepdims=True)
    first = np.concatenate([total / (2 * n[:, :1]), *[total / (2 * rest)] * 2], axis=1)
    second = np.concatenate([np.zeros_like(rest), rest / (2 * n[:, 1:2]), rest / (2 * n[:, 2:])], axis=1)
    return np.concatenate([first, second], axis=2)


def train(df: DataFrame, features: list[str], label: str, part: Column, kind: str = "ordinal", confidence: Column | None = None, fold: str | None = None, steps: int = 40, rate: float = 0.03, l2: float = 1e-4, hidden: tuple[int, ...] = HIDDEN, seed: int = 1) -> tuple[Net, list]:
    """A net of rows where part is `train`, its weights those of the step of the least loss where part is `validation`; and the folds.

    Rows are packed once into shards. In each step every task adds up the gradients of its
    shards, tasks' sums meet in SUMS groups, and the driver takes one Adam step. With `fold`
    there is a model for all rows, the first, and one for each value of fold that hasn't seen
    its rows: their weights lie side by side and one pass computes all gradients. Memory on
    the driver is that of the weights, 30 kB a model. Classes are balanced for each
    model and weighed by confidence; null features are 0.
    """
    held = F.lit(None).cast("string") if fold is None else F.col(fold).cast("string")
    packed = df.select(F.array(*(F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in features)).alias("x"), F.col(label).cast("int").alias("y"), (F.lit(1.0) if confidence is None else confidence).cast("double").alias("c"), part.alias("part"), held.alias("held"))
    packed = packed.filter("part in ('train', 'validation') and y is not null")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                b = batch.slice(at, SHARD)
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                one = {"x": [x.tobytes()], "y": [b.column("y").to_numpy().astype(np.int8).tobytes()], "c": [b.column("c").to_numpy().tobytes()], "fit": [(pc.equal(b.column("part"), "train")).to_numpy(zero_copy_only=False).tobytes()]}
                held = b.column("held").dictionary_encode()
                one |= {"names": pa.array([held.dictionary.to_pylist()], pa.list_(pa.string())), "held": [held.indices.fill_null(-1).to_numpy().astype(np.int32).tobytes()]}
                yield pa.RecordBatch.from_pydict(one)

    shards = packed.mapInArrow(shard, "x binary, y binary, c binary, fit binary, names array<string>, held binary")
    # dealt evenly once: a step takes as long as the task with the most shards
    shards = stored(shards.repartition(FILES * df.sparkSession.sparkContext.defaultParallelism), "shards")
    found = packed.filter("part = 'train'").groupBy("held", "y").agg(F.sum("c").alias("n")).collect()  # three rows a fold
    folds = sorted({r["held"] for r in found} - {None}) if fold else []
    own = np.zeros((1 + len(folds), 3))
    for r in found:
        own[0, r["y"]] += r["n"]
        if r["held"] in folds:
            own[1 + folds.index(r["held"]), r["y"]] += r["n"]
    counts = np.concatenate([own[:1], own[:1] - own[1:]])
    weights = balance(kind, counts)
    net = Net.drawn(kind, len(features), 1 + len(folds), hidden, seed)
    number = {f: k for k, f in enumerate(folds, 1)}

    def gradients(net: Net) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Losses on training and validation rows, and the gradients of the first, summed over all rows, with the weights' sums."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nets: dict[int, tuple[Net, np.ndarray, list[np.ndarray]]] = {}  # of the rows of a fold: the models that learn from them, and their sums
            room = Room()
            for batch in batches:
                for r in batch.to_pylist():
                    x, y, c = np.frombuffer(r["x"], np.float32).reshape(-1, len(features)), np.frombuffer(r["y"], np.int8), np.frombuffer(r["c"])
                    fit, own = np.frombuffer(r["fit"], bool), np.array([*(number.get(name, 0) for name in r["names"]), 0])[np.frombuffer(r["held"], np.int32)]
                    for fold in np.unique(own).tolist():
                        if fold not in nets:
                            of = net.but(fold)
                            nets[fold] = of, np.delete(np.arange(len(weights)), fold) if fold else np.arange(len(weights)), [np.zeros(len(of.layers[0])) for _ in range(3)] + [np.zeros_like(a) for a in of.layers]
                        of, which, sums = nets[fold]
                        for rows, training in ((np.flatnonzero((own == fold) & fit), True), (np.flatnonzero((own == fold) & ~fit), False)):
                            for at in range(0, len(rows), STRETCH):
                                some = rows[at : at + STRETCH]
                                w = weights[which[:, None], y[some]] * c[None, some, None]
                                given = x[some].astype(np.float64), targets(kind, y[some]), w, room
                                if training:
                                    loss, g = of.loss_and_gradient(*given)
                                    for a, b in zip((sums[0], *sums[2:]), (loss, w[..., :1].sum(axis=(1, 2)), *g), strict=True):
                                        a += b
                                else:
                                    sums[1] += of.loss(*given)
            total = [np.zeros(len(weights)) for _ in range(3)] + [np.zeros_like(a) for a in net.layers]
            for _, which, sums in nets.values():
                for a, b in zip(total, sums, strict=True):
                    a[which] += b
            if nets:
                yield pa.RecordBatch.from_pydict({"group": [hash(tuple(total[0].tolist())) % SUMS], "sums": [np.concatenate([a.ravel() for a in total]).tobytes()]})

        def together(table: pa.Table) -> pa.Table:
            return pa.table({"sums": [np.sum([np.frombuffer(b) for b in table["sums"].to_pylist()], axis=0).tobytes()]})

        rows = shards.mapInArrow(add, "group long, sums binary").groupBy("group").applyInArrow(together, "sums binary").collect()
        flat = np.sum([np.frombuffer(r["sums"]) for r in rows], axis=0)
        m = 1 + len(folds)
        out, at = [], 3 * m
        for a in net.layers:
            out.append(flat[at : at + a.size].reshape(a.shape))
            at += a.size
        return flat[:m], flat[m : 2 * m], out, np.maximum(flat[2 * m : 3 * m], 1e-9)

    first, second = ([np.zeros_like(a) for a in net.layers] for _ in range(2))
    best, least = [a.copy() for a in net.layers], np.full(1 + len(folds), np.inf)
    if not counts.sum():
        return net, folds
    for step in range(1, steps + 1):
        _, check, g, n = gradients(net)
        better = check < least
        least = np.where(better, check, least)
        for a, b in zip(best, net.layers, strict=True):
            a[better] = b[better]
        for k, a in enumerate(net.layers):
            gradient = g[k] / n.reshape(-1, *[1] * (a.ndim - 1)) + l2 * a
            first[k] = 0.9 * first[k] + 0.1 * gradient
            second[k] = 0.999 * second[k] + 0.001 * gradient**2
            a -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Net(kind, best if np.isfinite(least).all() and least.any() else net.layers), folds


def _rows(columns: tuple[pa.Array, ...]) -> np.ndarray:
    """Columns beside each other; null and NaN are 0."""
    x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns])
    return np.where(np.isnan(x), 0.0, x)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def probabilities(df: DataFrame, features: list[str], net: Net, model: Column | None = None) -> DataFrame:
    """df with p_good, p_suspect, p_bad by the net, or by that of its models whose number `model` tells."""
    names = [f"_x{k}" for k in range(len(features))]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scored(which: pa.Array, *columns: pa.Array) -> pa.Array:
        x, at = _rows(columns), which.to_numpy(zero_copy_only=False)
        out, room = np.zeros((len(x), net.layers[-1].shape[1])), Room()
        for k in np.unique(at):
            of, rows = net.one(int(k)), np.flatnonzero(at == k)
            for lo in range(0, len(rows), SHARD):
                out[rows[lo : lo + SHARD]] = of.forward(x[rows[lo : lo + SHARD]], room)[-1][0]
        return _lists(out)

    out = df.withColumns({n: F.col(c).cast("double") for n, c in zip(names, features, strict=True)}).withColumn("_p", scored(F.lit(0) if model is None else model, *names))
    three = ordinal_probabilities(F.col("_p")[0], F.col("_p")[1]) if net.kind == "ordinal" else tuple(F.col("_p")[k] for k in range(3))
    return out.withColumns(dict(zip(("p_good", "p_suspect", "p_bad"), three, strict=True))).drop("_p", *names)


def bad_by_fold(df: DataFrame, features: list[str], net: Net, folds: list[str], own: Column, keep: tuple[str, ...]) -> DataFrame:
    """`keep` columns, `fold` and `p_bad`: for each row a row of the model of all, `all`, and of each fold's model but its own. A row goes to Python once for all models."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scored(*columns: pa.Array) -> pa.Array:
        x, room = _rows(columns), Room()
        out = np.zeros((len(x), len(net.layers[0])))
        for lo in range(0, len(x), STRETCH):
            p = net.forward(x[lo : lo + STRETCH], room)[-1]
            out[lo : lo + STRETCH] = (p[..., 0] * p[..., 1] if net.kind == "ordinal" else p[..., 2]).T
        return _lists(out)

    named = F.arrays_zip(F.array(*map(F.lit, ["all", *folds])).alias("fold"), F.col("_p").alias("p_bad"))
    rows = df.select(*keep, own.cast("string").alias("_own"), scored(*(F.col(c).cast("double") for c in features)).alias("_p"))
    return rows.select(*keep, "_own", F.inline(named)).filter("fold <> _own").drop("_own")


def tuned(df: DataFrame, keys: tuple[str, ...], p: str, truth: Column, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """Rows `keys, tau, f1`: of each key the middle of the thresholds that share its best F1, from counts of the thresholds that rows pass."""
    passed = F.coalesce(sum((F.col(p) >= t).cast("int") for t in taus), F.lit(0))
    counted = df.select(*keys, passed.alias("_k"), truth.cast("long").alias("_t")).groupBy(*keys, "_k").agg(F.sum("_t").alias("_t"), F.count("*").alias("_n"))
    at = counted.groupBy(*keys).agg(F.sum("_t").alias("_all"), *(F.sum(F.when(F.col("_k") >= k, F.col("_t")).otherwise(0)).alias(f"_tp{k}") for k in range(1, len(taus) + 1)), *(F.sum(F.when(F.col("_k") >= k, F.col("_n")).otherwise(0)).alias(f"_called{k}") for k in range(1, len(taus) + 1)))
    f1 = F.array(*(F.struct(F.coalesce(2 * F.col(f"_tp{k}") / F.nullif(F.col(f"_called{k}") + F.col("_all"), F.lit(0)), F.lit(0.0)).alias("f1"), F.lit(t).alias("tau")) for k, t in enumerate(taus, 1)))
    listed = at.select(*keys, F.explode(f1).alias("_f")).select(*keys, "_f.*")
    best = listed.withColumn("_best", F.max("f1").over(Window.partitionBy(*keys))).filter(F.col("f1") >= F.col("_best") - 1e-9)
    return best.groupBy(*keys).agg(F.median("tau").alias("tau"), F.max("f1").alias("f1"))


class _Stage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A transformer whose parameters are all its state."""

    def __init__(self, **values) -> None:
        super().__init__()
        self._set(**values)


class ClippedScaler(_Stage):
    """Columns cut to two bounds, less a centre, over a spread; nulls become 0."""

    columns = Param(Params._dummy(), "columns", "columns to scale", TypeConverters.toListString)
    bounds = Param(Params._dummy(), "bounds", "low, high, centre and spread of each column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, bounds: list[float] | None = None) -> None:
        super().__init__(**self._input_kwargs)

    @staticmethod
    def fitted(df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995) -> ClippedScaler:
        """From exact quantiles of df's rows: bounds, median and quartile range (1 where it is 0)."""
        points = (low, 0.25, 0.5, 0.75, high)
        found = exact_quantiles(df, (), {f"{c}_{k}": (c, q) for c in columns for k, q in enumerate(points)}).first()
        bounds: list[float] = []
        for c in columns:
            lo, q1, mid, q3, hi = [found[f"{c}_{k}"] for k in range(5)] if found and found[f"{c}_0"] is not None else (0.0, 0.0, 0.0, 1.0, 0.0)
            bounds += [lo, hi, mid, (q3 - q1) or 1.0]
        return ClippedScaler(columns=columns, bounds=bounds)

    def _transform(self, df: DataFrame) -> DataFrame:
        names, values = self.getOrDefault("columns"), self.getOrDefault("bounds")
        scaled = {c: F.coalesce((F.greatest(F.least(F.col(c), F.lit(values[4 * k + 1])), F.lit(values[4 * k])) - values[4 * k + 2]) / values[4 * k + 3], F.lit(0.0)) for k, c in enumerate(names)}
        return df.withColumns({f"scaled_{c}": x for c, x in scaled.items()})


class NetHead(_Stage):
    """p_good, p_suspect, p_bad of the scaled columns by a net."""

    columns = Param(Params._dummy(), "columns", "features, without the prefix scaled_", TypeConverters.toListString)
    kind = Param(Params._dummy(), "kind", "ordinal or softmax", TypeConverters.toString)
    sizes = Param(Params._dummy(), "sizes", "widths of the layers", TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "all weights", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, kind: str | None = None, sizes: list[int] | None = None, weights: list[float] | None = None) -> None:
        super().__init__(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        net = Net.of(self.getOrDefault("kind"), self.getOrDefault("sizes"), self.getOrDefault("weights"))
        return probabilities(df, [f"scaled_{c}" for c in self.getOrDefault("columns")], net)


class OrdinalRule(_Stage):
    """`decided`: BAD for sentinels and where p_bad reaches the threshold, else the likelier of SUSPECT and GOOD."""

    tau = Param(Params._dummy(), "tau", "threshold of p_bad", TypeConverters.toFloat)
    sentinel = Param(Params._dummy(), "sentinel", "boolean column that tells sentinels", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, tau: float | None = None, sentinel: str | None = None) -> None:
        super().__init__(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("decided", ordinal_decision(F.col("p_good"), F.col("p_suspect"), F.col("p_bad"), self.getOrDefault("tau"), F.col(self.getOrDefault("sentinel"))))


def fitted_pipeline(df: DataFrame, features: list[str], label: str, part: str, sentinel: str, kind: str = "ordinal", confidence: Column | None = None, **options) -> PipelineModel:
    """Scaler, head and rule in one model that writes, loads, and transforms tables and streams: fitted where `part` is train, its threshold where it is validation."""
    scaler = ClippedScaler.fitted(df.filter(F.col(part) == "train"), features)
    scaled = stored(scaler.transform(df), "scaled")
    net, _ = train(scaled, [f"scaled_{c}" for c in features], label, F.col(part), kind, confidence, **options)
    head = NetHead(columns=features, kind=kind, sizes=net.shapes(), weights=net.flat())
    held = head.transform(scaled.filter(F.col(part) == "validation")).filter(~F.col(sentinel))
    found = tuned(held, (), "p_bad", F.col(label) == 2).first()
    return PipelineModel([scaler, head, OrdinalRule(tau=float(found["tau"]) if found and found["f1"] else 0.5, sentinel=sentinel)])
