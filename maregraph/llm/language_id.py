"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every training document. The weights are fitted by
follow-the-regularised-leader with elastic-net penalties: first on a bounded draw of the
training texts, part of which is held back to set the temperature of the softmax, then in
rounds by learners in tasks, which go through all other texts once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maregraph.llm.common import persisted, quoted, row_chunks

#: Hashed n-gram features (n = 1 to 3 code points).
DIMS = 1 << 15
#: Labelled texts on which the driver begins the weights, in even parts for the languages (one each if there are more languages than that). All others follow in tasks.
SAMPLE = 4000
#: Rounds in which learners go through the other texts, texts of a learner in a round (more by half at most), texts it orders at once, numbers of its state in a row.
ROUNDS, LEARNER, STRETCH, BLOCK = 3, 4096, 512, 8192
EPOCHS, BATCH = 4, 16
#: Steps at least: few texts are gone through more often.
STEPS = 800
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05

LETTER = regex.compile(r"\p{L}")
#: Odd multipliers that spread code points over 64 bits, one for each place in an n-gram.
SPREAD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def ngram_counts(text: str, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (rising) and counts of a whole text, lower-cased; runs of other than letters count as one space."""
    codes = np.frombuffer(regex.sub(r"\P{L}+", " ", text.lower()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    shift = np.uint64(64 - (dims.bit_length() - 1))
    with np.errstate(over="ignore"):
        keys, parts = np.zeros(len(codes), np.uint64), []
        for n in range(3):
            if len(codes) <= n:
                break
            keys = keys[: len(codes) - n] * SPREAD[1] + (codes[n:] + np.uint64(n + 1)) * SPREAD[0]
            parts.append(((keys ^ (keys >> np.uint64(31))) * SPREAD[2]) >> shift)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.bincount(np.concatenate(parts).astype(np.int64), minlength=dims)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # dims x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0
    state: tuple[np.ndarray, np.ndarray] | None = None  # of an unfinished fit: z and n, the bias last

    def features(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts, dtype=np.float64)) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(at, counts) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not LETTER.search(text):
            return "und", 0.0
        z = self.logits(*ngram_counts(text, len(self.idf))) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit_ftrl(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int | None = None) -> None:
    """FTRL-proximal with a learning rate for each weight; L1 sets rare weights to zero, L2 holds the rest down. Goes on from the model's state, if it has one."""
    dims, k = len(model.idf), len(model.langs)
    z, n = model.state or (np.zeros((dims + 1, k)), np.zeros((dims + 1, k)))  # the last row is the bias, not penalised
    rng = np.random.default_rng(7)
    ends = np.cumsum([0, *(len(at) for at, _, _ in rows)]).tolist()
    values = np.empty(ends[-1])  # of all rows: an array for each would leave holes in the driver's memory
    for (at, c, _), lo, hi in zip(rows, ends, ends[1:], strict=False):
        values[lo:hi] = model.features(at, c)
    batches = [(at, values[lo:hi], y) for (at, _, y), lo, hi in zip(rows, ends, ends[1:], strict=False)]
    for _ in range(epochs or max(EPOCHS, -(-STEPS * BATCH // max(1, len(rows))))):
        order = rng.permutation(len(batches))
        for begin in range(0, len(order), BATCH):
            part = [batches[i] for i in order[begin : begin + BATCH]]
            ids = np.unique(np.concatenate([*(at for at, _, _ in part), [dims]]).astype(np.int64))
            w = solved(z[ids], n[ids])
            w[-1] = -z[dims] / ((BETA + np.sqrt(n[dims])) / ALPHA)
            g = np.zeros_like(w)
            for at, x, y in part:
                own = np.searchsorted(ids, at)
                s = x @ w[own] + w[-1]
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y] -= 1
                g[own] += x[:, None] * p
                g[-1] += p
            g /= len(part)
            step = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / ALPHA
            z[ids] += g - step * w
            n[ids] += g * g
    model.state = z, n
    weigh(model)


def weigh(model: LanguageModel) -> None:
    """Weights and bias of the model's state."""
    z, n = model.state
    model.weights, model.bias = solved(z, n)[:-1], -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)


def solved(z: np.ndarray, n: np.ndarray, scale: float = 1e-3) -> np.ndarray:
    """Closed-form weights of the regularised leader (penalties scaled to the mean gradient of a batch)."""
    l1 = L1 * scale
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2 * scale))


def calibrate(model: LanguageModel, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature of least negative log-likelihood on rows that the weights haven't seen."""
    if not rows:
        return
    logits = np.array([model.logits(at, c) for at, c, _ in rows])
    y = np.array([y for _, _, y in rows])

    def loss(t: float) -> float:
        s = logits / t
        s -= s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

    model.temperature = min((2.0 ** (e / 8) for e in range(-24, 25)), key=loss)


def unpacked(sent: pa.Table, langs: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Feature numbers, counts and language of rows `lang, ids, counts`, in an order of their own, whatever tasks they came from.

    They are stretches of two large arrays: thousands of small objects would leave holes
    in the driver's memory that its process keeps.
    """
    order = pc.sort_indices(sent, sort_keys=[("ids", "ascending"), ("counts", "ascending"), ("lang", "ascending")]).to_numpy()
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(sent["ids"]).to_numpy()[order] // 4, dtype=np.int64)]).tolist()
    both = np.empty((2, ends[-1]), "<u4")
    for k, lo, hi in zip(order.tolist(), ends, ends[1:], strict=False):
        for row, column in zip(both, ("ids", "counts"), strict=True):
            row[lo:hi] = np.frombuffer(sent[column][k].as_buffer(), "<u4")
    number = {s: k for k, s in enumerate(langs)}
    return [(both[0, lo:hi], both[1, lo:hi], number[sent["lang"][k].as_py()]) for k, lo, hi in zip(order.tolist(), ends, ends[1:], strict=False)]


def packed(at: np.ndarray, counts: np.ndarray, dims: int) -> tuple[bytes, bytes]:
    """Feature numbers (rising) and counts of a text, small and easy to compress: steps between numbers, first their low bytes, then their high ones; counts in the fewest bytes that hold them."""
    steps = np.diff(at, prepend=0).astype("<u2" if dims <= 1 << 16 else "<u4")
    width = next(t for t in ("u1", "<u2", "<u4") if counts.max(initial=0) <= np.iinfo(t).max)
    return steps.view(np.uint8).reshape(len(steps), steps.itemsize).T.tobytes(), counts.astype(width).tobytes()


def numbers(ids: bytes, dims: int) -> np.ndarray:
    """Feature numbers of packed()."""
    kind = np.dtype("<u2" if dims <= 1 << 16 else "<u4")
    steps = np.frombuffer(ids, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind)
    return np.cumsum(steps, dtype="<u4")


def widened(ids: bytes, counts: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    at = numbers(ids, dims)
    return at, np.frombuffer(counts, f"<u{len(counts) // max(1, len(at)) or 1}").astype("<u4")


def texts_of(docs: DataFrame, dims: int) -> DataFrame:
    """Rows `lang, h, ids, counts, copies` of rows `text, lang, h`: a text of a language is one row for each few MB of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_chunks(batch, 0):
                keys = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))
                copies = Counter(keys)
                first = {key: k for k, key in reversed(list(enumerate(keys)))}
                got = [packed(*ngram_counts(part.column(0)[k].as_py(), dims), dims) for k in first.values()]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in first], pa.string()), pa.array([h for _, h in first], pa.int64()), pa.array([a for a, _ in got], pa.binary()), pa.array([c for _, c in got], pa.binary()), pa.array([copies[key] for key in first], pa.int64())], ["lang", "h", "ids", "counts", "copies"])

    return docs.mapInArrow(count, "lang string, h long, ids binary, counts binary, copies long")


def learn_rest(model: LanguageModel, rest: DataFrame, n: int) -> None:
    """The model's state after all of n further texts (`lang, h, ids, counts`; a text may have several rows), each seen once.

    Each of ROUNDS rounds deals a part of the texts to learners, one a task, by the hash of
    the text. A learner goes through its texts in the order of their hashes from the state of
    the round's beginning; what it adds to a feature's numbers is averaged over the
    learners that met the feature. So the result doesn't depend on how rows are dealt
    to tasks, no task holds more than a stretch of its texts, and a learner's state leaves it in
    blocks that are summed in tasks.
    """
    dims, k, number = len(model.idf), len(model.langs), {s: y for y, s in enumerate(model.langs)}
    learners, rows = max(1, round(n / (ROUNDS * LEARNER))), max(1, BLOCK // k)
    part = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(ROUNDS))

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending")])
        sums = [np.sum([np.frombuffer(b) for b in table[c].to_pylist()], axis=0).tobytes() for c in ("z", "n", "met")]
        return pa.table({"block": table["block"][:1], "part": pa.array([table["part"][0].as_py() % 64]), "z": [sums[0]], "n": [sums[1]], "met": [sums[2]]})

    for turn in range(ROUNDS):
        shared = rest.sparkSession.sparkContext.broadcast((model.langs, model.idf, model.state))

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, idf, begun = shared.value  # noqa: B023
            own, last, learner = LanguageModel(langs, np.zeros((dims, k)), np.zeros(k), idf, state=(begun[0].copy(), begun[1].copy())), None, TaskContext.get().partitionId()

            def texts() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
                nonlocal last
                for batch in batches:
                    for lang, h, ids, counts in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                        if (h, lang) != last and ids:
                            yield *widened(ids, counts, dims), number[lang]
                        last = h, lang

            told, met = texts(), np.zeros(dims + 1)
            while some := list(islice(told, STRETCH)):
                fit_ftrl(own, some, 1)
                for at, _, _ in some:
                    met[at] = 1
                met[dims] = 1
            if met[dims]:
                z, n = (a - b for a, b in zip(own.state, begun, strict=True))
                for block, lo in enumerate(range(0, dims + 1, rows)):
                    yield pa.RecordBatch.from_pydict({"block": [block], "part": [learner], "z": [z[lo : lo + rows].tobytes()], "n": [n[lo : lo + rows].tobytes()], "met": [met[lo : lo + rows].tobytes()]})

        kind = "block long, part long, z binary, n binary, met binary"
        dealt = rest.filter(part == turn).select("lang", "h", "ids", "counts").repartition(learners, "h").sortWithinPartitions("h", "lang")
        found = dealt.mapInArrow(learn, kind).groupBy("block", F.pmod("part", F.lit(64))).applyInArrow(summed, kind).groupBy("block").applyInArrow(summed, kind).collect()
        for r in found:
            at, met = slice(r["block"] * rows, (r["block"] + 1) * rows), np.maximum(np.frombuffer(r["met"]), 1)[:, None]
            for a, b in zip(model.state, (r["z"], r["n"]), strict=True):
                a[at] += np.frombuffer(b).reshape(-1, k) / met
        shared.unpersist()
    weigh(model)


def train_language_id(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", dims: int = DIMS, sample: int = SAMPLE) -> LanguageModel:
    """A model from the rows where `training` holds and neither text nor language is null.

    The weights are fitted on all distinct texts: the driver begins with `sample` at most (at
    least one of each language), of a language those of the least hashes, however often a
    text is copied, and a fifth of them sets the temperature; all others follow in tasks
    (learn_rest). Document frequencies count every training document, copies too.
    Languages are the labels with training rows, and the driver holds a number for each
    feature and language; without any, the model predicts `und` for all. Texts are read
    whole, once, and an empty one counts as a document without features.
    """
    rows = docs.filter(training & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text_col).alias("h"))
    counted = persisted(texts_of(rows, dims), "ngrams")
    found = counted.groupBy("lang", "h").agg(F.sum("copies").alias("n")).groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n").alias("n")).collect()
    if not found:
        return LanguageModel([], np.zeros((dims, 0)), np.zeros(0), np.ones(dims))
    texts, n = {r["lang"]: r["texts"] for r in found}, sum(r["n"] for r in found)
    langs = sorted(texts)
    each = max(1, sample // len(langs))
    # a little more than `each` texts of a language are likely to be under its share of the hashes; the least `each` of them stay
    share = F.create_map(*(x for s in langs for x in (F.lit(s), F.lit(min(1.0, (each + 4 * each**0.5 + 10) / texts[s])))))
    place = F.pmod(F.xxhash64("h"), F.lit(1 << 30))
    drawn = counted.filter(place / float(1 << 30) < share[F.col("lang")]).dropDuplicates(["lang", "h"])
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))).filter(F.col("k") <= each)

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [widened(*x, dims) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary()), *batch.columns[3:]], ["lang", "ids", "counts", "place", "h"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(dims, np.int64)
        for batch in batches:
            for ids, copies in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                df[numbers(ids, dims)] += copies
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], ["k", "v"])

    df = np.zeros(dims, np.int64)
    told = counted.select("ids", "copies").mapInArrow(frequencies, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    df[told["k"].to_numpy()] = told["v"].to_numpy()
    del told
    model = LanguageModel(langs, np.zeros((dims, len(langs))), np.zeros(len(langs)), np.log((1 + n) / (1 + df)) + 1)
    sent = drawn.select("lang", "ids", "counts", place.alias("place"), "h").mapInArrow(wide, "lang string, ids binary, counts binary, place long, h long").toArrow()
    lasts: dict[str, tuple[int, int]] = {}  # of a language the last text of the draw
    for lang, *at in zip(*(sent[c].to_pylist() for c in ("lang", "place", "h")), strict=True):
        lasts[lang] = max(lasts.get(lang, (-1, 0)), tuple(at))
    parsed = [r for r in unpacked(sent, langs) if len(r[0])]
    del sent
    pa.default_memory_pool().release_unused()
    fold = np.random.default_rng(3).permutation(len(parsed)) % 5
    fold[list({y: k for k, (_, _, y) in enumerate(parsed)}.values())] = 1  # every language has a row in the fit
    fit_ftrl(model, [r for r, f in zip(parsed, fold, strict=True) if f])
    if (left := sum(texts.values()) - sum(min(each, m) for m in texts.values())) > 0:
        after = [F.create_map(*(x for s in langs for x in (F.lit(s), F.lit(lasts[s][k]))))[F.col("lang")] for k in range(2)]
        learn_rest(model, counted.filter((place > after[0]) | ((place == after[0]) & (F.col("h") > after[1]))), left)
    calibrate(model, [r for r, f in zip(parsed, fold, strict=True) if not f])
    model.state = None  # a finished model needs no more than its weights
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs with `lang_pred` (a learned label; `und` for null and for texts without letters) and `score` (0 to 1; 0 for `und`).

    All columns of docs are kept, but for those of these two names; repeated rows are
    each predicted, texts of any length whole. `text_col` may be a field of a struct
    column ("row.text"). An empty table gives no rows. The model
    (dims x languages) is broadcast; documents of any number add nothing to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            text = batch.column(path[0])
            for field in path[1:]:
                text = pc.struct_field(text, field)
            for part in row_chunks(pa.RecordBatch.from_arrays([text, *batch.columns[: len(kept)]], ["_read", *kept]), 0):
                found = [own.predict(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([s for s, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], [*kept, "lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    path = [text_col] if text_col in docs.columns else text_col.split(".")
    if path[0] in kept:  # the text goes to Python once
        return docs.select(*(docs[quoted(c)] for c in kept)).mapInArrow(predict, schema)
    path = ["_read"]
    return docs.select(*(docs[quoted(c)] for c in kept), F.col(text_col).alias("_read")).mapInArrow(predict, schema)
