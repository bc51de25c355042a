"""Quality of documents: fixed rules on statistics of the text, then gradient-boosted trees over them.

Statistics are counted a batch of texts at a time. The trees are grown on all labelled
documents, by histograms that tasks count where the driver shouldn't hold the documents, with
monotonic constraints on chosen features, and flattened into arrays of nodes, through
which all documents of a batch go down together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maregraph.llm.common import persisted, row_chunks

#: Labelled documents of which the driver grows the trees itself, at most; of more, tasks count the histograms.
SAMPLE = 20_000
#: Rows of a shard, trees after which the shards' margins are written anew, parts of 1 in which gradients are counted.
SHARD, REFRESH, UNIT = 1 << 16, 10, float(1 << 32)
#: Words to a window whose repeats count.
SPAN = 8
#: Least words, and most per cent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_alpha", "n_digits", "n_upper", "n_closed", "n_chars")
#: Features and their direction: -1 where more of it never makes a document better, 1 where it never makes it worse, 0 free.
FEATURES = {"length": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "words_a_line": 0, "distinct": 0, "alpha": 1, "digits": -1, "upper": 0, "closed": 0, "space": 0}


def repeated(codes: np.ndarray, doc: np.ndarray, n_docs: int, span: int = SPAN) -> np.ndarray:
    """Words of each document that lie in a window of `span` words (a power of two) found twice or more in it.

    Windows are named exactly by doubling: equal pairs of names of half the length get
    one name.
    """
    name, step = codes, 1
    while step < span and len(name) > step:
        left, right = name[:-step], name[step:]
        name = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]
        step *= 2
    if step < span or len(name) == 0:
        return np.zeros(n_docs, np.int64)
    first = doc[: len(name)]
    whole = np.flatnonzero(first == doc[span - 1 :])
    _, at, times = np.unique(first[whole] * (int(name.max()) + 1) + name[whole], return_inverse=True, return_counts=True)
    begins = whole[times[at] > 1]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, begins, 1)
    np.add.at(cover, begins + span, -1)
    return np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n_docs)


def _parts(split: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All strings of a list array, and the list of each."""
    offsets = split.offsets.to_numpy()
    return split.flatten(), np.repeat(np.arange(len(split)), np.diff(offsets))


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text (null: of the empty one)."""
    texts, n = texts.fill_null("").cast(pa.large_string()), len(texts)
    total = lambda doc, x=None: np.bincount(doc, x, minlength=n).astype(np.int64)
    number = lambda found: found.to_numpy(zero_copy_only=False).astype(np.int64)
    words, doc = _parts(pc.ascii_split_whitespace(texts))
    some = pc.not_equal(words, "")  # else what stands before the first space and after the last
    words, doc = words.filter(some), doc[some.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    codes, kinds = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    lines, of_line = _parts(pc.split_pattern(texts, "\n"))
    full = pc.match_substring_regex(lines, r"[^ \t-\r]")
    lines, of_line = lines.filter(full), of_line[full.to_numpy(zero_copy_only=False)]
    line_codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_lines = total(of_line)
    distinct = lambda doc, codes: np.bincount(np.unique(doc * (int(codes.max(initial=0)) + 1) + codes) // (int(codes.max(initial=0)) + 1), minlength=n)
    of_kind = lambda x: number(x)[codes] if len(codes) else codes
    return {
        "n_words": total(doc),
        "word_chars": total(doc, of_kind(pc.utf8_length(kinds))),
        "n_symbols": number(pc.count_substring_regex(texts, SYMBOLS)),
        "n_dup_lines": n_lines - distinct(of_line, line_codes),
        "n_repeat_words": repeated(codes, doc, n),
        "n_lines": n_lines,
        "n_distinct": distinct(doc, codes),
        "n_alpha": total(doc, of_kind(pc.match_substring_regex(kinds, r"\pL"))),
        "n_digits": total(doc, of_kind(pc.count_substring_regex(kinds, "[0-9]"))),
        "n_upper": total(doc, of_kind(pc.count_substring_regex(kinds, r"\p{Lu}"))),
        "n_closed": total(of_line, number(pc.match_substring_regex(lines, r"[.!?…:;][\"')\]]*[ \t-\r]*$"))),
        "n_chars": number(pc.utf8_length(texts)),
    }


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id` and COUNTS (long). Whole texts are read, in parts of a few MB of whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_chunks(batch, 1):
                found = statistics(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in COUNTS)]))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The columns of FEATURES; shares of nothing are 0."""
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_words"] / lines,
        c["n_distinct"] / words, c["n_alpha"] / words, c["n_digits"] / chars, c["n_upper"] / chars, c["n_closed"] / lines, 1 - c["word_chars"] / np.maximum(c["n_chars"], 1),
    ])


@dataclass
class Trees:
    """A forest as arrays of nodes: a row goes left where its feature is at most the threshold; leaves lead to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def borders(x: np.ndarray, bins: int = 64) -> list[np.ndarray]:
    """Of each feature the values that end its bins."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]


def binned_by(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])


def best_value(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return -g / (h + l2)


def best_split(sums: list[np.ndarray], total_g: float, total_h: float, n: int, lo: float, hi: float, offsets: np.ndarray, directions: list[int], least: int, l2: float):
    """The best feature, bin, left and right value, and left sums of gradients of rows with these histograms, or None."""
    found, most = None, 1e-6
    gain_of = lambda g, h, v: -(g * v + 0.5 * (h + l2) * v * v)
    whole = gain_of(total_g, total_h, np.clip(best_value(total_g, total_h, l2), lo, hi))
    for f, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        gl, hl, nl = (np.cumsum(s[a:b])[:-1] for s in sums)
        ok = (nl >= least) & (n - nl >= least)
        if not ok.any():
            continue
        vl, vr = np.clip(best_value(gl, hl, l2), lo, hi), np.clip(best_value(total_g - gl, total_h - hl, l2), lo, hi)
        gain = np.where(ok & (directions[f] * (vr - vl) >= 0), gain_of(gl, hl, vl) + gain_of(total_g - gl, total_h - hl, vr) - whole, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > most:
            most, found = gain[k], (f, k, float(vl[k]), float(vr[k]), float(gl[k]), float(hl[k]))
    return found


def bounds_of(direction: int, lo: float, hi: float, middle: float) -> tuple[tuple[float, float], tuple[float, float]]:
    """Bounds of the left and the right child's values."""
    return {0: ((lo, hi), (lo, hi)), 1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle))}[direction]


def trees_of(nodes: list[list], roots: list[int], depth: int, base: float) -> Trees:
    columns = [np.array(c) for c in zip(*nodes, strict=True)] if nodes else [np.zeros(0)] * 5
    return Trees(columns[0].astype(np.int64), columns[1].astype(float), columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4].astype(float), np.array(roots, np.int64), depth, base)


def log_odds(share: float) -> float:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def grow(x: np.ndarray, y: np.ndarray, directions: list[int], rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 20, l2: float = 1.0, cuts: list[np.ndarray] | None = None) -> Trees:
    """Boosted trees for the log odds of y (0 or 1), by second-order gains over histograms of binned features.

    A split of a feature with direction 1 (-1) is made only where the right child's
    value isn't below (above) the left one's, and both subtrees stay on their side of the
    children's middle; so the whole forest is monotonic in that feature.
    """
    cuts = borders(x, bins) if cuts is None else cuts
    binned = binned_by(x, cuts)
    offsets = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])
    flat, width = binned + offsets[:-1], int(offsets[-1])
    base = log_odds(y.mean())
    margin, nodes, roots = np.full(len(y), base), [], []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float):
        where = flat[rows]
        sums = [np.bincount(where.ravel(), None if s is None else np.repeat(s[rows], x.shape[1]), minlength=width) for s in (g, h, None)]
        return best_split(sums, g[rows].sum(), h[rows].sum(), len(rows), lo, hi, offsets, directions, least, l2)

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int, lo: float, hi: float) -> int:
        me = len(nodes)
        value = float(np.clip(best_value(g[rows].sum(), h[rows].sum(), l2), lo, hi))
        nodes.append([0, np.inf, me, me, rate * value])
        cut = split(rows, g, h, lo, hi) if left else None
        if cut is None:
            margin[rows] += rate * value
            return me
        f, k, vl, vr, *_ = cut
        goes = binned[rows, f] <= k
        bounds = bounds_of(directions[f], lo, hi, (vl + vr) / 2)
        nodes[me][:2] = f, float(cuts[f][k])
        nodes[me][2] = build(rows[goes], g, h, left - 1, *bounds[0])
        nodes[me][3] = build(rows[~goes], g, h, left - 1, *bounds[1])
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(build(np.arange(len(y)), p - y, p * (1 - p), depth, -np.inf, np.inf))
    return trees_of(nodes, roots, depth, base)


def grow_spread(rows: DataFrame, names: list[str], cuts: list[np.ndarray], share: float, directions: list[int], rounds: int = 80, depth: int = 3, rate: float = 0.15, least: int = 20, l2: float = 1.0) -> Trees:
    """The trees of grow() for rows `label` and features of any number, a level of a tree in a job.

    Rows are binned once and packed into shards. A task walks its rows down the tree so far and counts the
    histograms of the nodes that are to be split; gradients are counted in whole numbers, so
    sums don't depend on how rows are dealt. The driver holds the histograms of a level
    for each task, and the trees. Margins are written anew after REFRESH trees.
    """
    spark, base = rows.sparkSession, log_odds(share)
    offsets = np.concatenate([[0], np.cumsum([len(c) + 1 for c in cuts])])
    width = int(offsets[-1])
    nodes, bins, roots, fresh = [], [], [], 0  # bins: of each node the last bin that goes left; fresh: trees that the margins hold

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                b = batch.slice(at, SHARD)
                x = np.column_stack([b.column(n).to_numpy(zero_copy_only=False) for n in names])
                yield pa.RecordBatch.from_pydict({"x": [binned_by(x, cuts).astype(np.uint8).tobytes()], "y": [b.column("label").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], "margin": [np.full(len(x), base).tobytes()]})

    def moved(r: dict, told: list[np.ndarray], trees: list[int]) -> tuple[np.ndarray, np.ndarray, Callable]:
        """Bins and margins of a shard's rows after more trees, and how they walk down."""
        x, margin = np.frombuffer(r["x"], np.uint8).reshape(-1, len(cuts)), np.frombuffer(r["margin"]).copy()
        feature, last, left, right, value = told
        every = np.arange(len(x))

        def walk(root: int, steps: int) -> np.ndarray:
            at = np.full(len(x), root)
            for _ in range(steps):
                at = np.where(x[every, feature[at]] <= last[at], left[at], right[at])
            return at

        for root in trees:
            margin += value[walk(root, depth)]
        return x, margin, walk

    def arrays() -> list[np.ndarray]:
        return [np.array([n[0] for n in nodes], np.int64), np.array(bins, np.int64), np.array([n[2] for n in nodes], np.int64), np.array([n[3] for n in nodes], np.int64), np.array([n[4] for n in nodes])]

    def renewed(shards: DataFrame) -> DataFrame:
        told, trees = arrays(), roots[fresh:]

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield pa.RecordBatch.from_pydict({"x": [r["x"]], "y": [r["y"]], "margin": [moved(r, told, trees)[1].tobytes()]})

        return persisted(shards.mapInArrow(move, "x binary, y binary, margin binary"), "margins")

    def histograms(shards: DataFrame, root: int, level: int, at_nodes: list[int]) -> np.ndarray:
        """Sums (3, nodes, width) of gradients, second derivatives and rows."""
        told, trees, size = arrays(), roots[fresh:], len(at_nodes) * width

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, size), np.int64)
            place = np.full(len(told[0]), -1)
            place[at_nodes] = np.arange(len(at_nodes))
            for batch in batches:
                for r in batch.to_pylist():
                    x, margin, walk = moved(r, told, trees)
                    node = place[walk(root, level)]
                    some = node >= 0
                    p, y = 1 / (1 + np.exp(-margin[some])), np.frombuffer(r["y"], np.uint8)[some]
                    where = (node[some, None] * width + x[some] + offsets[:-1]).ravel()
                    for k, s in enumerate((p - y, p * (1 - p))):
                        total[k] += np.bincount(where, np.repeat(np.rint(s * UNIT), len(cuts)), minlength=size).astype(np.int64)
                    total[2] += np.bincount(where, minlength=size)
            yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

        sums = np.zeros((3, size), np.int64)
        for r in shards.mapInArrow(count, "sums binary").collect():
            sums += np.frombuffer(r["sums"], np.int64).reshape(3, size)
        return sums.reshape(3, len(at_nodes), width) / np.array([UNIT, UNIT, 1])[:, None, None]

    def leaf(g: float, h: float, lo: float, hi: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), rate * float(np.clip(best_value(g, h, l2), lo, hi))])
        bins.append(255)
        return len(nodes) - 1

    shards = rows.select("label", *names).mapInArrow(shard, "x binary, y binary, margin binary")
    shards = persisted(shards.repartition(4 * spark.sparkContext.defaultParallelism), "shards")
    for _ in range(rounds):
        if len(roots) - fresh == REFRESH:
            shards, fresh = renewed(shards), len(roots)
        root = leaf(0.0, 0.0, -np.inf, np.inf)
        open_nodes = [(root, -np.inf, np.inf)]
        for level in range(depth):
            found, after = histograms(shards, root, level, [n for n, _, _ in open_nodes]), []
            for k, (me, lo, hi) in enumerate(open_nodes):
                sums = list(found[:, k])
                g, h, n = (s[: offsets[1]].sum() for s in sums)
                if not level:
                    nodes[me][4] = rate * float(best_value(g, h, l2))
                cut = best_split(sums, g, h, n, lo, hi, offsets, directions, least, l2)
                if cut is None:
                    continue
                f, b, vl, vr, gl, hl = cut
                both = bounds_of(directions[f], lo, hi, (vl + vr) / 2)
                nodes[me][:2], bins[me] = (f, float(cuts[f][b])), b
                nodes[me][2], nodes[me][3] = leaf(gl, hl, *both[0]), leaf(g - gl, h - hl, *both[1])
                after += [(nodes[me][2], *both[0]), (nodes[me][3], *both[1])]
            open_nodes = after
            if not open_nodes:
                break
        roots.append(root)
    return trees_of(nodes, roots, depth, base)


@dataclass
class QualityModel:
    trees: Trees | None
    #: Documents of a lower probability are rejected.
    least: float


def train_quality(counted: DataFrame, labels: DataFrame, label: Column, keep: float = 0.995, sample: int = SAMPLE, id_col: str = "doc_id") -> QualityModel:
    """Trees for `label` (true: good) of the documents in `counted` that labels names.

    Of documents that pass the fixed rules, a fifth by hash of the id is held back, and the
    least probability is the one that `keep` of the good ones there reach, never above a
    half. Up to `sample` documents the driver grows the trees; of more, tasks count (grow_spread), in bins
    whose borders are quantiles of all rows to a thousandth of their number. Null labels and
    ids teach nothing; an id that has two labels, or two texts, counts as often. With fewer
    than 20 of either kind there are no trees and no document is rejected.
    """
    told = labels.select(F.col(id_col).alias("doc_id"), label.cast("int").alias("label")).dropna()
    passed = counted.filter(~failed())
    named = passed.join(told, "doc_id").select("label", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("h"), *COUNTS)
    n, good = named.agg(F.count("*"), F.sum("label")).first()
    if min(good or 0, n - (good or 0)) < 20:
        return QualityModel(None, 0.0)
    if n > sample:
        return _trained_spread(named, keep)
    rows = np.array(named.orderBy("h", *COUNTS, "label").collect(), np.int64).reshape(-1, 2 + len(COUNTS))
    y = rows[:, 0].astype(float)
    x = features({c: rows[:, 2 + k] for k, c in enumerate(COUNTS)})
    held = rows[:, 1] % 5 == 0
    trees = grow(x[~held], y[~held], list(FEATURES.values()))
    good = np.sort(trees.probability(x[held & (y == 1)]))
    return QualityModel(trees, min(0.5, float(good[int((1 - keep) * len(good))])) if len(good) else 0.0)


def _trained_spread(named: DataFrame, keep: float) -> QualityModel:
    names = list(FEATURES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS})
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), *(pa.array(v) for v in x.T)], ["label", "h", *names])

    rows = persisted(named.mapInArrow(count, T.StructType([named.schema["label"], named.schema["h"], *(T.StructField(c, T.DoubleType()) for c in names)])), "labelled")
    taught, held = rows.filter("h % 5 <> 0"), rows.filter("h % 5 = 0 and label = 1")
    cuts = [np.unique(q) for q in taught.approxQuantile(names, np.linspace(0, 1, 65)[1:-1].tolist(), 1e-3)]
    trees = grow_spread(taught, names, cuts, float(taught.agg(F.avg("label")).first()[0]), list(FEATURES.values()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(trees.probability(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])))], ["p"])

    scored = held.select(*names).mapInArrow(score, "p double")
    least = scored.orderBy("p").limit(1 + int((1 - keep) * held.count())).agg(F.max("p")).first()[0]
    return QualityModel(trees, 0.0 if least is None else min(0.5, least))


def failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(counted: DataFrame, model: QualityModel) -> DataFrame:
    """counted with base_failed, `probability` of being good (null without trees) and kept."""
    shared = counted.sparkSession.sparkContext.broadcast(model)  # as large as the trees, whatever the rows

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value.trees
        for batch in batches:
            p = None if trees is None else trees.probability(features({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.float64()) if p is None else pa.array(p)], [*batch.schema.names, "probability"])

    out = counted.mapInArrow(score, T.StructType([*counted.schema.fields, T.StructField("probability", T.DoubleType())]))
    out = out.withColumn("base_failed", failed())
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("probability") >= model.least, F.lit(True)))


def quality_rules(docs: DataFrame, labels: DataFrame, label: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id`, COUNTS, base_failed, probability, kept: one for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text. A document with fewer than 20 words,
    or more than 30 per cent of its words in 8-word windows that the text repeats, fails;
    of the others those go that the trees find less probably good than nearly all good ones. Null
    texts are empty and fail. Repeated rows are judged alike; ids may be null, repeat and have any type;
    an empty table gives no rows; other columns are ignored. `label` (by default the column quality, 1: good) may be any
    condition over labels.
    """
    counted = persisted(document_statistics(docs, id_col, text_col), "statistics")
    return judge(counted, train_quality(counted, labels, F.col("quality") == 1 if label is None else label))
