"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(member | class, history). The most frequent
tokens form classes by rank and are members of their own; every other token is in a
class by its last byte and shares a member with those of its hash, among which it has
its smoothed corpus frequency. So features reach the whole vocabulary, and the model is
a distribution over all tokens and one unseen token for each shared member. The
features, hashed into fixed tables, are the last token, the last two, and the one
before the last (a skip). Learners, whose number and documents follow from the input
alone, update copies of the tables by stochastic gradients, and the updates are
averaged after every round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maregraph.llm.common import persisted, row_chunks

#: Classes of frequent tokens, members of each class, classes of other tokens.
HEAD_CLASSES, MEMBERS, TAIL_CLASSES = 32, 32, 24
#: Characters of text to a learner in a round, about, and most learners: what a round sends is bounded by theirs.
LEARN_CHARS, MOST_LEARNERS = 8_000_000, 96
#: Rows of each hashed weight table, rounds over disjoint parts of the documents, learning rate, tokens to a step.
ROWS, ROUNDS, RATE, STEP_TOKENS = 1 << 13, 3, 0.15, 4096
#: Characters of text to a block and distinct tokens of blocks to a range.
BLOCK_CHARS, RANGE_TOKENS = 6_000_000, 1_000_000
CLASSES = HEAD_CLASSES + TAIL_CLASSES
#: Class 0, member 0 is the end of a text.
END = 0
A1, A2, A3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def tail_code(token: bytes, token_hash: int) -> int:
    """Class (from HEAD_CLASSES on) and member of a token that isn't frequent, as class * MEMBERS + member."""
    return (HEAD_CLASSES + token[-1] % TAIL_CLASSES) * MEMBERS + (token_hash >> 20) % MEMBERS


@dataclass
class MaxEnt:
    head: dict[bytes, int]  # token -> class * MEMBERS + member
    class_bias: np.ndarray
    member_bias: np.ndarray  # CLASSES x MEMBERS; -inf where there is no member
    by_class: np.ndarray  # ROWS x CLASSES
    by_member: np.ndarray  # ROWS x MEMBERS
    tail_mass: np.ndarray  # by code: sums of (count + 0.5) of the tokens that share a member, with one unseen token


@dataclass
class Vocabulary:
    """Distinct tokens of some texts, and all positions: token numbers, an END (-1) after each text."""

    tokens: list[bytes]
    hashes: np.ndarray
    ids: np.ndarray
    ends: np.ndarray


def read_texts(texts: pa.Array, ordered: bool = False) -> Vocabulary:
    """ordered: tokens by hash (ties by bytes), the same in every run; else as they come."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words = split.flatten()
    some = pc.not_equal(words, "")  # what stands before the first space and after the last
    lens = np.diff(np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[split.offsets.to_numpy() - split.offsets[0].as_py()])
    coded = words.filter(some).dictionary_encode()
    tokens, flat = [], coded.indices.to_numpy().astype(np.int64)
    if len(coded.dictionary):
        tokens = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.binary())), pa.scalar(b" "))[0].as_py().split(b" ")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    if ordered and tokens:
        order = np.argsort(hashes, kind="stable")
        if (hashes[order[1:]] == hashes[order[:-1]]).any():
            order = np.array(sorted(order.tolist(), key=lambda k: (int(hashes[k]), tokens[k])))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        tokens, hashes, flat = [tokens[k] for k in order.tolist()], hashes[order], rank[flat]
    ends = np.cumsum(lens + 1) - 1
    ids = np.full(len(flat) + len(texts), -1, np.int64)
    mask = np.ones(len(ids), bool)
    mask[ends] = False
    ids[mask] = flat
    return Vocabulary(tokens, hashes, ids, ends)


def positions(v: Vocabulary, model: MaxEnt) -> tuple[np.ndarray, ...]:
    """Class and member of every position, and its rows for the three features of its history."""
    code = np.fromiter(map(model.head.get, v.tokens, repeat(-1)), np.int64, len(v.tokens))
    tail = np.flatnonzero(code < 0)
    code[tail] = np.fromiter((tail_code(v.tokens[k], h) for k, h in zip(tail.tolist(), v.hashes[tail].tolist(), strict=True)), np.int64, len(tail))
    cls, member = code // MEMBERS, code % MEMBERS
    # a last entry stands for END and, in histories, for what is before a text
    cls, member, h = np.append(cls, 0), np.append(member, 0), np.append(v.hashes, np.uint64(7))
    y, m, here = cls[v.ids], member[v.ids], h[v.ids]
    start = np.zeros(len(y), bool)
    start[v.ends[:-1] + 1] = True
    if len(start):
        start[0] = True
    one = np.where(start, np.uint64(7), np.concatenate([here[:1], here[:-1]]))
    two = np.where(start | np.concatenate([[True], start[:-1]])[: len(start)], np.uint64(7), np.concatenate([here[:2], here[:-2]])[: len(here)])
    shift = np.uint64(64 - (ROWS.bit_length() - 1))
    with np.errstate(over="ignore"):
        f1, f2, f3 = ((one * A1 + np.uint64(1)) * A2) >> shift, ((one * A1 + two * A3) * A2) >> shift, ((two * A3 + np.uint64(5)) * A1) >> shift
    return y, m, f1.astype(np.int64), f2.astype(np.int64), f3.astype(np.int64)


def member_row(f: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return (f * 5 + cls * 2654435761) % ROWS


def class_scores(model: MaxEnt, f1: np.ndarray, f2: np.ndarray, f3: np.ndarray) -> np.ndarray:
    z = model.by_class.take(f1, axis=0)
    z += model.by_class.take(f2, axis=0)
    z += model.by_class.take(f3, axis=0)
    z += model.class_bias
    return z


def member_scores(model: MaxEnt, cls: np.ndarray, f1: np.ndarray, f3: np.ndarray) -> np.ndarray:
    z = model.by_member.take(member_row(f1, cls), axis=0)
    z += model.by_member.take(member_row(f3, cls), axis=0)
    z += model.member_bias.take(cls, axis=0)
    return z


def _shifted(z: np.ndarray) -> np.ndarray:
    """Scores of the same softmax whose exponentials are finite and don't all vanish."""
    top = z.max(axis=1)
    if len(top) and (top.max() > 60 or top.min() < -60):
        z -= top[:, None]
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(_shifted(z), out=z)
    z /= (z @ np.ones(z.shape[1], np.float32))[:, None]
    return z


def _log_softmax_at(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of one place of each row's softmax, which itself may be too small for a float."""
    own = _shifted(z)[np.arange(len(z)), at].astype(np.float64)
    return own - np.log((np.exp(z, out=z) @ np.ones(z.shape[1], np.float32)).astype(np.float64))


def _sums(x: np.ndarray, order: np.ndarray, first: np.ndarray, singly: int = 6) -> np.ndarray:
    """Sums of x[order] over the runs that begin at `first`: members of most runs, which are short, are added place by place."""
    size = np.diff(first, append=len(order))
    out = x.take(order[first], axis=0)
    for k in range(1, singly):
        some = np.flatnonzero(size > k)
        if not len(some):
            return out
        out[some] += x.take(order[first[some] + k], axis=0)
    long = np.flatnonzero(size > singly)
    if len(long):
        rest = size[long] - singly
        begin = np.cumsum(rest) - rest
        tails = order[np.repeat(first[long] + singly - begin, rest) + np.arange(rest.sum())]
        out[long] += np.add.reduceat(x.take(tails, axis=0), begin, axis=0)
    return out


def _step(table: np.ndarray, seen: np.ndarray, rows: list[np.ndarray], gradient: np.ndarray, rate: float) -> None:
    """An adaptive gradient step on the rows of the table that the examples' features fall into."""
    for own in rows:
        order = np.argsort(own.astype(np.uint16), kind="stable")
        ranked = own[order]
        first = np.concatenate([[0], 1 + np.flatnonzero(ranked[1:] != ranked[:-1])])
        summed, at = _sums(gradient, order, first), ranked[first]
        seen[at] += np.einsum("ij,ij->i", summed, summed) / summed.shape[1]
        table[at] -= summed * (rate / np.sqrt(seen[at] + 1e-2))[:, None]


def train_on(model: MaxEnt, seen: tuple[np.ndarray, np.ndarray], texts: pa.Array, rate: float) -> int:
    v = read_texts(texts)
    y, m, f1, f2, f3 = positions(v, model)
    for lo in range(0, len(y), STEP_TOKENS):
        cut = slice(lo, lo + STEP_TOKENS)
        yc, mc, a, b, c = y[cut], m[cut], f1[cut], f2[cut], f3[cut]
        g, gm = _softmax(class_scores(model, a, b, c)), _softmax(member_scores(model, yc, a, c))
        g[np.arange(len(yc)), yc] -= 1
        gm[np.arange(len(yc)), mc] -= 1
        _step(model.by_class, seen[0], [a, b, c], g, rate)
        _step(model.by_member, seen[1], [member_row(a, yc), member_row(c, yc)], gm, rate)
    return len(y)


def log10_probabilities(model: MaxEnt, v: Vocabulary, counts: np.ndarray) -> np.ndarray:
    """log10 P of every position; counts: of v.tokens in training."""
    y, m, f1, f2, f3 = positions(v, model)
    out = np.empty(len(y))
    inside = np.log(np.append(counts, 0) + 0.5)
    for lo in range(0, len(y), STEP_TOKENS):
        cut = slice(lo, lo + STEP_TOKENS)
        yc, mc, a, b, c = y[cut], m[cut], f1[cut], f2[cut], f3[cut]
        p = _log_softmax_at(class_scores(model, a, b, c), yc) + _log_softmax_at(member_scores(model, yc, a, c), mc)
        t = np.flatnonzero(yc >= HEAD_CLASSES)
        p[t] += inside[v.ids[cut][t]] - np.log(model.tail_mass[yc[t] * MEMBERS + mc[t]])
        out[cut] = p / np.log(10)
    return out


def new_model(head: list[tuple[bytes, int]], n_end: int, tail_mass: np.ndarray) -> MaxEnt:
    """Untrained: biases that give the head tokens, and the members that others share, their frequencies. tail_mass: by code."""
    ranked = [(b"", n_end), *head]
    mass = np.array(tail_mass, np.float64)
    mass[: HEAD_CLASSES * MEMBERS] = 0
    mass[: len(ranked)] = [c + 0.5 for _, c in ranked]
    mass = mass.reshape(CLASSES, MEMBERS)
    with np.errstate(divide="ignore"):
        class_bias, member_bias = np.log(mass.sum(axis=1) / mass.sum()), np.log(mass)
    return MaxEnt({t: k for k, (t, _) in enumerate(ranked) if k}, class_bias.astype(np.float32), member_bias.astype(np.float32), np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, MEMBERS), np.float32), tail_mass)


def _blocks(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-chars // BLOCK_CHARS))))), chars


def _count(rows: DataFrame, chars: int) -> DataFrame:
    """Training counts of all tokens, by hash range: packed answers for the blocks, the range's most frequent tokens and its sums."""
    bits = max(0, (chars // 30 // RANGE_TOKENS).bit_length())

    def send(table: pa.Table) -> pa.Table:
        held = np.array(table["held_out"].to_pylist(), bool)
        v = read_texts(table["text"].combine_chunks(), ordered=True)
        in_training = np.repeat(~held, np.diff(v.ends, prepend=-1))
        counts = np.bincount(v.ids[in_training & (v.ids >= 0)], minlength=len(v.tokens)).astype("<u4")
        ranges = (v.hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(v.tokens), np.int64)
        cuts = np.searchsorted(ranges, np.arange((1 << bits) + 1))
        spans = [(r, lo, hi) for r, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        return pa.table({
            "part": pa.array([r for r, _, _ in spans], pa.int64()),
            "block": pa.array([table["block"][0].as_py()] * len(spans), pa.int64()),
            "tokens": pa.array([b" ".join(v.tokens[lo:hi]) for _, lo, hi in spans], pa.binary()),
            "counts": pa.array([counts[lo:hi].tobytes() for _, lo, hi in spans], pa.binary()),
        })

    def tally(table: pa.Table) -> pa.Table:
        number: dict[bytes, int] = {}
        at, n = [], []
        for tokens, counts in zip(table["tokens"].to_pylist(), table["counts"].to_pylist(), strict=True):
            own = tokens.split(b" ")
            for t in own:
                if t not in number:
                    number[t] = len(number)
            at.append(np.fromiter(map(number.__getitem__, own), np.int64, len(own)))
            n.append(np.frombuffer(counts, "<u4"))
        total = np.bincount(np.concatenate(at), np.concatenate(n), len(number)).astype(np.int64)
        names = list(number)
        top = sorted(np.flatnonzero(total > 0).tolist(), key=lambda k: (-total[k], names[k])) if len(total) <= 4 * HEAD_CLASSES * MEMBERS else None
        if top is None:
            least = np.partition(total, -HEAD_CLASSES * MEMBERS)[-HEAD_CLASSES * MEMBERS]
            top = sorted(np.flatnonzero((total > 0) & (total >= least)).tolist(), key=lambda k: (-total[k], names[k]))
        top = top[: HEAD_CLASSES * MEMBERS - 1]
        tail = np.fromiter((tail_code(t, xxhash.xxh3_64_intdigest(t)) for t in names), np.int64, len(names))
        live = total > 0
        mass = np.bincount(tail[live], total[live] + 0.5, CLASSES * MEMBERS)
        answers = len(at)
        pad = [None] * (len(top) + 1)
        return pa.table({
            "part": pa.array([*table["part"].to_pylist(), *pad], pa.int64()),
            "block": pa.array([*table["block"].to_pylist(), *pad], pa.int64()),
            "counts": pa.array([*(total[a].astype("<i8").tobytes() for a in at), *pad], pa.binary()),
            "token": pa.array([*[None] * answers, *(names[k] for k in top), None], pa.binary()),
            "n": pa.array([*[None] * answers, *(int(total[k]) for k in top), int(total.sum())], pa.int64()),
            "distinct": pa.array([*[None] * (answers + len(top)), int(live.sum())], pa.int64()),
            "mass": pa.array([*[None] * (answers + len(top)), mass], pa.list_(pa.float64())),
        })

    sent = rows.groupBy("block").applyInArrow(send, "part long, block long, tokens binary, counts binary")
    return sent.groupBy("part").applyInArrow(tally, "part long, block long, counts binary, token binary, n long, distinct long, mass array<double>")


def _train(spark: SparkSession, rows: DataFrame, model: MaxEnt, rounds: int, chars: int) -> None:
    """Rounds over disjoint parts of the training documents; learners' updates are averaged by the tokens they read."""
    learn = rows.filter("not held_out").select("doc_id", "text", F.xxhash64("text").alias("h"), F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(rounds)).alias("turn"))
    learners = max(1, min(MOST_LEARNERS, chars // rounds // LEARN_CHARS))
    learn = learn.withColumn("learner", F.pmod(F.xxhash64("doc_id", "h"), F.lit(learners)))

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def updates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            old = shared.value  # noqa: B023
            own = MaxEnt(old.head, old.class_bias, old.member_bias, old.by_class.copy(), old.by_member.copy(), old.tail_mass)
            seen, n = (np.zeros(ROWS, np.float32), np.zeros(ROWS, np.float32)), 0
            who = None
            for batch in batches:
                for part in row_chunks(batch, 1):
                    who = part.column(0)[0].as_py()
                    n += train_on(own, seen, part.column(1), RATE)
            if n:
                change = np.concatenate([own.by_class - old.by_class, own.by_member - old.by_member], axis=1)
                pieces = np.array_split(change, 32)
                yield pa.RecordBatch.from_arrays([pa.array(range(32), pa.int64()), pa.array([who] * 32, pa.int64()), pa.array([n] * 32, pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["piece", "who", "n", "change"])

        def averaged(table: pa.Table) -> pa.Table:
            table = table.sort_by("who")  # so that sums don't depend on what came first
            n = np.array(table["n"].to_pylist(), np.float64)
            total = sum(w * np.frombuffer(b, np.float32) for w, b in zip(n / n.sum(), table["change"].to_pylist(), strict=True))
            return pa.table({"piece": table["piece"][:1], "change": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        # a learner reads its documents batch by batch, in an order of their own
        dealt = learn.filter(F.col("turn") == turn).repartition("learner").sortWithinPartitions("learner", "doc_id", "h")
        sent = dealt.select("learner", "text").groupBy("learner").applyInArrow(updates, "piece long, who long, n long, change binary")
        got = sorted(sent.groupBy("piece").applyInArrow(averaged, "piece long, change binary").collect(), key=lambda r: r["piece"])
        shared.unpersist()
        if got:
            change = np.frombuffer(b"".join(r["change"] for r in got), np.float32).reshape(ROWS, CLASSES + MEMBERS)
            model.by_class += change[:, :CLASSES]
            model.by_member += change[:, CLASSES:]


def score_documents(docs: DataFrame, held_out: Column, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`, one for each row of docs.

    Tokens are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, and an end; a null
    text is empty and has the end alone. Counts come from all rows not held out.
    base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))); score is the model's log10
    probability of the whole text, the same for any cluster and any files. Repeated rows
    count and are scored each. Without training rows N and V are 0 and both scores
    follow from the same formulas; an empty table gives no rows. A text longer than a
    block is a block of its own. Ids are cast to long; other columns are ignored.
    """
    spark = docs.sparkSession
    rows, chars = _blocks(docs, held_out, id_col, text_col)
    counted = persisted(_count(rows, chars), "token-counts")
    n_end = rows.filter("not held_out").count()
    sums = counted.filter("mass is not null")
    n_words, distinct = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    tail_mass = np.full(CLASSES * MEMBERS, 0.5)
    for r in sums.select(F.posexplode("mass").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        tail_mass[r["k"]] += r["x"]
    head = [(bytes(r["token"]), r["n"]) for r in counted.filter("token is not null").select("token", "n").orderBy(F.desc("n"), "token").limit(HEAD_CLASSES * MEMBERS - 1).collect()]
    for token, c in head:
        tail_mass[tail_code(token, xxhash.xxh3_64_intdigest(token))] -= c + 0.5
    model = new_model(head, n_end, np.maximum(tail_mass, 0.5))
    _train(spark, rows, model, rounds, chars)
    shared = spark.sparkContext.broadcast(model)
    total, types = n_words + n_end, distinct + (n_end > 0)

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        v = read_texts(table["text"].combine_chunks(), ordered=True)
        packed = answers.sort_by("part")["counts"].to_pylist() if answers.num_rows else []
        counts = np.frombuffer(b"".join(packed), "<i8")
        every = np.append(counts, n_end)
        c = every[v.ids]
        begin = np.concatenate([[0], v.ends[:-1] + 1])
        base = np.log10((every + 0.5) / (total + 0.5 * (types + 1)))[v.ids]
        own = log10_probabilities(shared.value, v, counts)
        rows_of = lambda x: np.add.reduceat(x, begin)
        return pa.table({
            "doc_id": table["doc_id"], "held_out": table["held_out"],
            "n_tokens": pa.array(v.ends - begin + 1, pa.int64()), "n_known": pa.array(rows_of((c > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(begin), total), pa.int64()), "base_score": pa.array(rows_of(base)), "score": pa.array(rows_of(own)),
        })

    answers = counted.filter("block is not null").select("part", "block", "counts")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, out)
