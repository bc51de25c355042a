"""Quality rules, hard negatives and conversation tries against brute force, with the odd rows each must stand."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maregraph.llm import hard_negatives, prefix_trie, quality_rules
from maregraph.llm.common import crc_mod
from maregraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n_words long, kept int, label int, probability string"


def plain_statistics(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def odd_texts():
    rng = random.Random(3)
    loops = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(60)]
    lines = ["\n".join(rng.choice(["x y", "x y ", "", " \t", "z|z", "é#"]) for _ in range(12)) for _ in range(20)]
    return [None, "", " \n\t", "a", "a\x1cb \x85 c\x0bd", "wort " * 7, "wort " * 8, "wort " * 9, "näïve ###\r\nnäïve ###\r\n", "lorem ipsum dolor " * 30_000, *loops, *lines]


def test_statistics_of_texts():
    texts = [*odd_texts(), *odd_texts()]
    found = quality_rules.statistics(pa.array(texts, pa.string()))
    want = [plain_statistics(t) for t in texts]
    got = list(zip(*(found[c].tolist() for c in quality_rules.COUNTS[:5]), strict=True))
    assert got == want


def test_trees_keep_their_directions_and_agree_with_a_walk():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + 0.3 * np.sin(4 * x[:, 0]) - x[:, 1] + np.abs(x[:, 2]) + rng.normal(scale=0.5, size=3000) > 0).astype(float)
    trees = quality_rules.grow(x, y, [1, -1, 0])
    p = trees.probability(x)
    assert ((p > 0.5) == y).mean() > 0.85
    for feature, direction in ((0, 1), (1, -1)):
        at = np.repeat(rng.normal(size=(50, 3)), 200, axis=0)
        at[:, feature] = np.tile(np.linspace(-4, 4, 200), 50)
        steps = np.diff(trees.margin(at).reshape(50, 200), axis=1) * direction
        assert steps.min() >= -1e-12
    free = quality_rules.grow(x, y, [0, 0, 0])
    at = np.repeat(rng.normal(size=(50, 3)), 200, axis=0)
    at[:, 0] = np.tile(np.linspace(-4, 4, 200), 50)
    assert np.diff(free.margin(at).reshape(50, 200), axis=1).min() < 0  # so the constraint does something

    def walk(row):
        total = trees.base
        for node in trees.roots.tolist():
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return total

    assert np.allclose([walk(r) for r in x[:100]], trees.margin(x[:100]))


def test_trees_of_spread_rows_are_those_of_the_driver(spark, monkeypatch):
    """However rows are dealt, all of them are counted: the trees are grow()'s in the same bins."""
    monkeypatch.setattr(quality_rules, "SHARD", 100)
    monkeypatch.setattr(quality_rules, "REFRESH", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 3)).round(1)
    y = (x[:, 0] - x[:, 1] + np.abs(x[:, 2]) + rng.normal(scale=0.7, size=2000) > 0).astype(float)
    cuts = quality_rules.borders(x, 16)
    want = quality_rules.grow(x, y, [1, -1, 0], rounds=7, cuts=cuts)
    df = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y, strict=True)], "label int, a double, b double, c double")
    got = [quality_rules.grow_spread(rows, ["a", "b", "c"], cuts, float(y.mean()), [1, -1, 0], rounds=7) for rows in (df.repartition(5), df.coalesce(1))]
    assert all(np.allclose(t.margin(x), want.margin(x), atol=1e-6) for t in got)
    assert np.array_equal(got[0].margin(x), got[1].margin(x))


def test_quality_is_learned_from_every_label(spark, monkeypatch):
    """More labels than the driver takes are all counted, none is left out."""
    seen, given = [], quality_rules.grow_spread
    monkeypatch.setattr(quality_rules, "grow_spread", lambda rows, *a: (seen.append(rows.count()), given(rows, *a, rounds=2))[1])
    rng = np.random.default_rng(6)
    rows = [(i, *(int(v) for v in rng.integers(20, 90, len(quality_rules.COUNTS)))) for i in range(600)]
    rows = [(r[0], 100, *r[2:5], 0, *r[6:]) for r in rows]
    counted = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    labels = spark.createDataFrame([(r[0], int(r[3] < 50)) for r in rows], "doc_id long, quality int")
    model = quality_rules.train_quality(counted, labels, F.col("quality") == 1, sample=100)
    held = counted.filter("pmod(pmod(xxhash64(doc_id), 1099511627776), 5) = 0").count()
    assert seen == [600 - held] and 60 < held < 180 and 0 < model.least <= 0.5
    good = quality_rules.judge(counted, model).join(labels, "doc_id").filter("quality = 1").collect()
    assert sum(r.kept for r in good) >= 0.95 * len(good)


def test_quality_rules_over_whole_table(spark):
    got = {r.doc_id: r for r in QUERIES["op11_quality_rules"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, (n, chars, symbols, lines, words) = got[d.doc_id], plain_statistics(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, words)
        assert r.base_failed == (n < 20 or 100 * words > 30 * n)
        assert not (r.base_failed and r.kept)


def test_quality_verdicts_hold_out(spark):
    """At sf0.01: trees of four fifths of the labels reject bad documents of the rest and keep good ones."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    counted = quality_rules.document_statistics(docs)
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0
    model = quality_rules.train_quality(counted, labels.filter(~held), F.col("quality") == 1)
    rows = quality_rules.judge(counted, model).filter("not base_failed").join(labels.filter(held), "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 30 and sum(good) >= 0.97 * len(good)
    assert len(bad) > 3 and sum(bad) <= 0.2 * len(bad)


def test_quality_odd_rows(spark):
    texts = odd_texts()
    rows = [(i, t, 7, 7, 7, "x") for i, t in enumerate(texts)] + [(None, "a b", 7, 7, 7, "x"), (1, "", 7, 7, 7, "x"), (1, "", 7, 7, 7, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs, none).collect()  # no labels: the fixed rules alone decide
    assert len(got) == len(rows) and all(r.kept == (not r.base_failed) for r in got) and all(r.probability is None for r in got)
    assert quality_rules.quality_rules(docs.limit(0), none).count() == 0
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc.id"), F.col("text").alias("the text"))
    assert quality_rules.quality_rules(named, none.limit(0), id_col="`doc.id`", text_col="`the text`").count() == len(rows)


# hard negatives
VECTORS = "vec_id long, embedding array<double>, label long, i int, j int, k int, rank int, row string"


def plain_negatives(rows, anchor, positives=5, negatives=3, low=50, high=95, width=None):
    best = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i not in best or (label, v) < best[i]:
            best[i] = (label, v)
    width = max((len(v) for _, v in best.values()), default=1)
    limit = math.isqrt((2**63 - 1) // max(1, width))
    whole = {i: [max(-limit, min(limit, math.floor(256 * x) if math.isfinite(256 * x) else int(math.copysign(limit, x)))) for x in v] for i, (_, v) in best.items()}
    out = []
    for a in filter(anchor, best):
        scored = sorted(((-sum(x * y for x, y in zip(whole[a], whole[b], strict=False)), b) for b in best if b != a))
        for s, p in [x for x in scored if best[x[1]][0] == best[a][0]][:positives]:
            hard = [(t, b) for t, b in scored if best[b][0] != best[a][0] and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, r, b, -s, -t) for r, (t, b) in enumerate(hard, 1)]
    return sorted(out)


def vector_rows(n=150, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 11))
    rows = [(i, (centres[i % 4] + rng.normal(scale=1.2, size=11)).tolist(), int(rng.choice([0, 0, 0, 0, 1, 2, -3, 40 + i])), 1, 1, 1, 1, "x") for i in range(n)]
    same = [1.0] * 11
    rows += [(1000 + k, same, k % 2, 1, 1, 1, 1, "x") for k in range(40)]  # ties, and a hot vector
    rows += [rows[10], (20, same, 5, 1, 1, 1, 1, "x"), (3000, None, 1, 1, 1, 1, 1, "x"), (3010, [1.0, None], 1, 1, 1, 1, 1, "x"), (3020, [float("nan")] * 11, 1, 1, 1, 1, 1, "x")]
    rows += [(3030, [float("inf")] * 11, 1, 1, 1, 1, 1, "x"), (None, same, 1, 1, 1, 1, 1, "x"), (3040, same, None, 1, 1, 1, 1, "x"), (3050, [], 0, 1, 1, 1, 1, "x"), (3060, [2.0, 1.0], 0, 1, 1, 1, 1, "x"), (3070, [0.5] * 40, 1, 1, 1, 1, 1, "x"), (3080, [0.0] * 11, 0, 1, 1, 1, 1, "x")]
    return rows


@pytest.mark.parametrize(("block", "anchor_block", "dims"), [(4096, 256, 32), (17, 4, 3)])
def test_hard_negatives_against_all_pairs(spark, block, anchor_block, dims):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, block=block, anchor_block=anchor_block, dims=dims)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_huge_components(spark):
    rows = [(k, [s * m, 1.0, 0.3 * k], k % 3, 1, 1, 1, 1, "x") for k, (s, m) in enumerate((s, m) for s in (1.0, -1.0) for m in (1e308, 1e18, 1e9, 3e7, 1.0, 5e-324))]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.lit(True), dims=2)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows, lambda i: True)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame(vector_rows(20), VECTORS)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(None).cast("boolean")).count() == 0


def test_hard_negatives_move_vectors_not_scores(spark, tmp_path, monkeypatch):
    """What tasks send for a pair of blocks is its vectors: the bytes grow with the rows, not with anchors times rows."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    sizes, given = {}, hard_negatives.met
    monkeypatch.setattr(hard_negatives, "met", lambda left, right, *rest: sent.append((left, right)) or given(left, right, *rest))
    for n in (2000, 8000):
        sent = []
        rows = spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.sin(F.col("id") * (k + 1)) / 8).alias("embedding"), (F.col("id") % 10).alias("label"))
        assert hard_negatives.mine(rows, F.col("vec_id") % 4 == 0).count() > 0
        sizes[n] = sum(side.select(F.sum(F.size("to") * F.length("cells"))).first()[0] for pair in sent for side in pair)
    assert sizes[8000] < 4.5 * sizes[2000] < 8000 * 2000 * 2


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (100, 1 << 27):
        x, y = (rng.integers(-most, most, (7, 9)) for _ in range(2))
        assert (hard_negatives.product(x, y) == np.array([[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in y] for u in x])).all()


# conversation tries
TURNS = "conv_id long, turn long, role string, text string, key int, depth int, edge string"


def plain_trie(rows, heads=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if heads else 0
        built[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(total[k][0] for k in children[node]) or 1
        words = len(WORD.findall(node[-1][1])) if node else 0
        total[node] = leaves, (len(members[node]) - 1) * words + sum(total[k][1] for k in children[node])
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), *total[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items()
    )


def turn_rows(seed=4, n=260):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        hot = c % 3 == 0  # a third share a long beginning, some of them all of it
        path = ["sys prompt here", "b c", "d"] * 4 if hot else []
        path = path[: rng.randrange(len(path) + 1)] if c % 2 else path
        path += [rng.choice(["x", "y y", "", None, " z\x0b"]) for _ in range(rng.choice([0, 1, 2, 3, 9]))]
        rows += [(c, t if t else None, "user" if t % 2 else rng.choice(["user", None, ""]), text, 1, 1, "e") for t, text in enumerate(path)]
    rows += [(1000, t, "user", f"long {t % 7}", 1, 1, "e") for t in range(500)] + [(1001, t, "user", f"long {t % 7}", 1, 1, "e") for t in range(450)]
    rows += [(None, 1, "user", "lost", 1, 1, "e"), (2000, 1, "user", "tie a", 1, 1, "e"), (2000, 1, "user", "tie b", 1, 1, "e"), (2000, 1, "user", "tie b", 1, 1, "e"), (2001, 5, None, "word " * 50_000, 1, 1, "e")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("run_bytes", "fan_in", "sweep", "ranges"), [(prefix_trie.RUN, 256, 1000, None), (2000, 2, 3, 20), (1, 3, 2, 60), (500, 256, 1000, 1)])
def test_trie_against_brute_force(spark, run_bytes, fan_in, sweep, ranges):
    rows = turn_rows()
    convs = prefix_trie.conversations(spark.createDataFrame(rows, TURNS).repartition(3))
    got = prefix_trie.prefix_trie(prefix_trie.with_heads(convs, 20, crc_mod("conv_id", 4), 3), run_bytes, fan_in, sweep, ranges)
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got.collect()) == plain_trie(rows)


def test_trie_without_heads_and_of_nothing(spark):
    rows = turn_rows(9, 40)
    df = spark.createDataFrame(rows, TURNS)
    got = prefix_trie.prefix_trie(prefix_trie.conversations(df)).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == plain_trie(rows, heads=False)
    assert prefix_trie.prefix_trie(prefix_trie.conversations(df.limit(0))).count() == 0


def test_loser_tree_merges_and_compares_no_shared_turn_twice():
    rng = random.Random(8)
    turn = [hashlib.sha256(bytes([k])).digest() for k in range(4)]
    for n_runs in (1, 2, 3, 5, 8, 13):
        seqs = [[b"".join(rng.choice(turn) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(40))] for _ in range(n_runs)]
        sorted_runs = [list(prefix_trie.sorted_run([(s, bytes(len(s) // 8), k) for k, s in enumerate(r)])) for r in seqs]
        tree = prefix_trie.LoserTree([iter(r) for r in sorted_runs])
        got = list(prefix_trie.distinct(iter(tree)))
        everything = Counter(s for r in seqs for s in r)
        assert [r[1] for r in got] == sorted(everything) and all(r[3] == everything[r[1]] for r in got)
        before = b""
        for known, s, *_ in got:
            assert known == prefix_trie.shared_turns(before, s)
            before = s
        piece = {k: v[0] for k, v in prefix_trie.packed(iter(got)).items()}
        assert list(prefix_trie.records(piece)) == got
    deep = [[(0 if k == 0 else 100, b"".join(turn[:1] * 100 + [bytes([k, r]) * 16]), bytes(404), 1, k) for k in range(50)] for r in range(8)]
    tree = prefix_trie.LoserTree([iter(r) for r in deep])
    assert len(list(tree)) == 400 and tree.compared < 100 * 8 + 400 * 4 * 2  # the shared 100 turns once a run, not once a match


def test_conversation_trie_over_whole_table(spark):
    """The registered query against brute force over all turns at sf0.01."""
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_prefix_trie"](spark, sf).collect()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in got) == plain_trie(rows)


# memory of the word memos
GROWN = """
import base64, random, re, sys
import pyarrow as pa
sys.path.insert(0, {repo!r})
import public_tokenizers
from maregraph.llm import packing, token_counts
def high():
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
rng = random.Random(1)
text = lambda n: " ".join(base64.b64encode(rng.randbytes(6144)).decode() for _ in range(n))
encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
before = high()
for n in (250, 250, 250, 250, 1000):
    got, ends = encoder.encode(pa.array([text(n), None, "a b"]))
    assert ends[0] == ends[1] == len(got) - 2
print(high() - before, encoder.words.size >> 20, encoder.runs.size >> 20)
"""


def test_memos_are_bounded_in_bytes():
    import subprocess
    import sys
    from pathlib import Path

    pytest.importorskip("public_tokenizers")
    out = subprocess.run([sys.executable, "-c", GROWN.format(repo=str(Path(__file__).parents[2]))], capture_output=True, text=True, check=True, timeout=600).stdout
    grown, words, runs = map(int, out.split())
    assert grown < 300 and words < 80 and runs < 80


def test_long_texts_are_read_in_parts(spark):
    """A text of many parts has the ids and counts of the whole one."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from maregraph.llm import packing, token_counts

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(2)
    text = " ".join(rng.choice(["wort", "Zeit,", "\n\n", "x" * 9000, "naïve", "漢字", "\t"]) for _ in range(8000))
    ids, ends = packing.WordEncoder(path).encode(pa.array([None, "a b", text, ""]))
    whole = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert ids[ends[1] : ends[2]].tolist() == whole and ends[3] == len(ids)
    pieces = token_counts.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    automaton = token_counts.Automaton(pieces, "▁")
    each = [automaton.count(w.decode()) for w in text.encode().split()]
    got = token_counts.token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), pieces).first()
    assert (got.n_words, got.n_tokens, got.n_unknown) == (len(each), sum(n if n >= 0 else 1 for n in each), each.count(-1))


def test_near_vectors_whose_ids_repeat(spark):
    """Rows that share an id but not a vector are rows of their own."""
    from maregraph.llm.embedding_dedup import near_duplicates

    rng = np.random.default_rng(6)
    bases = rng.normal(size=(12, 8))
    rows = [(int(rng.integers(0, 15)), (bases[rng.integers(0, 12)] * rng.uniform(0.5, 2) + rng.normal(scale=0.08, size=8)).tolist()) for _ in range(90)]
    rows += [(1, [1.0] + [0.0] * 7), (1, [0.0] * 7 + [1.0]), (2, [1.0, 0.1] + [0.0] * 6), rows[0], rows[0]]
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    reach = [*range(len(rows))]
    for _ in rows:
        for a, b in zip(*np.nonzero(link), strict=True):
            reach[a] = reach[b] = min(reach[a], reach[b])
    least = defaultdict(lambda: 1 << 60)
    for k, root in enumerate(reach):
        least[root] = min(least[root], rows[k][0])
    want = Counter((i, int(link[k].sum()), least[reach[k]], i == least[reach[k]]) for k, (i, _) in enumerate(rows))
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(map(tuple, got)) == want
