"""The trie of conversation prefixes, from an external mergesort that knows shared turns.

Every turn is named by the digest of its role and text, a conversation is the sequence of
its turns' digests. Tasks sort what they hold into runs; a record of a run carries the
number of turns it shares with the one before it, and only its other turns. Runs are cut
at splitters into pieces, one row for each range and run. A range's pieces are merged, a
bounded number at a time, by a loser tree that compares turns only beyond those already
known to be shared. The last merge feeds a stack of open nodes: what a record leaves is
finished and goes out. Only nodes on the first and last path of a range may go on in
another range; these edges are swept in order in the same way.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maregraph.llm.common import looked_up, persisted, salts_for

#: Bytes of a digest, of digests to a run, pieces to a merge, ranges to a sweep of edges.
D, RUN, FAN_IN, SWEEP = 32, 32 << 20, 256, 1000
#: Neighbouring ids whose decimals are joined to one string before they are hashed.
IDS = 512
ROOT = bytes(D)
WORD = r"[^\x20\x09-\x0D]+"
PIECE = "range int, run long, shared binary, turns binary, suffix binary, words binary, counts binary, least binary"
NODE = "key binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, parent_key binary, edge boolean, range int, at int, words long"

#: A record: turns shared with the record before, digests, words of each turn (int32), conversations, the least id.
Record = tuple[int, bytes, bytes, int, int]


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows `conv_id, turns`: each conversation's turns in order, as `turn, digest, words`.

    Null turns come first; turns of one number follow by digest. A null role or text is
    empty; rows without a conversation's id go.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    one = F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"))
    named = turns.select(F.col(conv_col).cast("long").alias("conv_id"), one.alias("one")).filter("conv_id is not null")
    return named.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def with_heads(convs: DataFrame, every: int, n: Column, most: int) -> DataFrame:
    """conversations() whose first n turns (at most `most`) are those of the conversation whose id is the last multiple of `every`."""
    head = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    both = convs.join(head, F.col("conv_id") - F.col("conv_id") % every == F.col("_base"), "left")
    none = F.slice("turns", 1, 0)
    first, own = F.slice(F.coalesce("_head", none), F.lit(1), n), F.slice("turns", n + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(first, own).alias("turns"))


def sequences(convs: DataFrame) -> DataFrame:
    """Rows `conv_id, digests, words, key`: packed digests and word counts, and the key of the node where the conversation ends."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, words, keys = [], [], []
            lists = batch.column(1)
            turns, ends = lists.flatten(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            each, counts = turns.field("digest").to_pylist(), turns.field("words").to_numpy(zero_copy_only=False).astype(np.int32)
            for a, b in zip(ends, ends[1:], strict=False):
                key = ROOT
                for digest in each[a:b]:
                    key = hashlib.sha256(key + digest).digest()
                digests.append(b"".join(each[a:b]))
                words.append(counts[a:b].tobytes())
                keys.append(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in (digests, words, keys))], ["conv_id", "digests", "words", "key"])

    slim = F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return convs.select("conv_id", slim.alias("turns")).mapInArrow(pack, "conv_id long, digests binary, words binary, key binary")


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that both begin with, of which `known` are known."""
    most = min(len(a), len(b)) // D
    while known < most and a[D * known : D * known + D] == b[D * known : D * known + D]:
        known += 1
    return known


def packed(records: Iterator[Record]) -> dict[str, list[bytes]]:
    """A piece: of each record only the turns that it doesn't share with the one before."""
    shared, turns, suffix, words, counts, least = [], [], [], [], [], []
    for known, digests, n_words, n, first in records:
        shared.append(known)
        turns.append(len(digests) // D - known)
        suffix.append(digests[D * known :])
        words.append(n_words[4 * known :])
        counts.append(n)
        least.append(first)
    ints = lambda x, kind=np.int64: np.array(x, kind).tobytes()
    return {"shared": [ints(shared, np.int32)], "turns": [ints(turns, np.int32)], "suffix": [b"".join(suffix)], "words": [b"".join(words)], "counts": [ints(counts)], "least": [ints(least)]}


def records(piece: dict) -> Iterator[Record]:
    """The records of a piece, whole again."""
    shared, turns = (np.frombuffer(piece[c], np.int32).tolist() for c in ("shared", "turns"))
    counts, least = (np.frombuffer(piece[c], np.int64).tolist() for c in ("counts", "least"))
    digests, words, at = b"", b"", 0
    for known, more, n, first in zip(shared, turns, counts, least, strict=True):
        digests = digests[: D * known] + piece["suffix"][D * at : D * (at + more)]
        words = words[: 4 * known] + piece["words"][4 * at : 4 * (at + more)]
        at += more
        yield known, digests, words, n, first


class LoserTree:
    """Sorted runs merged to one. Each run's head knows how many turns it shares with the last record that went out.

    Of two heads the one that shares more comes first; only where both share as many are
    turns compared, from there on. A match's loser stays at its node of the tree with what
    it shares with the winner, so no shared turn is compared twice.
    """

    def __init__(self, runs: list[Iterator[Record]]) -> None:
        self.runs = runs
        self.heads: list[Record | None] = [next(r, None) for r in runs]
        self.shared = [0] * len(runs)
        self.compared = 0
        k = len(runs)
        self.losers = [0] * k
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            winners[node], self.losers[node] = self._match(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if k > 1 else 0

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = self.heads[a], self.heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if self.shared[a] != self.shared[b]:
            return (a, b) if self.shared[a] > self.shared[b] else (b, a)
        known = shared_turns(x[1], y[1], self.shared[a])
        self.compared += known - self.shared[a] + 1
        first, last = (a, b) if x[1][D * known : D * known + D] <= y[1][D * known : D * known + D] else (b, a)
        self.shared[last] = known
        return first, last

    def __iter__(self) -> Iterator[Record]:
        k = len(self.runs)
        while k and self.heads[self.winner] is not None:
            w = self.winner
            _, digests, words, n, first = self.heads[w]
            yield self.shared[w], digests, words, n, first
            self.heads[w] = following = next(self.runs[w], None)
            self.shared[w] = following[0] if following else 0
            node = (w + k) // 2
            while node:
                w, self.losers[node] = self._match(w, self.losers[node])
                node //= 2
            self.winner = w


def distinct(merged: Iterator[Record]) -> Iterator[Record]:
    """One record for each sequence: equal ones add up and keep the least id."""
    held = None
    for known, digests, words, n, first in merged:
        if held and D * known == len(digests) == len(held[1]):
            held = held[0], digests, words, held[3] + n, min(held[4], first)
        else:
            if held:
                yield held
            held = known, digests, words, n, first
    if held:
        yield held


def merged(pieces: pa.Table) -> Iterator[Record]:
    return distinct(iter(LoserTree([records(p) for p in pieces.to_pylist()])))


def sorted_run(rows: list[tuple[bytes, bytes, int]]) -> Iterator[Record]:
    """Rows `digests, words, id` as distinct records in order."""

    def each() -> Iterator[Record]:
        before = b""
        for digests, words, i in sorted(rows):
            yield shared_turns(before, digests), digests, words, 1, i
            before = digests

    return distinct(each())


def runs(seqs: DataFrame, splitters: list[bytes], run_bytes: int) -> DataFrame:
    """PIECE rows: each task's sequences sorted in runs of about run_bytes of digests and cut at the splitters."""
    shared = seqs.sparkSession.sparkContext.broadcast(splitters)  # fewer than the root of the input's bytes

    def cut(rows: list[tuple[bytes, bytes, int]], run: int) -> Iterator[pa.RecordBatch]:
        held: list[Record] = []
        at = -1
        for record in sorted_run(rows):
            place = bisect_right(shared.value, record[1])
            if place != at:
                if held:
                    yield piece(at, run, held)
                at, held = place, []
                record = 0, *record[1:]
            held.append(record)
        if held:
            yield piece(at, run, held)

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, n = [], 0, 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for digests, words, i in zip(batch.column("digests").to_pylist(), batch.column("words").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                rows.append((digests, words, i))
                size += len(digests) + 100
                if size >= run_bytes:
                    yield from cut(rows, task << 32 | n)
                    rows, size, n = [], 0, n + 1
        yield from cut(rows, task << 32 | n)

    return seqs.select("conv_id", "digests", "words").mapInArrow(form, PIECE)


def piece(at: int, run: int, held: Iterator[Record] | list[Record]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"range": pa.array([at], pa.int32()), "run": [run], **packed(held)})


class Open:
    """A node of the open path: what its ended conversations and finished children add up to."""

    __slots__ = ("key", "words", "n", "least", "children", "leaves", "saved", "first", "rows")

    def __init__(self, key: bytes, words: int, first: bool) -> None:
        self.key, self.words, self.first = key, words, first
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.rows: list[int] = []

    def add(self, n: int, least: int | None, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least


class Path:
    """The open path and the NODE rows that came of it. A node is finished when it leaves the path, unless it is on the first path, or the last, and others may go on with it."""

    def __init__(self) -> None:
        self.stack: list[Open] = []
        self.firsts: list[Open] = []
        self.depths: dict[int, int] = {}
        self.out: list[list] = []

    def push(self, node: Open) -> None:
        if node.first:
            self.firsts.append(node)
            self.depths[id(node)] = len(self.stack)
        self.stack.append(node)

    def pop(self, final: bool = False) -> None:
        node = self.stack.pop()
        if node.first and not final:
            return
        node.leaves += node.children == 0
        node.saved += (node.n - 1) * node.words
        for row in node.rows:
            self.out[row][7] = node.least
        if self.stack:
            self.stack[-1].add(node.n, node.least, 1, node.leaves, node.saved)
            self.stack[-1].rows.append(len(self.out))
        self.out.append([node.key, len(self.stack), node.least, node.n, node.children, node.leaves, node.saved, None, None, False, None, None, node.words])

    def edges(self, at: int) -> None:
        """What is on the first and the last path goes out as edges, in the order of the trie."""
        last = [(depth, node) for depth, node in enumerate(self.stack) if not node.first]
        for k, (depth, node) in enumerate([(self.depths[id(n)], n) for n in self.firsts] + last):
            for row in node.rows:
                self.out[row][8] = node.key
            self.out.append([node.key, depth, node.least, node.n, node.children, node.leaves, node.saved, None, None, True, at, k, node.words])
        self.stack = []

    def table(self) -> pa.Table:
        columns = zip(*self.out, strict=True) if self.out else [()] * 13
        kinds = [pa.binary(), *[pa.int64()] * 7, pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()]
        return pa.table({field.split()[0]: pa.array(c, kind) for field, c, kind in zip(NODE.split(", "), columns, kinds, strict=True)})


def grown(pieces: pa.Table) -> pa.Table:
    """One range: its pieces merged, the merged stream through the path."""
    path, first = Path(), True
    path.push(Open(ROOT, 0, True))
    for known, digests, words, n, least in merged(pieces):
        while len(path.stack) - 1 > known:
            path.pop()
        for t, w in enumerate(np.frombuffer(words, np.int32)[known:].tolist(), known):
            path.push(Open(hashlib.sha256(path.stack[-1].key + digests[D * t : D * t + D]).digest(), w, first))
        path.stack[-1].add(n, least)
        first = False
    path.edges(pieces["range"][0].as_py())
    return path.table()


def swept(edges: pa.Table, *, final: bool = False) -> pa.Table:
    """Edges of neighbouring ranges, in order, through one path: nodes that several ranges hold meet. final: there are no others."""
    rows = edges.sort_by([("range", "ascending"), ("at", "ascending")]).to_pylist()
    path = Path()
    whole = True  # nothing has left the path yet: what comes is on the first path
    for r in rows:
        depth = r["depth"]
        if len(path.stack) <= depth or path.stack[depth].key != r["key"]:
            whole = whole and len(path.stack) == depth
            while len(path.stack) > depth:
                path.pop(final)
            path.push(Open(r["key"], r["words"], whole))
        path.stack[depth].add(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"])
    if final:
        while path.stack:
            path.pop(True)
    else:
        path.edges(edges["group"][0].as_py())
    return path.table()


def _last(edges: pa.Table) -> pa.Table:
    return swept(edges, final=True)


def splitters_of(seqs: DataFrame, ranges: int, n: int) -> list[bytes]:
    """Up to ranges - 1 cuts from some eight sequences a range, each as short as tells it from the one before. They set sizes of ranges, never results."""
    if ranges < 2:
        return []
    every = max(1, n // (8 * ranges))
    seen = seqs.filter(F.pmod(F.xxhash64("conv_id", F.lit(13)), F.lit(every)) == 0).select(F.substring("digests", 1, 128 * D).alias("d")).collect()
    found = sorted(bytes(r["d"]) for r in seen)
    cuts, before = [], b""
    for cut in (found[len(found) * k // ranges] for k in range(1, ranges)) if found else ():
        if cut > before:
            same = next((i for i, (x, y) in enumerate(zip(before, cut, strict=False)) if x != y), min(len(before), len(cut)))
            before = cut[: same + 1]
            cuts.append(before)
    return sorted(set(cuts))


def ends_of(seqs: DataFrame) -> DataFrame:
    """Rows `key, ends_sha256`: the hash of the ascending, comma-joined ids of the conversations that end at each node.

    Neighbouring ids are joined first; a node's joined strings then stream through one
    hash in order, so a group of copies of any size is some bytes of state.
    """
    near = seqs.groupBy("key", F.floor(F.col("conv_id") / IDS).alias("bucket")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    lines = near.select("key", "bucket", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")).repartition("key").sortWithinPartitions("key", "bucket")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    return lines.select("key", "ids").mapInArrow(stream, "key binary, ends_sha256 string")


def ranges_for(size: int) -> int:
    """Ranges for so many bytes of digests: both their number and their size grow, to some 10^5 of 60 MB at 6 TB of digests."""
    return int((size / 4096) ** 0.55) + 1


def prefix_trie(convs: DataFrame, run_bytes: int = RUN, fan_in: int = FAN_IN, sweep: int = SWEEP, ranges: int | None = None) -> DataFrame:
    """Rows `conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`, one for each node of conversations().

    A node is a distinct sequence of first turns; its last text is turn `depth` of
    conversation `conv_id`, the least of its members. The root has depth 0, no text and
    every conversation as a member, those without turns, too. n_leaves and saved_tokens
    are sums over the node's subtree; saved_tokens are the words that need no second
    encoding when a node's text is read once for all its members. ends_sha256 is of the
    members that end there.

    An empty table gives no rows. Equal conversations are one record from the first run
    on, so a group of copies of any size is one record a run, and a common first turn is
    cut by ranges as any other. A range is some MB of records in one task; a
    conversation is held whole, at 36 bytes a turn and about 200 of an open path.
    """
    seqs = persisted(sequences(convs), "sequences")
    n, size = seqs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("digests") + 8), F.lit(0))).first()
    ranges = ranges_for(size) if ranges is None else ranges
    splitters = splitters_of(seqs, ranges, n)
    pieces = persisted(runs(seqs, splitters, run_bytes), "runs")
    most = pieces.groupBy("range").count().agg(F.max("count")).first()[0] or 0
    while most > fan_in:
        groups = -(-most // fan_in)

        def merge(group: pa.Table) -> pa.Table:
            return pa.Table.from_batches([piece(group["range"][0].as_py(), group["group"][0].as_py(), merged(group))])

        grouped = pieces.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(groups)))
        pieces = persisted(grouped.groupBy("range", "group").applyInArrow(merge, PIECE), "runs")
        most = groups
    nodes = persisted(pieces.groupBy("range").applyInArrow(grown, NODE), "nodes")
    edges, left, met = nodes.filter("edge"), len(splitters) + 1, []
    while True:
        final = left <= sweep
        grouped = edges.withColumn("group", F.floor(F.col("range") / sweep).cast("int"))
        found = persisted(grouped.groupBy("group").applyInArrow(_last if final else swept, NODE), "edges")
        met.append(found.filter("not edge"))
        if final:
            break
        edges, left = found.filter("edge"), -(-left // sweep)
    inner, outer = nodes.filter("not edge"), met[0]
    for more in met[1:]:
        outer = outer.union(more)
    parents = outer.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    every = inner.union(outer)
    under = looked_up(every.filter("parent_key is not null"), ["parent_key"], parents, "key", salts_for(n))
    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = every.filter("parent_key is null").select(columns).union(under.withColumn("parent_conv_id", F.col("parent")).select(columns))
    none = hashlib.sha256(b"").hexdigest()
    return whole.join(ends_of(seqs), "key", "left").select(*columns[1:], F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
