"""N-gram Jaccard join over a token-group matrix.

Documents are sets of hashed word shingles. Similar documents are put into groups of
bounded size and each group's union of its members' shingles is stored. A query document
looks up the groups that hold one of its rarest shingles, its overlap with a group's
stored union bounds its overlap with every member, and only groups whose bound reaches
the threshold are opened: their members are read for no other query.

Two things keep the work near-linear without losing a link. A shingle that no other
document has can't be shared, so documents with too many of those are alone and the
rarest shingles come first in every prefix. And sets that link to the leader of one of
their min-hash classes are one component from the start: groups of one component are
never opened for queries of the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maregraph.llm.common import persisted, salts_for, whole_row, with_totals
from maregraph.llm.components import connected_components

#: Characters of text to a block, distinct shingles to a range.
BLOCK_CHARS, RANGE_SHINGLES = 6_000_000, 3_000_000
#: Members to a group and bytes of their shingles; bytes of queries that meet a group at once, and of a call's groups and queries, all about.
MEMBERS, GROUP_BYTES, QUERY_BYTES, CALL_BYTES = 512, 8 << 20, 8 << 20, 16 << 20
#: Rows of one shingle that ask in one task, about.
ASKS = 1000
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams (A-Z lower-cased); with fewer words, of the whole sequence."""
    split = text.encode().lower().split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
    k = min(words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = out * STEP + h[i : len(h) - k + 1 + i]
        out = (out ^ (out >> np.uint64(32))) * MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles of n that a partner must share: ceil(percent / 100 * n)."""
    return -(-n * percent // 100)


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    with np.errstate(over="ignore"):
        a = (tokens * STEP).sum(dtype=np.uint64)
        b = ((tokens ^ (tokens >> np.uint64(29))) * MIX).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _document_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows `doc_id, n, d1, d2, tokens`: set size and digest; for possible partners, the shingles that other documents have, rarest first.

    Of a block's documents with one digest only the smallest id carries tokens. Blocks
    send their distinct shingles, packed by hash range; ranges send back how many
    documents hold each, as a power of two.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    bits = max(0, (max(1, chars // 6) // RANGE_SHINGLES).bit_length())
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))

    def sets(table: pa.Table) -> list[np.ndarray]:
        return [shingles(t, words) for part in table.to_batches() for t in part.column("text").to_pylist()]

    def distinct(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *of]), return_counts=True)
        ranges = (tokens >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(tokens), np.int64)
        return tokens, counts, np.searchsorted(ranges, np.arange((1 << bits) + 1))

    def send(table: pa.Table) -> pa.Table:
        tokens, counts, cuts = distinct(sets(table))
        short = ((tokens << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
        counts = np.minimum(counts, 255).astype(np.uint8)
        spans = [(r, lo, hi) for r, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        return pa.table({
            "part": pa.array([r for r, _, _ in spans], pa.int64()),
            "block": pa.array([table["block"][0].as_py()] * len(spans), pa.int64()),
            "short": pa.array([short[lo:hi].tobytes() for _, lo, hi in spans], pa.binary()),
            "counts": pa.array([counts[lo:hi].tobytes() for _, lo, hi in spans], pa.binary()),
        })

    def tally(table: pa.Table) -> pa.Table:
        short = [np.frombuffer(b, "<u4") for b in table["short"].to_pylist()]
        keys, inverse = np.unique(np.concatenate(short), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([np.frombuffer(b, np.uint8) for b in table["counts"].to_pylist()]), len(keys))
        level = np.ceil(np.log2(total)).astype(np.uint8)[inverse]
        ends = np.cumsum([len(s) for s in short])
        return pa.table({"part": table["part"], "block": table["block"], "levels": pa.array([level[e - len(s) : e].tobytes() for s, e in zip(short, ends, strict=True)], pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = sets(table)
        tokens, _, _ = distinct(own)
        levels = np.zeros(0, np.uint8)
        if answers.num_rows:
            told = answers.sort_by("part")["levels"].to_pylist()
            levels = np.frombuffer(b"".join(told), np.uint8)
        ids = table["doc_id"].to_pylist()
        digests = [set_digest(s) if i is not None and len(s) else (None, None) for i, s in zip(ids, own, strict=True)]
        first: dict[tuple, int] = {}
        for k, (i, s, d) in enumerate(zip(ids, own, digests, strict=True)):
            if d[0] is not None and ((len(s), *d) not in first or i < ids[first[(len(s), *d)]]):
                first[(len(s), *d)] = k
        carried: list[bytes | None] = [None] * len(ids)
        for k in first.values():
            s = own[k]
            level = levels[np.searchsorted(tokens, s)]
            shared = level > 0
            if shared.sum() >= least_overlap(len(s), percent):
                s, level = s[shared], level[shared]
                carried[k] = s[np.lexsort((s, level))].astype("<u8").tobytes()
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in own], pa.int64()), "d1": pa.array([d[0] for d in digests], pa.int64()), "d2": pa.array([d[1] for d in digests], pa.int64()), "tokens": pa.array(carried, pa.binary())})

    sent = rows.groupBy("block").applyInArrow(send, "part long, block long, short binary, counts binary")
    told = sent.groupBy("part").applyInArrow(tally, "part long, block long, levels binary")
    return rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, "doc_id long, n long, d1 long, d2 long, tokens binary")


def _keyed(classes: DataFrame) -> DataFrame:
    """classes with `shared`, how many tokens they carry, and `keys`: two min-hashes and the most common shingle."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, shared = [], []
            for t in map(_tokens, batch.column("tokens").to_pylist()):
                with np.errstate(over="ignore"):
                    found.append([int(x.view(np.int64)) for x in (*(((t * m) ^ ((t * m) >> np.uint64(30))).min() for m in (STEP, MIX)), t[-1])])
                shared.append(len(t))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared, pa.int64()), pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "shared", "keys"])

    return classes.mapInArrow(keys, "n long, d1 long, d2 long, rep long, tokens binary, shared long, keys array<long>")


def _leader_links(classes: DataFrame, percent: int, salts: int) -> DataFrame:
    """Links `a, b` of sets to leaders: for each key, the set with the largest shared part, then the largest, of each salt leads the salt's; and one of those leads them.

    Only ids meet by key; tokens are fetched for pairs of sizes that can link.
    """
    ids = classes.select("rep", "d1", "n", (1 - F.col("shared") / F.col("n")).alias("alone"), F.posexplode("keys").alias("kind", "g"), F.pmod(F.xxhash64("rep"), F.lit(salts)).alias("salt"))
    leads = lambda rows, keys: rows.groupBy(*keys).agg(F.min(F.struct("alone", (-F.col("n")).alias("size"), "rep", "d1")).alias("lead"), F.count("*").alias("c")).select(*keys, "c", "lead.alone", (-F.col("lead.size")).alias("n"), "lead.rep", "lead.d1")
    under = persisted(leads(ids, ["kind", "g", "salt"]), "leaders")
    over = leads(under, ["kind", "g"])
    pairs = None
    for rows, keys, chosen in ((ids, ["kind", "g", "salt"], under), (under, ["kind", "g"], over)):
        leaders = chosen.filter("c > 1").select(*keys, F.col("rep").alias("leader"), F.col("d1").alias("ld1"), F.col("n").alias("ln"))
        met = rows.select(*keys, "rep", "d1", "n").join(leaders, keys).drop(*keys)
        pairs = met if pairs is None else pairs.union(met)
    near = (F.col("rep") != F.col("leader")) & (F.least("n", "ln") * 100 >= F.greatest("n", "ln") * percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for n, t, ln, lt in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                both = len(np.intersect1d(_tokens(t), _tokens(lt), assume_unique=True))
                linked.append(100 * both >= percent * (n + ln - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(linked, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    sets = classes.select("rep", "d1", "tokens")
    held = pairs.filter(near).distinct().join(sets, ["rep", "d1"]).join(sets.toDF("leader", "ld1", "lt"), ["leader", "ld1"])
    return held.select("rep", "leader", "n", "tokens", "ln", "lt").mapInArrow(compare, "a long, b long")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Rows `token, short, ...`: the shared ones of the first n - least_overlap(n) + 1 shingles, rarest first.

    The smaller of two partners shares at least 2 * percent / (100 + percent) of its own
    shingles, so partners meet in a shingle that is in a shorter prefix (`short`) of it.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            tokens = [_tokens(t) for t in batch.column("tokens").to_pylist()]
            take = [max(0, int(k) - int(least_overlap(int(k), percent)) + 1 - (int(k) - len(t))) for k, t in zip(n, tokens, strict=True)]
            out = [t[:k] for t, k in zip(tokens, take, strict=True)]
            short = [int(k) + 2 * percent * -int(k) // (100 + percent) + 1 - (int(k) - len(t)) for k, t in zip(n, tokens, strict=True)]
            asks = np.concatenate([np.zeros(0, bool), *(np.arange(len(t)) < k for t, k in zip(out, short, strict=True))])
            at = np.repeat(np.arange(len(out)), [len(t) for t in out])
            columns = {c: batch.column(c).take(pa.array(at)) for c in ("rep", "n", "home", "gid", "weight")} | {"shared": pa.array(np.array([len(t) for t in tokens], np.int64)[at])}
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, "<u8"), *out]).view(np.int64)), pa.array(asks), *columns.values()], ["token", "short", *columns])

    return sets.select("rep", "n", "tokens", "home", "gid", "weight").mapInArrow(spread, "token long, short boolean, rep long, n long, home long, gid long, weight long, shared long")


def _matrix(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A group's part of the token-group matrix: tokens in order, each with the members that hold it."""
    sets = [_tokens(t) for t in raw]
    every = np.concatenate([np.zeros(0, "<u8"), *sets])
    order = np.argsort(every, kind="stable")
    return every[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]


def _unions(call: pa.Table) -> pa.Table:
    """One row for each group of the call: its union of shingles and its members' sizes, packed."""
    call = call.sort_by("gid")
    gid = call["gid"].to_numpy()
    cuts = np.concatenate([[0], 1 + np.flatnonzero(gid[1:] != gid[:-1]), [len(gid)]]).tolist()
    own = [call.slice(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi > lo]
    return pa.table({
        "gid": pa.array([int(g["gid"][0].as_py()) for g in own], pa.int64()),
        "tokens": pa.array([np.unique(np.concatenate([_tokens(t) for t in g["tokens"].to_pylist()])).tobytes() for g in own], pa.binary()),
        "sizes": pa.array([np.sort(g["n"].to_numpy()).astype("<i8").tobytes() for g in own], pa.binary()),
    })


def _calls(call: pa.Table) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The call's pieces, one for each (group, part of its queries): rows of the group, rows of the queries."""
    call = call.sort_by([("gid", "ascending"), ("part", "ascending"), ("member", "descending"), ("rep", "ascending")])
    gid, part, member = (call[c].to_numpy() for c in ("gid", "part", "member"))
    cuts = np.concatenate([[0], 1 + np.flatnonzero((gid[1:] != gid[:-1]) | (part[1:] != part[:-1])), [len(gid)]])
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        mid = lo + int(member[lo:hi].sum())
        if lo < mid < hi:
            yield call.slice(lo, mid - lo), call.slice(mid, hi - mid)


def _qualified(call: pa.Table, percent: int) -> pa.Table:
    """Queries `gid, rep, shared` whose overlap with the group's stored union lets a member of a fitting size reach the threshold."""
    gids, reps, shared = [], [], []
    for group, queries in _calls(call):
        union, sizes = _tokens(group["tokens"][0].as_py()), np.frombuffer(group["sizes"][0].as_py(), "<i8")
        for rep, n, raw in zip(queries["rep"].to_pylist(), queries["n"].to_pylist(), queries["tokens"].to_pylist(), strict=True):
            fits = sizes[(sizes * 100 >= n * percent) & (sizes * percent <= n * 100)]
            asked = _tokens(raw)
            at = np.minimum(np.searchsorted(union, asked), len(union) - 1)
            if len(fits) and (100 + percent) * np.count_nonzero(union[at] == asked) >= percent * (n + fits[0]):
                gids.append(group["gid"][0].as_py())
                reps.append(rep)
                shared.append(len(asked))
    return pa.table({"gid": pa.array(gids, pa.int64()), "rep": pa.array(reps, pa.int64()), "shared": pa.array(shared, pa.int64())})


def _open_groups(call: pa.Table, percent: int) -> pa.Table:
    """Links between components, from the queries of each (group, query part) of the call to the group's members."""
    found: set[tuple[int, int]] = set()
    for members, queries in _calls(call):
        tokens, holder = _matrix(members["tokens"].to_pylist())
        sizes, homes, reps = (members[c].to_numpy() for c in ("n", "home", "rep"))
        for rep, n, home, raw in zip(*(queries[c].to_pylist() for c in ("rep", "n", "home", "tokens")), strict=True):
            asked = _tokens(raw)
            begin, end = np.searchsorted(tokens, asked), np.searchsorted(tokens, asked, "right")
            held = end - begin
            to = np.cumsum(held)
            both = np.bincount(holder[np.repeat(begin - to + held, held) + np.arange(to[-1])], minlength=len(sizes))
            hit = (100 * both >= percent * (n + sizes - both)) & (homes != home) & (reps != rep)
            found.update((home, int(h)) for h in np.unique(homes[hit]))
    a, b = zip(*sorted(found), strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _met(wanted: DataFrame, members: DataFrame, groups: DataFrame, sets: DataFrame, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """function over calls of groups (rows `gid, rep, n, home, tokens, sizes`) and the queries that want them, both dealt by bytes."""
    parts = wanted.groupBy("gid").agg(F.sum(8 * F.col("shared")).alias("q")).withColumn("parts", F.ceil(F.greatest("q", F.lit(1)) / QUERY_BYTES))
    parts = persisted(parts.join(groups.select("gid", "bytes"), "gid"), "parts")
    body = ["gid", "part", "member", "rep", "n", "home", "tokens", "sizes"]
    queries = wanted.join(parts.select("gid", "parts"), "gid").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).join(sets.select("rep", "n", "home", "tokens"), "rep")
    spread = members.join(parts.select("gid", "parts"), "gid").withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "member": F.lit(True)}).select(*body)
    every = spread.unionByName(queries.withColumns({"member": F.lit(False), "sizes": F.lit(None).cast("binary")}).select(*body))
    total = parts.agg(F.sum(F.col("parts") * F.col("bytes") + F.col("q"))).first()[0] or 0
    return every.groupBy(F.pmod(F.xxhash64("gid", "part"), F.lit(1 + total // CALL_BYTES)).alias("call")).applyInArrow(function, schema)


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id, n_shingles, component_id`, one for each row of docs.

    Documents link when 100 * |A and B| >= percent * |A or B| of their sets of distinct
    shingles of `words` words; `component_id` is the smallest doc_id reachable by links.
    With fewer words the whole sequence is the one shingle. Documents without words
    (null, empty, white space) have the empty set and link with nothing, and rows with a
    null id link with nothing and have a null component. Repeated rows, and other texts
    of the same set, are one class and share its component. An empty table gives no
    rows. Whole texts are read, a text longer than a block in a block of its own; ids
    are cast to long; other columns are ignored. `percent` is from 50 to 100.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = persisted(_document_sets(rows, words, percent), "shingle-sets")
    carried = sets.filter("tokens is not null")
    classes = carried.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "tokens")).alias("best")).select("n", "d1", "d2", F.col("best.doc_id").alias("rep"), F.col("best.tokens").alias("tokens"))
    classes = persisted(_keyed(classes), "shingle-classes")
    salts = salts_for(classes.count())
    # sets that link to a leader are one component from the start; `home` is the component known so far
    led = connected_components(_leader_links(classes, percent, salts)).select(F.col("node").alias("rep"), "root")
    homed = classes.select("rep", "d1", "n", "shared", F.col("keys")[0].alias("g")).join(led, "rep", "left").select("rep", "d1", "n", "shared", F.coalesce("root", "rep").alias("home"), F.col("root").isNotNull().alias("joined"), F.when(F.col("root").isNotNull(), F.col("root")).otherwise(F.col("g")).alias("key"))
    homed = with_totals(persisted(homed, "homes"), ["joined", "key"], c=F.count("*"), b=F.sum(8 * F.col("shared")))
    gid = F.xxhash64("joined", "key", F.pmod(F.xxhash64("rep"), F.greatest(F.ceil(F.col("c") / MEMBERS), F.ceil(F.col("b") / GROUP_BYTES))))
    weight = F.when(F.col("joined"), F.col("c")).otherwise(1).cast("long").alias("weight")
    placed = homed.select("rep", "d1", "n", "home", gid.alias("gid"), weight)
    grouped = persisted(placed.join(classes.select("rep", "d1", "tokens"), ["rep", "d1"]).drop("d1"), "grouped")
    groups = persisted(grouped.groupBy("gid").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.length("tokens") / 8).cast("long").alias("reach"), F.min("home").alias("pure"), F.min("weight").alias("mass"), F.sum(F.length("tokens")).alias("bytes")), "groups")
    prefixes = persisted(_prefixes(grouped, percent), "prefixes")
    # shingles of one component only can't join two
    useful = persisted(prefixes.groupBy("token").agg(F.min("home").alias("h0"), F.max("home").alias("h1"), F.count("*").alias("asks")).filter("h0 <> h1").select("token", "asks"), "useful")
    prefixes = persisted(prefixes.join(useful, "token").withColumn("salts", F.ceil(F.col("asks") / ASKS)), "prefixes")
    index = prefixes.groupBy("token", "gid").agg(F.max("short").alias("short_there"), F.max("salts").alias("salts")).join(groups.drop("bytes"), "gid")
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    asks = prefixes.select("token", F.pmod(F.xxhash64("rep"), F.col("salts")).alias("salt"), "short", "rep", "n", "home", "weight", "shared")
    least_partner = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    shares = lambda size: (100 + percent) * F.least("reach", "shared") >= percent * (F.col("n") + size)
    sized = (F.col("most") * 100 >= F.col("n") * percent) & (F.col("least") * percent <= F.col("n") * 100)
    # sets of a smaller component ask the groups of a larger one, so a large one is asked by group and never asks by member
    upward = (F.col("mass") > 1) & (F.struct("mass", "pure") > F.struct("weight", "home")) & (F.col("short") | F.col("short_there")) & shares(least_partner)
    # of two single sets the smaller asks
    single = (F.col("mass") == 1) & (F.col("weight") == 1) & F.col("short") & (F.col("most") >= F.col("n")) & shares(F.greatest("least", "n"))
    met = asks.join(index, ["token", "salt"]).filter(sized & (upward | single)).groupBy("rep", "gid").agg(F.max("shared").alias("shared"))
    wanted = persisted(met, "wanted")
    asked_groups = grouped.join(wanted.select("gid").distinct(), "gid", "left_semi")
    stored = 1 + (groups.join(wanted.select("gid").distinct(), "gid", "left_semi").agg(F.sum("bytes")).first()[0] or 0) // CALL_BYTES
    unions = asked_groups.select("gid", "n", "tokens").groupBy(F.pmod(F.xxhash64("gid"), F.lit(stored)).alias("call")).applyInArrow(_unions, "gid long, tokens binary, sizes binary")
    unions = persisted(unions, "unions")
    empty = F.lit(None).cast("long")
    body = ["gid", "rep", "n", "home", "tokens", "sizes"]
    fit = _met(wanted, unions.withColumns({"rep": empty, "n": empty, "home": empty}).select(*body), groups, grouped, lambda call: _qualified(call, percent), "gid long, rep long, shared long")
    fit = persisted(fit, "qualified")
    links = _met(fit, grouped.withColumn("sizes", F.lit(None).cast("binary")).select(*body), groups, grouped, lambda call: _open_groups(call, percent), "a long, b long")
    roots = connected_components(links)
    rooted = grouped.select("rep", "home").join(roots.withColumnRenamed("node", "home"), "home", "left").select("rep", F.coalesce("root", "home").alias("root"))
    # an id that rows of several sets share is one node, and its row here is one
    labels = with_totals(persisted(rooted, "rooted"), ["root"], component=F.min("rep")).groupBy("rep").agg(F.min("component").alias("component"))
    named = classes.select("n", "d1", "d2", "rep").join(labels, "rep").select("n", "d1", "d2", "component")
    out = sets.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that name their component, with all their columns (of any names and types).

    Rows with a null id, and those whose text has no words, stay; so do all rows that
    repeat the id of one that stays. An empty table gives no rows.
    """
    found = jaccard_components(docs, words, percent, id_col, text_col)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).cast("long").alias("id"))
    return rows.join(gone, "id", "left_anti").select("row.*")
