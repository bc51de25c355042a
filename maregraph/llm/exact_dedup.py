"""Exact dedup against a minimal perfect hash of historical digests.

Distinct historical digests are dealt into shards of bounded size. Each shard gets a
minimal perfect hash whose slots hold the full digest and the locator of the row that
stays. New distinct digests look themselves up: a slot whose digest is byte for byte
the same marks a repeat, all others are grouped among themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maregraph.llm.common import SPACE, looked_up, persisted, row_hash, salts_for, text_or_empty, whole_row

#: Historical digests to a shard, on average.
SHARD = 20_000


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests: hash, displace; lone keys go straight to free slots."""

    def __init__(self, digests: np.ndarray) -> None:
        self.n = n = len(digests)
        words = digests.view("<u8").reshape(n, 4)
        self.buckets = max(1, n // 3)
        bucket = (words[:, 1] % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_of = np.zeros(n, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            keys = order[ends[b] - sizes[b] : ends[b]]
            if len(keys) < 2:
                break
            d = 0
            while True:
                slots = self._slots(words[keys], np.int64(d))
                if free[slots].all() and len(np.unique(slots)) == len(slots):
                    break
                d += 1
            self.shift[b], self.slot_of[keys] = d, slots
            free[slots] = False
        lone = order[ends[sizes == 1] - 1]
        left = np.flatnonzero(free)
        self.shift[bucket[lone]] = -1 - left
        self.slot_of[lone] = left

    def _slots(self, words: np.ndarray, d: np.ndarray | np.int64) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = words[:, 2] + (words[:, 3] | np.uint64(1)) * np.asarray(d, np.int64).astype(np.uint64)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
        return (mixed % np.uint64(self.n)).astype(np.int64)

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """The only slot that can hold each digest."""
        words = digests.view("<u8").reshape(len(digests), 4)
        d = self.shift[(words[:, 1] % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(d < 0, -1 - d, self._slots(words, np.maximum(d, 0)))


def _bytes32(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _probe(shard: pa.Table) -> pa.Table:
    """One shard: distinct (digest, keep_rank, keep_id, n) of both sides to distinct digests with winner and total."""
    columns = ["digest", "keep_rank", "keep_id", "n"]
    history, new = (shard.filter(shard["historical"] if old else pc.invert(shard["historical"])).select(columns).combine_chunks() for old in (True, False))
    if history.num_rows == 0 or new.num_rows == 0:
        both = pa.concat_tables([history, new])
        return both.append_column("seen", pa.array([history.num_rows > 0] * both.num_rows, pa.bool_()))
    old, asked = _bytes32(history["digest"]), _bytes32(new["digest"])
    index = PerfectHash(old)
    slots = np.empty(len(old), np.int64)
    slots[index.slot_of] = np.arange(len(old))  # slot -> historical row
    at = slots[index.lookup(asked)]
    member = (old[at] == asked).all(axis=1)
    repeats, fresh = new.filter(pa.array(member)), new.filter(pa.array(~member))
    n = np.array(history["n"].to_numpy())
    np.add.at(n, at[member], repeats["n"].to_numpy())
    # the better locator of the two: lower rank (minus the length), then smaller id, nulls last
    rank, ids = np.array(history["keep_rank"].to_numpy()), history["keep_id"].to_pylist()
    for row, r, i in zip(at[member].tolist(), repeats["keep_rank"].to_pylist(), repeats["keep_id"].to_pylist(), strict=True):
        if (r, i is None, i or 0) < (rank[row], ids[row] is None, ids[row] or 0):
            rank[row], ids[row] = r, i
    done = pa.table({"digest": history["digest"], "keep_rank": pa.array(rank), "keep_id": pa.array(ids, pa.int64()), "n": pa.array(n), "seen": pa.array(np.ones(len(n), bool))})
    rest = fresh.append_column("seen", pa.array(np.zeros(fresh.num_rows, bool)))
    return pa.concat_tables([done.cast(rest.schema), rest])


def with_digest(docs: DataFrame, history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id, digest, keep_rank, historical`: SHA-256 of the text without white space, minus its code points."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, SPACE, "").cast("binary"), 256)).alias("digest"),
        (-F.char_length(text)).cast("long").alias("keep_rank"),
        F.coalesce(history, F.lit(False)).alias("historical"),
    )


def exact_dedup(docs: DataFrame, history: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `doc_id, keep_id, group_size, kept, text_sha256, historical`, one for each row of docs.

    Texts are equal when the same without `[\\x20\\x09-\\x0D]`; null is the empty text.
    The longest original (code points) stays, then the smallest doc_id; null ids lose to
    others. `history` marks the rows whose digests are indexed (default: an even half by
    id); the result doesn't depend on it. Rows that repeat id and text are one another's
    copies: each is `kept` when it is the row named by keep_id, so exact repeats of the
    winner's row share its flag. Texts of any length are read whole; an empty table
    gives no rows; ids are cast to long; other columns are ignored. Distinct digests
    meet after partial aggregation, and rows read their group's answer by salt, so a
    group of any size is a bounded part of a task.
    """
    if history is None:
        history = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0
    rows = persisted(with_digest(docs, history, id_col, text_col), "digests")
    best = F.min(F.struct("keep_rank", F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    distinct = persisted(rows.groupBy("digest", "historical").agg(best.alias("best"), F.count("*").alias("n")).select("digest", "historical", F.col("best.keep_rank"), F.col("best.doc_id").alias("keep_id"), "n"), "distinct-digests")
    shards = max(1, -(-distinct.filter("historical").count() // SHARD))
    sides = distinct.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    groups = sides.groupBy("shard").applyInArrow(_probe, "digest binary, keep_rank long, keep_id long, n long, seen boolean")
    groups = groups.select("digest", "keep_id", F.col("n").alias("group_size"))
    out = looked_up(rows, ["digest"], groups, "doc_id", salts_for(rows.count()))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "historical")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns (of any names and types).

    Of rows that repeat the winner's id and digest, the one of the longest text stays,
    then that of the least hash of all columns. Null texts are empty ones, so one of all
    rows without words stays; an empty table gives no rows. Who stays is decided on ids
    and digests; rows move once, to meet them.
    """
    kept = exact_dedup(docs, None, id_col, text_col).filter("kept").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest")).distinct()
    key = [F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.col("id").isNull().alias("no_id"), "digest"]
    text = text_or_empty(text_col)
    rows = docs.select(whole_row(docs).alias("row"), F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(F.translate(text, SPACE, "").cast("binary"), 256)).alias("digest"), (-F.char_length(text)).alias("rank"), row_hash(docs).alias("h"))
    names = ["id", "no_id", "digest"]
    once = rows.select(*key, "row", "rank", "h").join(kept.select(*key), names).withColumn("k", F.row_number().over(Window.partitionBy(*names).orderBy("rank", "h")))
    return once.filter("k = 1").select("row.*")
