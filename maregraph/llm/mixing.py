"""Mixing sources to target weights by Pfair scheduling.

Every source's documents, in an order drawn by hash, are cut into blocks. Block j of a
source with weight w is released at slot floor(j / w) and due by slot ceil((j + 1) / w);
earliest deadline first fills one slot after another. Then at any slot each source has
had less than one block more or less than its weight's share. Weights are exact
fractions. Blocks grow with the root of the rows, so the driver, which runs through the
blocks (not the rows) once, has a number of steps in proportion to that root. It keeps
how many each source had at the start of every stretch; tasks run through the stretches
again to write the blocks' slots, which meet the rows part by part. No task sees a whole
source.
"""

from __future__ import annotations

import heapq

from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import isfinite, isqrt, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maregraph.llm.common import quoted, row_hash, salts_for, shared_dir, whole_row

#: The columns that a mixture adds.
MIX = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_key")
#: Documents to a block, at least; and blocks for each root of the number of rows, at most.
BLOCK, BLOCKS_A_ROOT = 16, 64
#: Blocks to a stretch of the schedule, at least; and for each source.
STRETCH, STRETCH_A_SOURCE = 8192, 64


def quotas(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole numbers of slots, at least one a source, that add up to period: largest remainders."""
    total = sum(weights.values())
    if not weights or any(not w > 0 for w in weights.values()) or len(weights) > period:
        raise ValueError("weights must be positive, and no more than the period's slots")
    spare = period - len(weights)
    share = {s: w / total * spare for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in share.items()}
    for s in sorted(share, key=lambda s: (int(share[s]) - share[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the weights' proportions."""
    if any(not (w > 0 and isfinite(w)) for w in weights):
        raise ValueError("weights must be positive and finite")
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(f.denominator for f in exact))
    return [int(f * scale) for f in exact]


def schedule(weights: list[int], blocks: list[int], done: list[int], slot: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, release, deadline, slot) by earliest deadline first from a slot on, when sources (by number) had `done` blocks; ties by number.

    A source out of blocks takes no more slots; the others' windows stay as they are.
    """
    total, waiting, ready = sum(weights), [], []
    release = lambda s, j: j * total // weights[s]
    for s, j in enumerate(done):
        if j < blocks[s]:
            heapq.heappush(waiting, (release(s, j), s, j))
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            r, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j, r))
        due, s, j, r = heapq.heappop(ready)
        yield s, j, r, due, slot
        slot += 1
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, (release(s, j + 1), s, j + 1))


def stretches(weights: list[int], blocks: list[int], length: int) -> Iterator[tuple[int, bytes]]:
    """(slot, blocks each source had before it) at the start of every stretch of `length` blocks."""
    done = np.zeros(len(weights), "<i8")
    for k, (s, _, _, _, slot) in enumerate(schedule(weights, blocks, [0] * len(weights))):
        if k % length == 0:
            yield slot, done.tobytes()
        done[s] += 1


def period_schedule(quota: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of one period of whole quotas; ties by name."""
    names = sorted(quota)
    whole = [quota[s] for s in names]
    return [(names[s], *rest) for s, *rest in schedule(whole, whole, [0] * len(whole))]


def block_slots(spark: SparkSession, weights: dict[str, float], blocks: dict[str, int]) -> DataFrame:
    """Rows `_source, _j, _release, _deadline, _slot`, one for each block."""
    names = sorted(weights)
    whole, most = whole_weights([weights[s] for s in names]), [blocks[s] for s in names]
    length = max(STRETCH, STRETCH_A_SOURCE * len(names))
    starts = [(slot, bytearray(done)) for slot, done in stretches(whole, most, length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, done in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(islice(schedule(whole, most, np.frombuffer(done, "<i8").tolist(), slot), length))
                s, *rest = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in s], pa.string()), *(pa.array(c, pa.int64()) for c in rest)], ["_source", "_j", "_release", "_deadline", "_slot"])

    return spark.createDataFrame(starts, "slot long, done binary").mapInArrow(run, "_source string, _j long, _release long, _deadline long, _slot long")


def in_parts(docs: DataFrame, source: Column, order: list[Column], parts: int) -> tuple[DataFrame, DataFrame]:
    """docs as `_row`, with `_source`, `_part` and `_inside`, the row's place (from 0) in its part by `order`; and the parts' `_n` rows and `_before`, the rows of parts before."""
    rows = docs.select(whole_row(docs).alias("_row"), source.alias("_source"), F.pmod(order[0], F.lit(parts)).cast("int").alias("_part"), *(c.alias(f"_by{k}") for k, c in enumerate(order)))
    counts = rows.groupBy("_source", "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_source").orderBy("_part")) - F.col("_n"))
    inside = F.row_number().over(Window.partitionBy("_source", "_part").orderBy(*(f"_by{k}" for k in range(len(order))))) - 1
    return rows.withColumn("_inside", inside), before


def until_the_first_end(weights: list[int], blocks: list[int]) -> int:
    """Slots before the first at which a source without blocks left would be due one: up to there none stays empty."""
    return min((n * sum(weights) // w for w, n in zip(weights, blocks, strict=True)), default=0)


def block_size(rows: int) -> int:
    """Documents to a block for so many rows: as the root of the rows, BLOCK at least."""
    return max(BLOCK, -(-isqrt(rows) // BLOCKS_A_ROOT))


def source_rows(docs: DataFrame, source: Column) -> dict[str, int]:
    """Rows of each source: one row for each source, and nothing for each document, comes to the driver."""
    return {r["s"]: r["count"] for r in docs.groupBy(source.alias("s")).count().collect()}


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block: int | None = None, id_col: str = "doc_id", source_col: str = "source", at_end: str = "go_on") -> DataFrame:
    """docs with `mix_block, mix_release, mix_deadline, mix_slot, mix_key` (long); ordering by mix_key is the mixture.

    Columns of docs of these five names are replaced by them; all others stay.

    `weights`: target weight of each source (sources not named, and all without it: rows
    of the source ** power). `block`: documents to a block (default: block_size of the
    rows). A null source is a source of its own. With at_end="go_on"
    no row is dropped or repeated: when a source has no blocks left its slots stay empty
    and the others go on in their proportions, so from there on the written order holds
    the others' weights among themselves and no longer the target weights. "stop" ends
    the mixture there, and drops what would follow. A source's documents come in the order of a
    hash of the id, then id, then all columns' hash (of any types); exact repeats keep
    distinct keys. A source's last block may be short. An empty table gives no rows.
    """
    if at_end not in ("go_on", "stop"):
        raise ValueError("at_end must be go_on or stop")
    shared_dir(docs.sparkSession)
    # "s" before the name keeps a null source apart from every name
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    counts = source_rows(docs, source)
    found = {s: float(n) ** power for s, n in counts.items()}
    if weights is not None:
        found = {s: weights.get(s[1:], w) if s != "null" else w for s, w in found.items()}
    block = block or block_size(sum(counts.values()))
    blocks_of = {s: -(-n // block) for s, n in counts.items()}
    slots = block_slots(docs.sparkSession, found, blocks_of)
    if at_end == "stop":
        names = sorted(found)
        slots = slots.filter(F.col("_slot") < until_the_first_end(whole_weights([found[s] for s in names]), [blocks_of[s] for s in names]))
    rows, parts = in_parts(docs, source, [F.xxhash64(F.col(id_col)), F.col(id_col), row_hash(docs)], salts_for(sum(counts.values())))
    # a part's blocks, the first and last of which it may share with its neighbours
    parts = parts.withColumn("_first", F.floor(F.col("_before") / block))
    blocks = parts.withColumn("_j", F.explode(F.sequence("_first", F.floor((F.col("_before") + F.col("_n") - 1) / block))))
    blocks = blocks.join(slots, ["_source", "_j"]).groupBy("_source", "_part", "_before", "_first").agg(F.array_sort(F.collect_list(F.struct("_j", "_release", "_deadline", "_slot"))).alias("_blocks"))
    rows = rows.join(blocks, ["_source", "_part"]).withColumn("_rank", F.col("_before") + F.col("_inside")).withColumn("mix_block", F.floor(F.col("_rank") / block))
    at = F.get(F.filter("_blocks", lambda b: b["_j"] == F.col("mix_block")), 0) if at_end == "stop" else F.get("_blocks", (F.col("mix_block") - F.col("_first")).cast("int"))
    rows = rows.withColumn("_at", at).filter("_at is not null").select("_row", "_rank", "mix_block", "_at.*")
    slot = F.col("_slot")
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in MIX]
    return rows.select(*kept, "mix_block", F.col("_release").alias("mix_release"), F.col("_deadline").alias("mix_deadline"), slot.alias("mix_slot"), (slot * block + F.col("_rank") % block).alias("mix_key"))


def in_mixed_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by mix_key: written files, read in order, are the mixture."""
    return mixed.repartitionByRange("mix_key").sortWithinPartitions("mix_key").select(*map(quoted, columns))
