"""What the operators of this subpackage share: work folders, text columns and Arrow mapping."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of the contracts, as bytes.split() sees it: space, tab, LF, VT, FF, CR.
SPACE = " \t\n\x0b\x0c\r"


_work: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A temporary one is set only where the session names none and runs in one process (tests)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="maregraph-")
        spark.conf.set("spark.checkpoint.dir", there)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def persisted(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _work.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def work_tables_deleted(spark: SparkSession) -> Iterator[None]:
    """Tables that persisted() writes inside go at the end, when what was computed from them has been written or has failed."""
    had = len(_work)
    try:
        yield
    finally:
        for path in _work[had:]:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        del _work[had:]


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of df in one struct."""
    return F.struct(*(F.col(quoted(c)).alias(c) for c in df.columns))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, of any types."""

    def has_map(kind: T.DataType) -> bool:
        inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
        return isinstance(kind, T.MapType) or any(map(has_map, inner))

    return F.xxhash64(*(F.to_json(F.struct(quoted(f.name))) if has_map(f.dataType) else F.col(quoted(f.name)) for f in df.schema.fields))


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null: as the empty text)."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def salts_for(n: int) -> int:
    """Parts into which a key that may hold all of n rows is dealt: neither a part nor a key's parts are more than the root of n."""
    return int(max(0, n) ** 0.5) + 1


def with_totals(rows: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """rows with aggregates of their keys (`name=F.sum(...)`), which are written first: a task gives a row a key, and a join of two plain exchanges is one whose hot keys Spark splits."""
    return rows.join(persisted(rows.groupBy(*keys).agg(*(c.alias(name) for name, c in totals.items())), "totals"), keys)


def looked_up(rows: DataFrame, keys: list[str], table: DataFrame, by: str, salts: int, how: str = "inner") -> DataFrame:
    """rows joined to a table that has one row for each key. Only the distinct salts of a key meet the table, so a hot key is no hot task."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    told = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(told, [*keys, "_salt"], how).drop("_salt")


def map_arrow(df: DataFrame, batch_fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_fn(batch)

    return df.mapInArrow(run, schema)


def row_chunks(batch: pa.RecordBatch, text_at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts together hold about `most` bytes, so Python objects stay few."""
    sizes = pa.compute.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for i, n in enumerate(sizes):
        held += int(n)
        if held >= most:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def parts_of(text: pa.Buffer, size: int) -> Iterator[bytes]:
    """text in parts of about `size` bytes, cut at white space; a longer word stays whole."""
    at, space = 0, re.compile(rb"[\x20\x09-\x0D]")
    while at < len(text):
        cut = space.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].to_pybytes()
        at = end
