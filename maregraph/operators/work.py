"""Tables that operators write for themselves: in the folder all executors share, gone when the session ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one where the session names none (local runs)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="maregraph-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there


def gone_at_exit(spark: SparkSession, path: str) -> str:
    """What was written at path is deleted when the driver ends."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def matched(df: DataFrame, found: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """df joined to a table of its keys' values, where a null key is a key."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{i}"))
    return df.join(found.withColumnsRenamed({k: f"_of_{i}" for i, k in enumerate(keys)}), same, how).drop(*(f"_of_{i}" for i in range(len(keys))))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: computed once, cut from its lineage, and of a size that Spark knows when it plans joins."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(gone_at_exit(spark, path))
