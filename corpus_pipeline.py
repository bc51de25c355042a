"""A corpus pipeline of five of the llm operators, each stage written as Parquet and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maregraph.llm.common import crc_mod, shared_dir, whole_row, work_tables_deleted
from maregraph.llm.exact_dedup import drop_duplicates
from maregraph.llm.jaccard_join import keep_one
from maregraph.llm.language_id import identify, train_language_id
from maregraph.llm.mixing import MIX, in_mixed_order, mix_sources
from maregraph.llm.packing import pack

#: Documents whose predicted language is less probable than this are rejected, as are those without letters.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. The model learns from four fifths of the documents that name theirs.

    Null texts and those without letters go; repeated rows stay or go alike; an empty
    table, or one without any named language, gives no rows. Extra columns stay.
    """
    model = train_language_id(docs, crc_mod("doc_id", 5) != 0)
    found = identify(docs.select(whole_row(docs).alias("row")), model, text_col="row.text")
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of texts that are equal but for white space: the longest, then that of the smallest id.

    Rows that repeat id and text are one; a null text counts as empty; an empty table
    gives no rows. Extra columns, of any names and types, stay.
    """
    return drop_duplicates(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group linked by a Jaccard similarity of 0.8 of five-word shingles: that of the smallest id.

    Rows without words or with a null id stay; an empty table gives no rows. Extra
    columns, of any names and types, stay.
    """
    return keep_one(docs, words=5, percent=80)


def mix_sources_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows ordered so that sources appear by the square roots of their sizes.

    A null source is one of its own; ties follow hashes of id and row; an empty table
    gives no rows. Extra columns stay, but for the five of MIX.
    """
    return in_mixed_order(mix_sources(docs), [c for c in docs.columns if c not in MIX])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids with their lengths; `source_file` and `source_row` order them as the mixture does.

    A null text is packed as the end alone, repeated rows each; an empty table gives no
    rows. Other columns than the id go.
    """
    import public_tokenizers

    placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row"))
    return pack(placed, public_tokenizers.path("word_bpe_49k.json"), carry=("source_file", "source_row"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("mix_sources", mix_sources_stage),
    ("packing", packing),
]

#: Training, set similarity and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the folder of each stage's result lies in the shared one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with work_tables_deleted(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
