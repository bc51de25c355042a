"""The registered queries of this subpackage; each is a thin use of one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.common import crc_mod
    from maregraph.llm.lm_scoring import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.token_counts import sentencepiece_pieces, token_counts

    return token_counts(_table(spark, sf_dir, "documents"), sentencepiece_pieces(_tokenizer("piece_bpe_32k.model")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.url_filter import url_filter

    return url_filter(_table(spark, sf_dir, "pages")).drop("n_candidates")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents")).drop("historical")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.common import crc_mod
    from maregraph.llm.language_id import identify, train_language_id

    docs = _table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 5) == 0
    model = train_language_id(docs, ~held_out)
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.secrets import secret_scan

    return secret_scan(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), with_ids=False).drop("bucket")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.quality_rules import quality_rules

    found = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maregraph.llm.common import crc_mod
    from maregraph.llm.prefix_trie import conversations, prefix_trie, with_heads

    convs = conversations(_table(spark, sf_dir, "conversations"))
    return prefix_trie(with_heads(convs, every=20, n=crc_mod("conv_id", 4), most=3))


def oracle_op4() -> str:
    from maregraph.llm.url_filter import oracle

    return oracle()


OP6_SQL = r"""
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY text_sha256)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)"""

OP12_SQL = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""

OP13_SQL = r"""
    WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM t),
    c AS (SELECT conv_id, xor(list_reduce(list_transform(str_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT), lambda a, b: list_reduce(list_transform(range(8), lambda k: k::UBIGINT), lambda r, k: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)), 4294967295::UBIGINT), 4294967295::UBIGINT) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
    r AS (SELECT c.conv_id, pos, digest, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h UNION ALL SELECT c.conv_id, pos + 3, digest, words FROM c JOIN o USING (conv_id) WHERE pos > h),
    s AS (SELECT conv_id, words, row_number() OVER w AS depth, list(digest) OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
    p AS (SELECT conv_id, depth, words, sha256(array_to_string(path, '')) AS key, CASE WHEN depth > 1 THEN sha256(array_to_string(path[:-2], '')) ELSE '' END AS up FROM s UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
    g AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, any_value(up) AS up FROM p GROUP BY key, depth),
    k AS (SELECT up AS key, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY up),
    b AS (SELECT p.key, count(*) FILTER (k.key IS NULL) AS n_leaves, sum((g.n_convs - 1) * g.words)::BIGINT AS saved_tokens FROM g LEFT JOIN k ON g.key = k.key JOIN p ON p.conv_id = g.conv_id AND p.depth <= g.depth GROUP BY p.key),
    l AS (SELECT conv_id, arg_max(key, depth) AS key FROM p GROUP BY conv_id),
    e AS (SELECT key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM l GROUP BY key)
    SELECT g.conv_id, g.depth, q.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
    FROM g LEFT JOIN g q ON g.up = q.key LEFT JOIN k ON g.key = k.key JOIN b ON g.key = b.key LEFT JOIN e ON g.key = e.key"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_lm_scoring, op2_token_counts, op3_jaccard_join, op4_url_filter, op5_mix_sources, op6_exact_dedup, op7_embedding_dedup, op8_language_id, op9_secret_scan, op10_packing, op11_quality_rules, op12_hard_negatives, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": oracle_op4(), "op6_exact_dedup": OP6_SQL, "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}
