"""The registered queries of this subpackage, and SQL that says what they return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakemill.llm import decontaminate, embedding_dedup, importance, language_id, ngram_join, oracles, packing, piece_encoding, quality, quotation, secrets, sharding, spelling, url_filter
from lakemill.session import shipped

URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link(_table(spark, sf_dir, "conversations"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(_table(spark, sf_dir, "documents")).drop("rkey")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: shipped(f)
    for f in (
        op1_embedding_dedup, op2_language_id, op3_quotation_linking, op4_quality, op5_secrets, op6_sharding, op7_url_filter, op8_decontamination, op9_packing, op10_ngram_join,
        op11_sentencepiece, op12_spelling, op13_importance,
    )
}
#: The others are tested against brute force, exact round trips or held-out accuracy.
ORACLE_SQL = {
    "op1_embedding_dedup": oracles.EMBEDDINGS, "op3_quotation_linking": oracles.QUOTATIONS, "op5_secrets": oracles.SECRETS, "op6_sharding": oracles.SHARDS, "op7_url_filter": oracles.urls(URL_RULES),
    "op8_decontamination": oracles.LEAKS, "op10_ngram_join": oracles.JACCARD, "op12_spelling": oracles.SPELLINGS, "op13_importance": oracles.IMPORTANCE,
}
