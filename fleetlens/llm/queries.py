"""The queries of this package over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import archives, codes, decontaminate, fill_in_middle, jaccard, language_id, licenses, mixing, pii, sharding, substrings, urls, vectors
from fleetlens.llm.common import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents")).drop("by_shard")


def op3_mixing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_blocks(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("t")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents")).drop("k", "t")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived(table(spark, sf_dir, "pages"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_substrings": op2_substrings,
    "op3_mixing": op3_mixing,
    "op3_mixing_shards": op3_mixing_shards,
    "op4_decontamination": op4_decontamination,
    "op5_jaccard": op5_jaccard,
    "op6_urls": op6_urls,
    "op7_pii": op7_pii,
    "op8_language_id": op8_language_id,
    "op9_vectors": op9_vectors,
    "op10_sharding": op10_sharding,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_warc": op12_warc,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE,
    "op4_decontamination": decontaminate.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op12_warc": archives.ORACLE,
    "op13_vector_codes": codes.ORACLE,
}
