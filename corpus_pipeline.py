"""From raw documents to a sharded training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the rows it keeps, with the
columns of ``documents``; the last adds the place of each row. Between stages rows are written to the shared
folder and read again, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import decontaminate, jaccard, language_id, mixing, sharding
from fleetlens.llm.common import scratch, table
from fleetlens.session import fresh_folder, remove_folder

SHARDS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Documents in a language the model knows; the others go."""
    return language_id.understood(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One document of each group of near copies."""
    return jaccard.deduplicated(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """The sources in their target shares: documents repeat or are cut."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Every row with its shard and slot."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_copies),
    ("decontamination", benchmark_free),
    ("mixing", mix),
    ("sharding", shards),
]

#: Language ID, hashes and permutations have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves behind is removed when it is written, its input when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_folder(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
