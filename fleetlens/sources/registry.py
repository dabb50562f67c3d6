"""Service registry and threshold configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.schemas import REGISTRY, THRESHOLDS


def parse_registry(documents: DataFrame, value: str = "value") -> DataFrame:
    """One row per service from JSON documents that map a model id to its entry."""
    entries = documents.select(F.explode(F.from_json(F.col(value), REGISTRY)).alias("model_id", "entry"))
    return entries.select("model_id", "entry.*")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return parse_registry(spark.read.text(path))


def read_port_files(spark: SparkSession, path: str) -> DataFrame:
    """``<model_id>.port`` files, each holding a port number."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.port").select(
        F.col("_metadata.file_name").alias("file_name"), "value"
    )


def with_port_files(registry: DataFrame, ports: DataFrame) -> DataFrame:
    """Registry plus the models known from a port file alone, in status ``unknown``."""
    port = F.trim("value").try_cast("int")
    extra = ports.select(
        F.regexp_replace("file_name", r"\.port$", "").alias("model_id"),
        port.alias("port"),
        F.concat(F.lit("http://localhost:"), port.cast("string")).alias("url"),
        F.lit("unknown").alias("status"),
    ).where("port IS NOT NULL")
    missing = extra.join(registry, "model_id", "left_anti")
    return registry.unionByName(missing, allowMissingColumns=True)


def default_thresholds(spark: SparkSession) -> DataFrame:
    rows = [(c, k, float(v)) for c, keys in THRESHOLDS.items() for k, v in keys.items()]
    return spark.createDataFrame(rows, "category STRING, key STRING, value DOUBLE")


def overlay_thresholds(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Defaults with the values of a file on top; keys only the file has are kept."""
    joined = defaults.alias("d").join(overrides.alias("o"), ["category", "key"], "full")
    return joined.select("category", "key", F.coalesce("o.value", "d.value").alias("value"))
