"""Metric sources: landed range-query responses, metric messages, per-metric frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.schemas import HOST_METRICS, RANGE_RESPONSE


def read_range_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one JSON document per line."""
    return spark.read.schema(RANGE_RESPONSE).json(path)


def flatten_range_responses(responses: DataFrame) -> DataFrame:
    """Long metric table from nested responses.

    Points whose value is not a number are dropped. Host metrics belong to the model ``system`` and
    keep their instance; the others take their model from the labels.
    """
    series = responses.select("metric_name", F.explode("data.result").alias("series"))
    points = series.select("metric_name", F.col("series.metric").alias("labels"), F.explode("series.values").alias("point"))
    host = F.col("metric_name").isin(HOST_METRICS)
    return points.select(
        F.timestamp_seconds(F.col("point")[0].try_cast("double")).alias("timestamp"),
        "metric_name",
        F.col("point")[1].try_cast("double").alias("value"),
        F.when(host, "system").otherwise(F.coalesce(F.col("labels")["model_id"], F.lit("unknown"))).alias("model_id"),
        F.when(host, F.coalesce(F.col("labels")["instance"], F.lit("unknown"))).alias("instance"),
    ).where("value IS NOT NULL AND timestamp IS NOT NULL")


def stack_frames(frames: Sequence[DataFrame]) -> DataFrame:
    """Per-metric frames one below the other; columns missing in a frame are null."""
    if not frames:
        raise ValueError("no metric frame to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def coverage(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows collected per wanted metric; a metric without data counts 0."""
    wanted = metrics.sparkSession.createDataFrame([(n,) for n in names], "metric_name STRING")
    counts = metrics.groupBy("metric_name").agg(F.count("*").alias("n_rows"))
    return wanted.join(counts, "metric_name", "left").select("metric_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def metric_names(metrics: DataFrame) -> DataFrame:
    return metrics.select("metric_name").distinct()


def read_metric_messages(
    spark: SparkSession, servers: str, topic: str, start_ms: int | None = None, end_ms: int | None = None
) -> DataFrame:
    """Messages of a Kafka topic between two record times. Needs Spark's Kafka connector on the class path."""
    reader = spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if start_ms is not None:
        reader = reader.option("startingTimestamp", str(start_ms))
    if end_ms is not None:
        reader = reader.option("endingTimestamp", str(end_ms))
    return reader.load().select(F.col("value").cast("string").alias("value"), "timestamp")


MESSAGE_PARTS = "metric_name VARIANT, value VARIANT, timestamp VARIANT, labels VARIANT"


def check_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``valid``: every field of the metric message is there and of the declared kind.

    Also adds the parsed message ``m``. The explode of one element keeps Spark from merging the parse
    into each use of its fields.
    """
    parsed = messages.withColumn("m", F.explode(F.array(F.from_json(F.col(value), MESSAGE_PARTS))))

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.col(f"m.{field}"))

    rules = (
        (kind("metric_name") == "STRING")
        & F.regexp_like(kind("value"), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
        & (kind("timestamp") == "STRING")
        & F.startswith(kind("labels"), F.lit("OBJECT"))
    )
    return parsed.withColumn("valid", F.coalesce(rules, F.lit(False)))


def parse_messages(messages: DataFrame, value: str = "value", record_time: str = "timestamp") -> DataFrame:
    """Valid messages as rows; the time is the record time. Works on batch and streaming frames."""
    good = check_messages(messages, value).where("valid")

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(F.col(f"m.{name}"), "$", kind).alias(name)

    return good.select(
        F.col(record_time).alias("timestamp"),
        field("metric_name", "string"),
        field("value", "double"),
        field("labels", "map<string,string>"),
    )
