"""Prediction documents: format, check, store, read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.scalars import moment
from fleetlens.operators.filters import Moment
from fleetlens.session import folder_names, fresh_folder, remove_folder
from fleetlens.sources.days import DAY, remove_days

KEY_PREFIX = "prediction:"
#: The day a document expires, as a folder.
UNTIL = "until"
BUCKET = "bucket"
BUCKETS = 64
OFFSET = r"(Z|(?<=:\d\d(\.\d{1,6})?)[+-]\d\d:\d\d)$"


def document_key(ts: Column, prefix: str = KEY_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMddHHmmss"))


def check_documents(docs: DataFrame, text: str = "timestamp", body: str = "predictions") -> DataFrame:
    """Adds ``reason``: why a document is rejected, null for a good one."""
    empty = F.col(text).isNull() & F.col(body).isNull()
    reason = (
        F.when(empty, "Empty data")
        .when(F.col(text).isNull(), "Missing timestamp")
        .when(F.try_to_timestamp(F.col(text)).isNull(), "Invalid timestamp format")
    )
    return docs.withColumn("reason", reason)


def format_documents(docs: DataFrame) -> DataFrame:
    """One spelling of times, numbers as doubles, missing utilization as 0.

    A time keeps its wall clock and its offset (``2024-01-01T05:00:00Z`` becomes
    ``2024-01-01 05:00:00+00:00``); text that is no time stays as it is.

    Expects ``timestamp`` text, ``predictions`` array of structs with a ``timestamp`` text,
    ``metrics`` map and ``utilization`` struct of cpu, memory and network.
    """

    def text(c: Column) -> Column:
        zone = F.regexp_extract(c, OFFSET, 0)
        wall = F.try_to_timestamp(F.regexp_replace(c, OFFSET, ""))
        fraction = F.date_format(wall, ".SSSSSS")
        return F.coalesce(
            F.concat(
                F.date_format(wall, "yyyy-MM-dd HH:mm:ss"),
                F.when(fraction == ".000000", "").otherwise(fraction),
                F.when(zone == "Z", "+00:00").otherwise(zone),
            ),
            c,
        )

    return (
        docs.withColumn("timestamp", text(F.col("timestamp")))
        .withColumn(
            "predictions",
            F.transform("predictions", lambda p: p.withField("timestamp", text(p["timestamp"]))),
        )
        .withColumn("metrics", F.transform_values("metrics", lambda _, v: v.cast("double")))
        .withColumn(
            "utilization",
            F.struct(*[F.coalesce(F.col(f"utilization.{r}"), F.lit(0.0)).alias(r) for r in ("cpu", "memory", "network")]),
        )
    )


def store_documents(docs: DataFrame, path: str, expire_seconds: int, ts: str = "timestamp", mode: str = "append") -> None:
    """Append documents under their time key, with the time they expire, in a folder per day of expiry and day."""
    _keyed(docs, expire_seconds, ts).write.mode(mode).partitionBy(UNTIL, DAY).parquet(path)


def _keyed(docs: DataFrame, expire_seconds: int, ts: str) -> DataFrame:
    expires_at = F.timestamp_seconds(F.unix_seconds(F.col(ts)) + expire_seconds)
    return docs.select(
        "*", document_key(F.col(ts)).alias("key"), expires_at.alias("expires_at"), F.to_date(expires_at).alias(UNTIL), F.to_date(ts).alias(DAY)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unexpired(store: DataFrame, now: Moment) -> DataFrame:
    """Documents that hold now; folders of days before it are not read."""
    return store.where((F.col(UNTIL) >= F.to_date(moment(now))) & (F.col("expires_at") > moment(now)))


def remove_expired(spark: SparkSession, path: str, now: datetime) -> list[str]:
    """Removes the folders of documents that expired before the day of ``now``; their names."""
    return remove_days(spark, path, now.date(), UNTIL)


def keep_latest(docs: DataFrame, path: str, expire_seconds: int, ts: str = "timestamp", buckets: int = BUCKETS) -> None:
    """Keeps the newest document of every model in a table of its own, in folders by a hash of the model.

    Only the folders of models in ``docs`` are read and written again (dynamic partition overwrite), by way of a table in the
    shared folder, so a call that broke off can be repeated. With several documents of one model and time the
    first by all its values is kept.
    """
    spark = docs.sparkSession
    mine = _newest(_keyed(docs, expire_seconds, ts).drop(UNTIL, DAY), ts).withColumn(BUCKET, F.pmod(F.xxhash64("model_id"), F.lit(buckets)).cast("int"))
    staged = fresh_folder(spark, "latest")
    mine.write.partitionBy(BUCKET).parquet(f"{staged}/new")
    mine = spark.read.schema(mine.schema).parquet(f"{staged}/new")
    touched = [f for f in folder_names(spark, f"{staged}/new") if f.startswith(f"{BUCKET}=")]  # at most as many as buckets
    if folder_names(spark, path):
        before = spark.read.schema(mine.schema).parquet(path).where(F.col(BUCKET).isin([int(f.split("=")[1]) for f in touched]))
        _newest(before.unionByName(mine), ts).write.partitionBy(BUCKET).parquet(f"{staged}/all")
        mine = spark.read.schema(mine.schema).parquet(f"{staged}/all")
    mine.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    remove_folder(spark, staged)


def _newest(docs: DataFrame, ts: str) -> DataFrame:
    """One row per model: its newest. Times are aggregated by hash, on two columns, then looked up; only equal times are sorted."""
    last = docs.groupBy("model_id").agg(F.max(ts).alias("_last")).withColumnRenamed("model_id", "_model")
    newest = docs.join(last, F.col("model_id").eqNullSafe(F.col("_model")) & (F.col(ts) == F.col("_last"))).drop("_model", "_last")
    values = F.struct(*[F.col(c) for c in newest.columns if c != "model_id"])
    return newest.groupBy("model_id").agg(F.min(values).alias("doc")).select("model_id", "doc.*")


def read_latest(spark: SparkSession, path: str, now: Moment) -> DataFrame:
    """The documents of ``keep_latest`` that hold now: a read without a shuffle."""
    return spark.read.parquet(path).where(F.col("expires_at") > moment(now)).drop(BUCKET)


def latest_document(store: DataFrame, now: Moment, ts: str = "timestamp") -> DataFrame:
    """Newest unexpired document of every model, computed from the whole store; ``keep_latest`` maintains it."""
    row = F.struct(*[c for c in store.columns if c != "model_id"])
    newest = unexpired(store, now).groupBy("model_id").agg(F.max_by(row, F.col(ts)).alias("doc"))
    return newest.select("model_id", "doc.*")


def document_history(store: DataFrame, now: Moment, limit: int = 10) -> DataFrame:
    """Newest unexpired documents, by key from new to old."""
    return unexpired(store, now).orderBy(F.col("key").desc(), "model_id").limit(limit)


def forecast_documents(forecast: DataFrame, metrics: list[str], allocation: DataFrame | None = None) -> DataFrame:
    """One JSON document per model with an array per metric.

    A forecast has one row per model and future step, so the arrays are as long as the horizon.
    """
    point = F.struct("timestamp", *metrics)
    rows = forecast.groupBy("model_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    arrays = [
        F.transform("points", lambda p: F.date_format(p["timestamp"], "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        *[F.col(f"points.{m}").alias(m) for m in metrics],
    ]
    parts = [F.struct(*arrays).alias("predictions")]
    if allocation is not None:
        rows = rows.join(allocation, "model_id")
        parts.append(F.struct(*[c for c in allocation.columns if c != "model_id"]).alias("optimization"))
    meta = F.struct(F.lit("json").alias("export_format"), F.lit("1.0.0").alias("version")).alias("metadata")
    return rows.select(F.to_json(F.struct("model_id", *parts, meta)).alias("value"))


def flat_forecast(forecast: DataFrame, allocation: DataFrame) -> DataFrame:
    """Forecast rows with the model's allocation repeated as ``opt_*``; states and utilization are left out."""
    left_out = {"model_id", "status", "solver_status", "utilization"}
    kept = [F.col(c).alias(f"opt_{c}") for c in allocation.columns if c not in left_out]
    return forecast.join(allocation.select("model_id", *kept), "model_id")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def log_payload(logs: DataFrame, key: str = "model_id") -> DataFrame:
    """Key and JSON value of each log, ready for a Kafka sink."""
    return logs.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*logs.columns), MICROS).alias("value"))


def write_logs_to_kafka(logs: DataFrame, servers: str, topic: str) -> None:
    """Publish logs. Needs Spark's Kafka connector on the class path."""
    (
        log_payload(logs)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )

