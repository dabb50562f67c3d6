"""Inference-log analytics and resource reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.scalars import fixed, format_bytes, format_duration, moment, to_iso_utc
from fleetlens.operators.filters import Moment
from fleetlens.operators.joins import page_after
from fleetlens.sources.days import remove_days, since

HIGH_LATENCY = 1.0


def normalize(logs: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Fill missing level, time and message from the rest of the log.

    ``arrival`` is the time a log without its own is given; the processing time by default.
    """
    slow = F.coalesce(F.col("latency") > HIGH_LATENCY, F.lit(False))
    failed = F.col("error").isNotNull() | (F.coalesce("status_code", F.lit(200)) >= 400)
    model = F.coalesce("model_id", F.lit("unknown"))
    level = F.when(failed, "ERROR").when(slow, "WARNING").otherwise("INFO")
    message = (
        F.when(slow, F.concat(F.lit("High latency prediction: "), F.col("latency").cast("string"), F.lit("s")))
        .when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), "error"))
        .otherwise(F.concat(F.lit("Prediction for model "), model))
    )
    return logs.withColumns(
        {
            "level": F.coalesce("level", level),
            "timestamp": F.coalesce("timestamp", arrival if arrival is not None else F.current_timestamp()),
            "message": F.coalesce("message", message),
        }
    )


def high_latency(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("latency") > HIGH_LATENCY)


def latest(logs: DataFrame, n: int = 10_000, arrival: str = "event_id") -> DataFrame:
    """The newest n logs by arrival, as a bounded cache would hold them."""
    return (
        logs.orderBy(F.col(arrival).desc())
        .limit(n)
        .withColumn("level", F.coalesce("level", F.lit("INFO")))
    )


def search(
    logs: DataFrame,
    level: str | None = None,
    model_id: str | None = None,
    start: Moment | None = None,
    end: Moment | None = None,
    query: str | None = None,
    ts: str = "timestamp",
) -> DataFrame:
    """Logs that pass the given filters; the text is sought in message and context, case ignored.

    A log without a time counts as older than any.
    """
    if level:
        logs = logs.where(F.upper(F.coalesce("level", F.lit(""))) == level.upper())
    if model_id:
        logs = logs.where(F.col("model_id") == model_id)
    if start is not None:
        logs = logs.where(F.col(ts) >= moment(start))
    if end is not None:
        logs = logs.where((F.col(ts) <= moment(end)) | F.col(ts).isNull())
    if query:
        text = F.lit(query.lower())
        logs = logs.where(
            F.contains(F.lower(F.coalesce("message", F.lit(""))), text)
            | F.contains(F.lower(F.coalesce("context", F.lit("{}"))), text)
        )
    return logs


def query(
    logs: DataFrame, limit: int = 50, offset: int = 0, tie: str = "event_id", after: Sequence[object] | None = None, **filters: object
) -> DataFrame:
    """One page of matching logs, newest first, with times as ISO text. The total is ``search(...).count()``.

    ``after`` is the bookmark (time, id) of the page before, see ``joins.bookmark``. An offset costs a task as many
    rows as it skips, a bookmark none.
    """
    found = search(logs, **filters)  # type: ignore[arg-type]
    paged = page_after(found, ["timestamp", tie], after, limit, offset)
    return paged.withColumn("timestamp", to_iso_utc(F.unix_micros("timestamp") / F.lit(1e6)))


def summary(logs: DataFrame, cache_size: int = 10_000) -> DataFrame:
    """Rows (section, key, n, first, last): total, per level, per model. The logs are read once."""
    cells = logs.groupBy(
        F.upper(F.coalesce("level", F.lit("UNKNOWN"))).alias("level"),
        F.coalesce("model_id", F.lit("unknown")).alias("model_id"),
    ).agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    sections = F.explode(
        F.array(
            F.struct(F.lit("total").alias("section"), F.lit("all").alias("key")),
            F.struct(F.lit("level").alias("section"), F.col("level").alias("key")),
            F.struct(F.lit("model").alias("section"), F.col("model_id").alias("key")),
        )
    )
    return (
        cells.select(sections.alias("s"), "n", "first", "last")
        .groupBy("s.section", "s.key")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("fill_ratio", F.when(F.col("section") == "total", F.col("n") / F.lit(float(cache_size))))
    )


def retain(logs: DataFrame, now: Moment, days: int, ts: str = "timestamp") -> DataFrame:
    """Logs no older than the given number of days."""
    return logs.where(F.col(ts) >= moment(now) - F.expr(f"INTERVAL {days} DAYS"))


def expire(spark: SparkSession, path: str, now: datetime, days: int, ts: str = "timestamp") -> DataFrame:
    """Removes the folders of days that are too old from a log table in day folders; the logs that are kept.

    The oldest day that is kept may hold logs that are too old as well: they are not read, and go with their day.
    """
    start = now - timedelta(days=days)
    schema = spark.read.parquet(path).schema  # all days may go
    remove_days(spark, path, start.date())
    return since(spark.read.schema(schema).parquet(path), start, ts)


def error_breakdown(logs: DataFrame) -> DataFrame:
    """Errors by model and type; a 404 is not_found, any other failure prediction."""
    kind = F.when(F.col("status_code") == 404, "not_found").otherwise("prediction")
    return (
        logs.where("status_code >= 400 OR error IS NOT NULL")
        .groupBy("model_id", kind.alias("error_type"))
        .agg(F.count("*").alias("n"))
    )


def resource_report(resources: DataFrame) -> DataFrame:
    """Resource table with formatted columns.

    Input: model_id, status (null while running), error, cpu_percent, memory_bytes, memory_percent,
    read_bytes, write_bytes, uptime.
    """
    state = F.when(F.col("status") == "not_running", "STOPPED").when(F.col("error").isNotNull(), "ERROR").otherwise("RUNNING")
    io = F.concat(
        format_bytes(F.coalesce("read_bytes", F.lit(0.0))), F.lit(" in / "), format_bytes(F.coalesce("write_bytes", F.lit(0.0))), F.lit(" out")
    )
    shown = {
        "cpu": F.concat(fixed(F.coalesce("cpu_percent", F.lit(0.0)), 2), F.lit("%")),
        "memory": format_bytes(F.col("memory_bytes")),
        "memory_share": F.concat(fixed(F.coalesce("memory_percent", F.lit(0.0)), 2), F.lit("%")),
        "network": F.when(F.col("read_bytes").isNull() & F.col("write_bytes").isNull(), "N/A").otherwise(io),
        "uptime_text": format_duration(F.col("uptime")),
    }
    running = F.col("state") == "RUNNING"
    return resources.withColumn("state", state).select(
        "model_id", F.col("state").alias("status"), *[F.when(running, c).otherwise("N/A").alias(n) for n, c in shown.items()]
    )


def fleet_health(registry: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: registered and deployed models, mean CPU and memory percent."""
    usage = [snapshots.agg(F.avg(c)).scalar().alias(c) for c in ("cpu_percent", "memory_percent")]
    models = registry.agg(
        F.count_distinct("model_id").alias("registered"),
        F.count_distinct(F.when(F.col("status") == "running", F.col("model_id"))).alias("deployed"),
    )
    return models.select("registered", "deployed", *usage)
