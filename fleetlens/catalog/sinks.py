"""Sinks and documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.catalog.sql import r6, seconds, text, view
from fleetlens.catalog.tables import Tables
from fleetlens.functions.scalars import moment
from fleetlens.operators.forecast import flat_from_latest
from fleetlens.schemas import BASIC_METRICS, INFERENCE_LOG
from fleetlens.session import fresh_folder
from fleetlens.sources import documents as docs

EXPIRE = 2 * 86400
NOW = "2024-01-30 12:00:00"

view(
    "stored",
    f"""
    SELECT model_id, timestamp, cpu_allocation, memory_allocation, d,
           'prediction:' || strftime(timestamp, '%Y%m%d%H%M%S') AS key,
           timestamp + INTERVAL {EXPIRE} SECONDS AS expires_at
    FROM docs""",
)


def _stored(t: Tables) -> DataFrame:
    path = fresh_folder(t.spark, "store")
    rows = t.documents.select("model_id", "timestamp", "cpu_allocation", "memory_allocation")
    docs.store_documents(rows, path, EXPIRE)
    return docs.read_store(t.spark, path)


@query(
    "sink_prediction_store",
    f"""
    SELECT model_id, key, {text('expires_at')} AS expires_at, d::VARCHAR AS day, {r6('cpu_allocation')} AS cpu_allocation,
           {r6('memory_allocation')} AS memory_allocation
    FROM stored""",
)
def prediction_store(t: Tables) -> DataFrame:
    return _stored(t).select("model_id", "key", "expires_at", F.col("day").cast("date").alias("day"), "cpu_allocation", "memory_allocation")


@query(
    "read_latest_prediction",
    f"""
    SELECT model_id, arg_max(key, timestamp) AS key, {r6('arg_max(cpu_allocation, timestamp)')} AS cpu_allocation
    FROM stored WHERE expires_at > TIMESTAMP '{NOW}' GROUP BY model_id""",
)
def latest_prediction(t: Tables) -> DataFrame:
    """The newest documents are kept as two halves of the documents arrive, the later half first."""
    path = fresh_folder(t.spark, "latest")
    rows = t.documents.select("model_id", "timestamp", "cpu_allocation")
    late = F.col("timestamp") >= moment("2024-01-15")
    for part in (rows.where(late), rows.where(~late)):
        docs.keep_latest(part, path, EXPIRE, buckets=8)
    return docs.read_latest(t.spark, path, moment(NOW)).select("model_id", "key", "cpu_allocation")


@query(
    "read_prediction_history",
    f"""
    SELECT model_id, key, {r6('cpu_allocation')} AS cpu_allocation
    FROM stored WHERE expires_at > TIMESTAMP '{NOW}' ORDER BY key DESC, model_id LIMIT 10""",
)
def prediction_history(t: Tables) -> DataFrame:
    """Folders of documents that expired are removed first."""
    path = fresh_folder(t.spark, "store")
    docs.store_documents(t.documents.select("model_id", "timestamp", "cpu_allocation"), path, EXPIRE)
    docs.remove_expired(t.spark, path, datetime.fromisoformat(NOW))
    return docs.document_history(docs.read_store(t.spark, path), moment(NOW)).select("model_id", "key", "cpu_allocation")


view(
    "flat",
    """
    SELECT model_id, p, TIMESTAMP '2024-01-31' + to_minutes(5 * p) AS timestamp,
           arg_max(value, event_id) FILTER (metric_name = 'requests_total') AS requests_total,
           arg_max(value, event_id) FILTER (metric_name = 'latency_avg') AS latency_avg,
           arg_max(value, event_id) FILTER (metric_name = 'latency_p95') AS latency_p95,
           arg_max(value, event_id) FILTER (metric_name = 'latency_p99') AS latency_p99
    FROM metrics, (SELECT unnest(range(5))::INTEGER AS p) GROUP BY model_id, p""",
)


def _flat(t: Tables) -> DataFrame:
    """Forecast of five points from the latest values, one row per model and time."""
    rows = flat_from_latest(t.metrics, moment("2024-01-31"), tie="event_id")
    picked = [F.max(F.when(F.col("metric_name") == m, F.col("value"))).alias(m) for m in BASIC_METRICS]
    return rows.groupBy("model_id", "timestamp").agg(*picked)


@query(
    "sink_json_document",
    f"""
    SELECT model_id, p AS pos, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp,
           {', '.join(f"{r6(m)} AS {m}" for m in BASIC_METRICS)}, 'json' AS export_format
    FROM flat""",
)
def json_document(t: Tables) -> DataFrame:
    path = fresh_folder(t.spark, "json")
    docs.forecast_documents(_flat(t), BASIC_METRICS).write.text(path)
    arrays = ", ".join(f"{m}: ARRAY<DOUBLE>" for m in BASIC_METRICS)
    schema = f"model_id STRING, predictions STRUCT<timestamp: ARRAY<STRING>, {arrays}>, metadata STRUCT<export_format: STRING>"
    back = t.spark.read.schema(schema).json(path)
    zipped = F.arrays_zip("predictions.timestamp", *[f"predictions.{m}" for m in BASIC_METRICS])
    rows = back.select("model_id", F.posexplode(zipped).alias("pos", "p"), "metadata.export_format")
    return rows.select("model_id", "pos", "p.*", "export_format")


@query(
    "sink_csv_flat",
    f"""
    SELECT model_id, {text('timestamp')} AS timestamp, {', '.join(f"{r6(m)} AS {m}" for m in BASIC_METRICS)},
           {r6('max_v')} AS opt_cpu_allocation, {r6('min_v')} AS opt_memory_allocation
    FROM flat JOIN (SELECT model_id, max(value) AS max_v, min(value) AS min_v FROM ev GROUP BY model_id) USING (model_id)""",
)
def csv_flat(t: Tables) -> DataFrame:
    allocation = t.events.groupBy("model_id").agg(
        F.max("value").alias("cpu_allocation"), F.min("value").alias("memory_allocation"), F.lit("optimal").alias("status")
    )
    flat = docs.flat_forecast(_flat(t), allocation)
    path = fresh_folder(t.spark, "csv")
    docs.write_csv(flat, path)
    return t.spark.read.schema(flat.schema).option("header", True).csv(path)


@query(
    "sink_kafka_logs",
    f"""
    SELECT model_id AS key, event_id, {text('timestamp')} AS timestamp, model_id, {r6('latency')} AS latency, error, status_code, level, context
    FROM logs""",
)
def kafka_logs(t: Tables) -> DataFrame:
    """The payload a Kafka sink would send, written as text and parsed again."""
    path = fresh_folder(t.spark, "payload")
    docs.log_payload(t.logs).write.json(path)
    back = t.spark.read.schema("key STRING, value STRING").json(path)
    log = back.select("key", F.from_json("value", INFERENCE_LOG).alias("log"))
    return log.select("key", *[f"log.{c}" for c in ("event_id", "timestamp", "model_id", "latency", "error", "status_code", "level", "context")])


view(
    "raw_docs",
    """
    SELECT *, dayofyear(d) % 4 AS kind FROM docs""",
)


def _raw_documents(t: Tables) -> DataFrame:
    """Documents whose times come in several spellings; the kind is the day of the year modulo 4."""
    kind = F.dayofyear("d") % 4
    spaced = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    spelled = F.when(kind == 0, spaced).when(kind == 1, F.concat(iso, F.lit("Z"))).when(kind == 2, F.concat(iso, F.lit("+00:00")))
    return t.documents.select("model_id", "d", kind.alias("kind"), spelled.otherwise(iso).alias("timestamp"), "cpu_allocation", "memory_allocation", "n")


@query(
    "doc_format_for_export",
    f"""
    SELECT model_id, d::VARCHAR AS d, {seconds('timestamp')} || CASE WHEN kind IN (1, 2) THEN '+00:00' ELSE '' END AS timestamp, pos,
           {seconds('timestamp + to_minutes(5 * pos)')} AS point_time, {r6('n::DOUBLE')} AS requests,
           {r6('CASE WHEN kind = 3 THEN 0 ELSE memory_allocation END')} AS utilization_cpu, 0.0::DOUBLE AS utilization_network
    FROM raw_docs, (SELECT unnest(range(2))::INTEGER AS pos)""",
)
def format_for_export(t: Tables) -> DataFrame:
    moment_ = F.to_timestamp("timestamp")
    later = F.timestamp_seconds(F.unix_seconds(moment_) + 300)
    points = F.array(
        *[F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("cpu_allocation").alias("cpu_usage")) for ts in (moment_, later)]
    )
    used = F.struct(
        F.when(F.col("kind") != 3, F.col("memory_allocation")).alias("cpu"),
        F.col("memory_allocation").alias("memory"),
        F.lit(None).cast("double").alias("network"),
    )
    raw = _raw_documents(t).withColumns(
        {"predictions": points, "metrics": F.create_map(F.lit("requests"), F.col("n")), "utilization": used}
    )
    done = docs.format_documents(raw)
    rows = done.select("*", F.posexplode("predictions").alias("pos", "p"))
    return rows.select(
        "model_id",
        "d",
        "timestamp",
        "pos",
        F.col("p.timestamp").alias("point_time"),
        F.col("metrics")["requests"].alias("requests"),
        F.col("utilization.cpu").alias("utilization_cpu"),
        F.col("utilization.network").alias("utilization_network"),
    )


@query(
    "doc_validate",
    """
    SELECT model_id, d::VARCHAR AS d,
           CASE kind WHEN 0 THEN 'Empty data' WHEN 1 THEN 'Missing timestamp' WHEN 2 THEN 'Invalid timestamp format' END AS reason
    FROM raw_docs""",
)
def validate(t: Tables) -> DataFrame:
    kind = F.col("kind")
    broken = _raw_documents(t).select(
        "model_id",
        "d",
        F.when(kind == 2, "yesterday").when(kind == 3, F.col("timestamp")).alias("timestamp"),
        F.when(kind != 0, F.col("cpu_allocation")).alias("predictions"),
    )
    return docs.check_documents(broken).select("model_id", "d", "reason")
