"""Sources and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.catalog.sql import at, instant, r6, rate, text, view
from fleetlens.catalog.tables import Tables, events_of, logs_of, metric_name
from fleetlens.functions.scalars import moment
from fleetlens.operators import tsexpr
from fleetlens.operators.filters import time_range
from fleetlens.operators.logs import latest
from fleetlens.plans import collect
from fleetlens.session import fresh_folder
from fleetlens.sources import metrics as src
from fleetlens.sources import registry as reg
from fleetlens.streaming.jobs import ingest_logs

RANGE, STEP = 21600, 3600


@query(
    "src_range_response",
    f"""
    SELECT {text('timestamp')} AS timestamp, metric_name, value,
           CASE WHEN metric_name = 'cpu_usage_real' THEN 'system' ELSE model_id END AS model_id,
           CASE WHEN metric_name = 'cpu_usage_real' THEN instance END AS instance
    FROM metrics WHERE event_id % 11 <> 0""",
)
def range_response(t: Tables) -> DataFrame:
    """Responses are landed as JSON, at most 500 points each, then read back and flattened."""
    point = F.array(
        F.unix_seconds("timestamp").cast("string"),
        F.when(F.col("event_id") % 11 == 0, "bad").otherwise(F.col("value").cast("string")),
    )
    labels = F.create_map(F.lit("model_id"), "model_id", F.lit("instance"), "instance")
    series = (
        t.metrics.withColumn("part", F.floor(F.col("event_id") / 500))
        .groupBy("metric_name", "part", "model_id", "instance")
        .agg(F.collect_list(point).alias("values"))
        .withColumn("metric", labels)
    )
    body = F.struct(F.lit("matrix").alias("resultType"), F.collect_list(F.struct("metric", "values")).alias("result"))
    responses = series.groupBy("metric_name", "part").agg(body.alias("data")).select(
        F.lit("success").alias("status"), "metric_name", "data"
    )
    path = fresh_folder(t.spark, "responses")
    responses.write.json(path)
    return src.flatten_range_responses(src.read_range_responses(t.spark, path))


def quantile_sql(q: float, rates: str) -> str:
    """Quantile of bucket rates by the first bucket that reaches the rank."""
    return f"""(
        SELECT model_id, e, arg_min(CASE WHEN isinf(le) THEN le0 ELSE le0 + (le - le0) * (rank - c0) / (c - c0) END, le) AS value
        FROM (SELECT *, {q} * max(c) OVER (PARTITION BY model_id, e) AS rank FROM (
                SELECT model_id, e, le, value AS c, lag(le, 1, 0.0::DOUBLE) OVER w AS le0, lag(value, 1, 0.0::DOUBLE) OVER w AS c0
                FROM {rates} WINDOW w AS (PARTITION BY model_id, e ORDER BY le)))
        WHERE rank > 0 AND c >= rank GROUP BY model_id, e)"""


_bucket_rates = rate("buckets", "model_id, le", RANGE, STEP)
view("available", "SELECT instance, ts, 0 AS id, (100 - memory_percent) * 1e8 AS value FROM hosts")


@query(
    "src_collect_all_metrics",
    f"""
    SELECT 'requests_total' AS metric_name, model_id, NULL AS instance, {at('e')} AS ts, {r6('value')} AS value
    FROM {instant('counts', 'model_id', RANGE, STEP)}
    UNION ALL
    SELECT 'latency_avg', model_id, NULL, {at('e')}, {r6('s.value / c.value')}
    FROM {rate('sums', 'model_id', RANGE, STEP)} s JOIN {rate('counts', 'model_id', RANGE, STEP)} c USING (model_id, e)
    WHERE c.value <> 0
    UNION ALL
    SELECT 'latency_p95', model_id, NULL, {at('e')}, {r6('value')} FROM {quantile_sql(0.95, _bucket_rates)}
    UNION ALL
    SELECT 'latency_p99', model_id, NULL, {at('e')}, {r6('value')} FROM {quantile_sql(0.99, _bucket_rates)}
    UNION ALL
    SELECT 'cpu_usage_real', 'system', instance, {at('e')}, {r6('100 - avg(value) * 100')}
    FROM {rate('idle', 'instance, cpu', RANGE, STEP)} GROUP BY instance, e
    UNION ALL
    SELECT 'memory_usage_real', 'system', instance, {at('e')}, {r6('(1 - value / 1e10) * 100')}
    FROM {instant('available', 'instance', RANGE, STEP)}
    UNION ALL
    SELECT 'network_io_real', 'system', 'unknown', {at('e')}, {r6('sum(a.value + b.value)')}
    FROM {rate('received', 'instance, device', RANGE, STEP)} a JOIN {rate('sent', 'instance, device', RANGE, STEP)} b
        USING (instance, device, e) GROUP BY e""",
)
def collect_all_metrics(t: Tables) -> DataFrame:
    """Every metric expression on one grid, from one stacked table of samples."""
    cpu, cents = F.col("kind") == collect.CPU, F.col("t")
    used = (F.lit(1.0) - (F.lit(100.0) - F.col("memory_percent")) * 1e8 / F.lit(1e10)) * 100
    samples = [
        collect.samples_of(t.latency, collect.REQUESTS, "model_id", None, "total", "count"),
        collect.samples_of(t.buckets, collect.BUCKET, "model_id", "le", "value"),
        collect.samples_of(t.host_counters, F.col("kind"), "instance", "part", F.when(cpu, cents / F.lit(10000.0)).otherwise(cents * 100), F.when(~cpu, cents * 50)),
        collect.samples_of(t.host_gauge(used), collect.MEMORY, "instance", None, "value"),
    ]
    return collect.collect_metrics(src.stack_frames(samples), RANGE, STEP)


@query(
    "src_kafka_metrics",
    f"""
    SELECT {text('ts')} AS timestamp, metric_name, {r6('m.value')} AS value, model_id
    FROM metrics m JOIN (SELECT event_id, ts FROM ev) USING (event_id)
    WHERE event_id % 11 > 3 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
)
def kafka_metrics(t: Tables) -> DataFrame:
    """Messages with a missing field, a wrong kind or no JSON at all are skipped."""
    parsed = src.parse_messages(time_range(messages(t), moment("2024-01-05"), moment("2024-01-20")))
    return parsed.select("timestamp", "metric_name", "value", F.col("labels")["model_id"].alias("model_id"))


def messages(t: Tables) -> DataFrame:
    """Metric messages as a topic would hold them; some are invalid."""
    labels = F.create_map(F.lit("model_id"), F.col("model_id")).alias("labels")
    name, value, at_ = metric_name().alias("metric_name"), F.col("value"), F.col("ts").cast("string").alias("timestamp")
    kind = F.col("event_id") % 11
    body = (
        F.when(kind == 0, F.to_json(F.struct(name, at_, labels)))
        .when(kind == 1, F.to_json(F.struct(name, value.cast("string").alias("value"), at_, labels)))
        .when(kind == 2, F.to_json(F.struct(F.col("event_id").alias("metric_name"), value.alias("value"), at_, labels)))
        .when(kind == 3, F.lit("{not json"))
        .otherwise(F.to_json(F.struct(name, value.alias("value"), at_, labels)))
    )
    return t.events.select(body.alias("value"), F.col("ts").alias("timestamp"), "event_id")


@query(
    "src_inference_log_stream",
    f"""
    SELECT event_id, {text('timestamp')} AS timestamp, model_id, {text('timestamp')}[:10] AS day,
           coalesce(level, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN latency > 1 THEN 'WARNING' ELSE 'INFO' END) AS level
    FROM logs""",
)
def inference_log_stream(t: Tables) -> DataFrame:
    """The log table as a stream, normalised and appended to a table."""
    path = fresh_folder(t.spark, "log-stream")
    ingest_logs(logs_of(events_of(t.stream("events"))), path + "/table", path + "/checkpoint").awaitTermination()
    return t.spark.read.parquet(path + "/table").select("event_id", "timestamp", "model_id", F.to_date("day").alias("day"), "level")


@query(
    "src_registry",
    """
    SELECT model_id, CASE WHEN number < 8 THEN 'healthy' ELSE 'unknown' END AS status, 8000 + number AS port,
           'http://localhost:' || (8000 + number) AS url, CASE WHEN number < 8 THEN 2 END AS n_features
    FROM (SELECT DISTINCT (user_id % 10)::INTEGER AS number, 'm' || (user_id % 10) AS model_id FROM ev)
    WHERE number <> 9""",
)
def registry(t: Tables) -> DataFrame:
    """Registry documents written as text and read back, plus ids known from port files alone."""
    number = F.col("number")
    entry = F.struct(
        (number + 8000).alias("port"),
        F.concat(F.lit("http://localhost:"), (number + 8000).cast("string")).alias("url"),
        F.lit("healthy").alias("status"),
        F.array(F.lit("x"), F.lit("y")).alias("features"),
    )
    path = fresh_folder(t.spark, "registry")
    t.registry.select(F.to_json(F.create_map("model_id", entry)).alias("value")).write.text(path)
    ports = t.events.select((F.col("user_id") % 10).alias("n")).distinct().select(
        F.concat(F.lit("m"), F.col("n").cast("string"), F.lit(".port")).alias("file_name"),
        F.when(F.col("n") == 9, "none").otherwise(F.concat((F.col("n") + 8000).cast("string"), F.lit("\n"))).alias("value"),
    )
    rows = reg.with_port_files(reg.read_registry(t.spark, path), ports)
    return rows.select(
        "model_id", "status", "port", "url", F.when(F.col("features").isNotNull(), F.size("features")).alias("n_features")
    )


@query(
    "src_threshold_config",
    f"""
    SELECT coalesce(o.category, d.category) AS category, coalesce(o.key, d.key) AS key, {r6('coalesce(o.value, d.value)')} AS value
    FROM (VALUES ('latency_rules','critical',5.0::DOUBLE), ('latency_rules','warning',1.0), ('latency_rules','batch',30.0),
                 ('error_rules','max_error_rate',0.05), ('error_rules','consecutive_errors',5.0),
                 ('error_rules','error_window',100.0), ('resource_rules','cpu_threshold',80.0),
                 ('resource_rules','memory_threshold',85.0), ('resource_rules','disk_threshold',90.0),
                 ('model_performance_rules','min_accuracy',0.9), ('model_performance_rules','accuracy_drop_threshold',0.05),
                 ('model_performance_rules','feature_drift_threshold',0.1), ('health_rules','max_startup_time',300.0),
                 ('health_rules','healthcheck_interval',60.0), ('health_rules','dependency_timeout',10.0))
         AS d(category, key, value)
    FULL JOIN (SELECT CASE event_type WHEN 'click' THEN 'resource_rules' WHEN 'view' THEN 'latency_rules' ELSE 'site_rules' END AS category,
                      CASE event_type WHEN 'click' THEN 'cpu_threshold' WHEN 'view' THEN 'warning' ELSE event_type END AS key,
                      max(value) AS value FROM ev GROUP BY ALL) o
    ON d.category = o.category AND d.key = o.key""",
)
def threshold_config(t: Tables) -> DataFrame:
    event = F.col("event_type")
    file_values = t.events.groupBy(
        F.when(event == "click", "resource_rules").when(event == "view", "latency_rules").otherwise("site_rules").alias("category"),
        F.when(event == "click", "cpu_threshold").when(event == "view", "warning").otherwise(event).alias("key"),
    ).agg(F.max("value").alias("value"))
    return reg.overlay_thresholds(reg.default_thresholds(t.spark), file_values)


@query("src_metric_names", "SELECT DISTINCT metric_name FROM metrics")
def metric_names(t: Tables) -> DataFrame:
    return src.metric_names(t.metrics)


@query(
    "src_latest_n_logs",
    f"""
    SELECT event_id, {text('timestamp')} AS timestamp, model_id, coalesce(level, 'INFO') AS level
    FROM logs ORDER BY event_id DESC LIMIT 1000""",
)
def latest_n_logs(t: Tables) -> DataFrame:
    return latest(t.logs, 1000).select("event_id", "timestamp", "model_id", "level")
