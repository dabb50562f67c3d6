"""Joins, set operations, sorting, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.catalog.sql import at, r6, rate, seconds, text
from fleetlens.catalog.tables import Tables
from fleetlens.operators import joins, tsexpr
from fleetlens.operators.alerts import for_models, system_alerts
from fleetlens.schemas import BASIC_METRICS

TS = f"{text('timestamp')} AS timestamp"


def _mean(m: str) -> str:
    return f"LEFT JOIN (SELECT model_id, timestamp, avg(value) AS {m} FROM gaps WHERE metric_name = '{m}' GROUP BY ALL) USING (model_id, timestamp)"


@query(
    "join_metric_left",
    f"""
    SELECT model_id, {TS}, {', '.join(f'{r6(m)} AS {m}' for m in BASIC_METRICS)}
    FROM (SELECT DISTINCT model_id, timestamp FROM gaps) {' '.join(_mean(m) for m in BASIC_METRICS)}""",
)
def metric_left(t: Tables) -> DataFrame:
    return joins.metric_left(t.gaps, BASIC_METRICS)


def _one(t: Tables, metric: str) -> DataFrame:
    rows = t.hourly.where((F.col("metric_name") == metric) & F.col("value").isNotNull())
    return rows.select("model_id", "timestamp", F.col("value").alias(metric))


@query(
    "join_forecasts",
    f"""
    SELECT model_id, {TS}, {', '.join(f'{r6(m)} AS {m}' for m in BASIC_METRICS)}
    FROM wide WHERE {' AND '.join(f'{m} IS NOT NULL' for m in BASIC_METRICS)}""",
)
def join_forecasts(t: Tables) -> DataFrame:
    return joins.join_forecasts([_one(t, m) for m in BASIC_METRICS])


@query(
    "join_vector_ratio",
    f"""
    SELECT model_id, {at('e')} AS ts, {r6('s.value / c.value')} AS value
    FROM {rate('sums', 'model_id', 3600, 900)} s JOIN {rate('counts', 'model_id', 3600, 900)} c USING (model_id, e)
    WHERE c.value <> 0""",
)
def vector_ratio(t: Tables) -> DataFrame:
    top, bottom = tsexpr.rate(t.sums, ["model_id"], 3600, 900), tsexpr.rate(t.counts, ["model_id"], 3600, 900)
    return joins.vector_ratio(top, bottom, ["model_id", "ts"])


@query(
    "join_vector_sum",
    f"""
    SELECT instance, device, {at('e')} AS ts, {r6('a.value + b.value')} AS value
    FROM {rate('received', 'instance, device', 3600, 900)} a JOIN {rate('sent', 'instance, device', 3600, 900)} b
    USING (instance, device, e)""",
)
def vector_sum(t: Tables) -> DataFrame:
    keys = ["instance", "device"]
    received, sent = (
        tsexpr.rate(t.network.withColumn("value", F.col(c)), keys, 3600, 900) for c in ("received", "sent")
    )
    return joins.vector_sum(received, sent, [*keys, "ts"])


@query(
    "join_model_status",
    f"""
    SELECT coalesce(r.model_id, s.model_id) AS model_id,
           CASE WHEN r.model_id IS NULL THEN s.service_status
                WHEN r.number % 3 <> 2 AND r.number % 4 <> 3 THEN 'active' ELSE 'inactive' END AS status,
           CASE WHEN r.model_id IS NULL THEN 0 ELSE 8 END::BIGINT AS feature_count,
           coalesce(r.prediction_count, 0) AS total_predictions,
           {r6('coalesce(round(r.avg_latency * 1000, 2), 0)')} AS avg_latency_ms,
           CASE WHEN r.model_id IS NULL THEN 'Never' ELSE {seconds('r.last_prediction')} END AS last_prediction,
           r.model_id IS NULL OR (r.number % 3 <> 2 AND r.number % 4 <> 3) AS deployed,
           CASE WHEN r.model_id IS NULL OR (r.number % 3 <> 2 AND r.number % 4 <> 3) THEN s.url END AS url
    FROM registry r FULL JOIN services s ON r.model_id = s.model_id""",
)
def model_status(t: Tables) -> DataFrame:
    processes = t.registry.select("model_id", (F.col("number") % 3 != 2).alias("running"), (F.col("number") % 4 != 3).alias("healthy"))
    models = t.registry.select("model_id", "feature_count", "prediction_count", "avg_latency", "last_prediction")
    status = joins.model_status(models, processes, t.services)
    return status.select(
        "model_id", "status", "metadata.feature_count", "performance.*", "deployment.deployed", "deployment.url"
    )


SYSTEM_SQL = f"""
    SELECT m.model_id, instance, {text('ts')} AS ts, type, 'WARNING' AS level, {r6('value')} AS value, threshold,
           'System ' || label || ' usage (' || printf('%.1f', value) || '%) exceeds threshold (' || threshold || '%)' AS message
    FROM (SELECT DISTINCT model_id, instance FROM ev) m
    JOIN (SELECT instance, ts, 'system_cpu_usage' AS type, 'CPU' AS label, cpu_percent AS value, 80.0::DOUBLE AS threshold FROM hosts
          UNION ALL SELECT instance, ts, 'system_memory_usage', 'Memory', memory_percent, 85.0 FROM hosts
          UNION ALL SELECT instance, ts, 'system_disk_usage', 'Disk', disk_percent, 90.0 FROM hosts) USING (instance)
    WHERE value > threshold"""


@query("join_alerts_system_x_models", SYSTEM_SQL)
def alerts_system_x_models(t: Tables) -> DataFrame:
    """A breach of a host is repeated for each model on it."""
    return for_models(system_alerts(t.events, t.hosts), t.events)


@query(
    "join_semi_registered",
    """
    SELECT event_id, 'm' || (user_id % 10) AS model_id, CASE WHEN user_id % 10 >= 8 THEN 'Model not registered' END AS error FROM ev""",
)
def semi_registered(t: Tables) -> DataFrame:
    asked = t.events.select("event_id", F.concat(F.lit("m"), (F.col("user_id") % 10).cast("string")).alias("model_id"))
    return joins.answered(asked, t.registry)


@query("set_services_gone", "SELECT model_id FROM services EXCEPT SELECT model_id FROM registry")
def services_gone(t: Tables) -> DataFrame:
    return joins.services_gone(t.services, t.registry)


@query(
    "set_registry_only",
    """
    SELECT model_id, status, prediction_count FROM registry
    UNION ALL
    SELECT model_id, service_status, NULL FROM services WHERE model_id NOT IN (SELECT model_id FROM registry)""",
)
def registry_only(t: Tables) -> DataFrame:
    services = t.services.select("model_id", F.col("service_status").alias("status"))
    return joins.add_registry_only(t.registry.select("model_id", "status", "prediction_count"), services)


@query("srt_time", f"SELECT event_id, {text('ts')} AS ts, model_id FROM ev ORDER BY ts, event_id")
def sort_time(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", "model_id").orderBy("ts", "event_id")


@query(
    "top_page",
    f"SELECT event_id, {TS}, model_id FROM logs ORDER BY logs.timestamp DESC, event_id DESC LIMIT 50 OFFSET 100",
)
def top_page(t: Tables) -> DataFrame:
    """The third page, by the bookmarks of those before it."""
    order, after = ["timestamp", "event_id"], None
    rows = t.logs.select("event_id", "timestamp", "model_id")
    for _ in range(2):
        after = joins.bookmark(joins.page_after(rows, order, after), order)
    return joins.page_after(rows, order, after)


@query(
    "top_latest_value",
    f"""
    SELECT metric_name, {text('max(timestamp)')} AS timestamp, arg_max(value, event_id) AS value
    FROM metrics GROUP BY metric_name""",
)
def latest_value(t: Tables) -> DataFrame:
    return joins.latest_value(t.metrics, ["metric_name"], tie="event_id")
