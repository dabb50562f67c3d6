"""Time-series expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.catalog.sql import at, instant, r6, ranges, rate, text
from fleetlens.catalog.sources import quantile_sql
from fleetlens.catalog.tables import Tables
from fleetlens.operators import tsexpr

LE = "CASE WHEN isinf(le) THEN '+Inf' ELSE le::VARCHAR END"


@query("ts_instant_asof", f"SELECT model_id, {at('e')} AS ts, value FROM {instant('counts', 'model_id', 300, 60)}")
def instant_asof(t: Tables) -> DataFrame:
    return tsexpr.instant(t.counts, ["model_id"], 300, 60)


@query(
    "ts_counter_delta",
    """
    SELECT model_id, id, value, CASE WHEN value < prev THEN value ELSE value - prev END AS delta
    FROM (SELECT *, lag(value) OVER (PARTITION BY model_id ORDER BY ts, id) AS prev FROM counts)""",
)
def counter_delta(t: Tables) -> DataFrame:
    return tsexpr.counter_delta(t.counts, ["model_id"]).select("model_id", "id", "value", "delta")


@query("ts_rate", f"SELECT model_id, {at('e')} AS ts, {r6('value')} AS value FROM {rate('counts', 'model_id')}")
def rate_(t: Tables) -> DataFrame:
    return tsexpr.rate(t.counts, ["model_id"])


@query(
    "ts_increase",
    f"SELECT model_id, instance, {at('e')} AS ts, {r6('growth')} AS value FROM {ranges('errors', 'model_id, instance')} WHERE n >= 2",
)
def increase(t: Tables) -> DataFrame:
    return tsexpr.increase(t.errors, ["model_id", "instance"])


@query(
    "ts_latency_avg",
    f"""
    SELECT model_id, {at('e')} AS ts, {r6('s.value / c.value')} AS value
    FROM {rate('sums', 'model_id')} s JOIN {rate('counts', 'model_id')} c USING (model_id, e) WHERE c.value <> 0""",
)
def latency_avg(t: Tables) -> DataFrame:
    return tsexpr.latency_avg(t.latency, ["model_id"])


_rates = rate("buckets", "model_id, le", 21600, 3600)


@query(
    "ts_histogram_quantile",
    f"""
    SELECT model_id, 0.95::DOUBLE AS q, {at('e')} AS ts, {r6('value')} AS value FROM {quantile_sql(0.95, _rates)}
    UNION ALL
    SELECT model_id, 0.99::DOUBLE, {at('e')}, {r6('value')} FROM {quantile_sql(0.99, _rates)}""",
)
def histogram_quantile(t: Tables) -> DataFrame:
    rates = tsexpr.rate(t.buckets, ["model_id", "le"], 21600, 3600)
    return tsexpr.histogram_quantiles(rates, [0.95, 0.99], ["model_id", "ts"]).where("value IS NOT NULL")


@query(
    "ts_histogram_build",
    f"SELECT model_id, {text('ts')} AS ts, {LE} AS le, n, {r6('total')} AS sum, cnt AS count FROM histogram",
)
def histogram_build(t: Tables) -> DataFrame:
    built = tsexpr.histogram_build(t.logs.withColumn("ts", F.date_trunc("hour", "timestamp")), ["model_id", "ts"])
    return built.withColumn("le", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")))


@query(
    "ts_request_counts",
    f"""
    SELECT endpoint, model_id, {text("date_trunc('hour', timestamp)")} AS window_start, count(*) AS requests, count(error) AS errors
    FROM logs GROUP BY ALL""",
)
def request_counts(t: Tables) -> DataFrame:
    return tsexpr.request_counts(t.logs)


_increases = f"(SELECT model_id, instance, e, growth AS value FROM {ranges('errors', 'model_id, instance', 3600, 900)} WHERE n >= 2)"


@query(
    "ts_agg_by_label",
    f"""
    SELECT 'sum by model' AS expr, model_id AS label, {at('e')} AS ts, {r6('sum(value)')} AS value FROM {_increases} GROUP BY model_id, e
    UNION ALL SELECT 'avg by instance', instance, {at('e')}, {r6('avg(value)')} FROM {_increases} GROUP BY instance, e
    UNION ALL SELECT 'sum', '', {at('e')}, {r6('sum(value)')} FROM {_increases} GROUP BY e""",
)
def agg_by_label(t: Tables) -> DataFrame:
    grown = tsexpr.increase(t.errors, ["model_id", "instance"], 3600, 900)

    def shaped(df: DataFrame, expr: str, label: str | None) -> DataFrame:
        shown = F.col(label) if label else F.lit("")
        return df.select(F.lit(expr).alias("expr"), shown.alias("label"), "ts", "value")

    by_model = shaped(tsexpr.agg_by_label(grown, ["model_id"], "sum"), "sum by model", "model_id")
    by_instance = shaped(tsexpr.agg_by_label(grown, ["instance"], "avg"), "avg by instance", "instance")
    return by_model.unionByName(by_instance).unionByName(shaped(tsexpr.agg_by_label(grown, [], "sum"), "sum", None))


@query(
    "ts_cpu_percent",
    f"SELECT instance, {at('e')} AS ts, {r6('100 - avg(value) * 100')} AS value FROM {rate('idle', 'instance, cpu')} GROUP BY instance, e",
)
def cpu_percent(t: Tables) -> DataFrame:
    return tsexpr.cpu_percent(t.idle)


@query("ts_memory_percent", f"SELECT instance, {text('ts')} AS ts, {r6('(1 - value / 1e10) * 100')} AS value FROM available")
def memory_percent(t: Tables) -> DataFrame:
    available = t.host_gauge((F.lit(100.0) - F.col("memory_percent")) * 1e8)
    return tsexpr.memory_percent(available, t.host_gauge(F.lit(1e10)))


@query(
    "ts_disk_percent",
    f"""
    SELECT instance, '/data' AS mountpoint, {text('ts')} AS ts,
           {r6('(5e11 - (100 - disk_percent) * 5e9) * 100 / 5e11')} AS value
    FROM hosts""",
)
def disk_percent(t: Tables) -> DataFrame:
    mount = F.lit("/data").alias("mountpoint")
    free = t.host_gauge((F.lit(100.0) - F.col("disk_percent")) * 5e9, mount)
    return tsexpr.disk_percent(free, t.host_gauge(F.lit(5e11), mount))


@query(
    "ts_network_bytes",
    f"""
    SELECT instance, {at('e')} AS ts, {r6('sum(a.value + b.value)')} AS value
    FROM {rate('received', 'instance, device')} a JOIN {rate('sent', 'instance, device')} b USING (instance, device, e)
    GROUP BY instance, e""",
)
def network_bytes(t: Tables) -> DataFrame:
    return tsexpr.network_bytes(t.network, ["instance"])


@query(
    "ts_io_rate_per_model",
    f"""
    SELECT model_id, instance, {text('ts')} AS ts, {r6('(read_bytes - pr + write_bytes - pw) / ((epoch_us(ts) - epoch_us(pt)) / 1e6)')} AS value
    FROM (SELECT *, lag(ts) OVER w AS pt, lag(read_bytes) OVER w AS pr, lag(write_bytes) OVER w AS pw
          FROM snapshots WINDOW w AS (PARTITION BY model_id, instance ORDER BY ts))
    WHERE pt IS NOT NULL""",
)
def io_rate(t: Tables) -> DataFrame:
    return tsexpr.io_rate(t.snapshots)


@query("ts_active_services", "SELECT count(*) FILTER (service_status = 'running') AS active_services FROM services")
def active_services(t: Tables) -> DataFrame:
    return tsexpr.active_services(t.services, "service_status")


@query(
    "ts_running_stats",
    f"""
    SELECT model_id, event_id, row_number() OVER w AS prediction_count,
           {r6('avg(latency) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS avg_latency
    FROM logs WINDOW w AS (PARTITION BY model_id ORDER BY timestamp, event_id)""",
)
def running_stats(t: Tables) -> DataFrame:
    return tsexpr.running_stats(t.logs).select("model_id", "event_id", "prediction_count", "avg_latency")
