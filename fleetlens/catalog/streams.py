"""Streaming jobs, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog.alerting import GRID, NOTIFICATIONS_SQL, WIDE, alert_spans
from fleetlens.catalog.cleaning import twice
from fleetlens.catalog.registry import query
from fleetlens.catalog.sql import at, evaluations, hold, r6, text
from fleetlens.catalog.tables import Tables, events_of, logs_of
from fleetlens.operators import tsexpr
from fleetlens.operators.alerts import resource_alerts
from fleetlens.session import fresh_folder
from fleetlens.streaming import jobs
from fleetlens.streaming.alert_state import hold_stream
from fleetlens.streaming.notify_state import notification_stream


def _events(t: Tables) -> DataFrame:
    return events_of(t.stream("events"))


@query(
    "str_log_ingest",
    f"""
    SELECT model_id, {text('timestamp')}[:10] AS day, count(*) AS n,
           count(*) FILTER (coalesce(upper(level), CASE WHEN error IS NOT NULL THEN 'ERROR' END) = 'ERROR') AS errors
    FROM logs GROUP BY ALL""",
)
def log_ingest(t: Tables) -> DataFrame:
    path = fresh_folder(t.spark, "ingest")
    jobs.ingest_logs(logs_of(_events(t)), path + "/table", path + "/checkpoint").awaitTermination()
    table = t.spark.read.parquet(path + "/table")
    failed = F.upper("level") == "ERROR"
    return table.groupBy("model_id", F.col("day").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_if(failed).alias("errors"))


@query(
    "str_sliding_metrics",
    f"""
    SELECT model_id, {at('e')} AS ts, count(*) AS n, {r6('avg(latency)')} AS mean
    FROM (SELECT model_id, latency, {evaluations(15, 300)} AS e FROM (SELECT model_id, latency, timestamp AS ts FROM logs)) GROUP BY model_id, e""",
)
def sliding_metrics(t: Tables) -> DataFrame:
    """What the stream closed, and after its end a last pass over what the watermark kept open."""
    path = fresh_folder(t.spark, "sliding")
    stream = jobs.sliding_metrics(logs_of(_events(t)), ["model_id"])
    jobs.append_to(stream, path + "/table", path + "/checkpoint").awaitTermination()
    closed = t.spark.read.parquet(path + "/table")
    return closed.unionByName(jobs.open_ranges(t.logs, closed, ["model_id"]))


@query(
    "str_alert_for_state",
    f"""
    SELECT model_id AS series, {at('e')} AS ts, {at('since')} AS since, state FROM {hold('lat_high', 'model_id', 1800, GRID)}
    UNION ALL
    SELECT model_id, {at(f'max(e) + {GRID}')}, {at('since')}, 'resolved' FROM {hold('lat_high', 'model_id', 1800, GRID)}
    GROUP BY model_id, since HAVING max(e) - since >= 1800 AND max(e) + {GRID} <= (SELECT max(e) - {GRID} FROM lat_high)""",
)
def alert_for_state(t: Tables) -> DataFrame:
    """True evaluations are written to a table, streamed back and followed per model."""
    spark = t.spark
    path = fresh_folder(spark, "hold")
    above = tsexpr.latency_avg(t.latency, ["model_id"], WIDE, GRID).where("value > 1.0")
    above.select(F.col("model_id").alias("series"), F.unix_seconds("ts").alias("epoch")).write.parquet(path + "/in")
    stream = hold_stream(spark.readStream.schema("series STRING, epoch BIGINT").parquet(path + "/in"), 1800, GRID)
    jobs.append_to(stream, path + "/table", path + "/checkpoint").awaitTermination()
    return spark.read.parquet(path + "/table")


LATE = 3600


@query("str_notifications", f"SELECT * FROM ({NOTIFICATIONS_SQL}) WHERE sent_at <= (SELECT {at(f'max(at_) - {LATE}')} FROM group_changes)")
def notifications(t: Tables) -> DataFrame:
    """Starts and ends of alerts are written to a table, streamed back and followed per group up to the watermark."""
    path = fresh_folder(t.spark, "notify")
    ends = F.array(F.struct(F.col("starts").alias("epoch"), F.lit(True).alias("fires")), F.struct(F.col("ends").alias("epoch"), F.lit(False).alias("fires")))
    changes = alert_spans(t).select("alertname", F.col("model_id").alias("alert"), F.inline(ends))
    changes.write.parquet(path + "/in")
    stream = notification_stream(t.spark.readStream.schema("alertname STRING, alert STRING, epoch BIGINT, fires BOOLEAN").parquet(path + "/in"), LATE)
    jobs.append_to(stream, path + "/table", path + "/checkpoint").awaitTermination()
    return t.spark.read.parquet(path + "/table")


@query(
    "str_health_state",
    """
    SELECT model_id, id, failures, CASE WHEN failures >= 3 THEN 'unavailable' ELSE 'available' END AS status
    FROM (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY model_id, run ORDER BY ts, id) AS failures
          FROM (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY model_id ORDER BY ts, id) AS run FROM checks))""",
)
def health_state(t: Tables) -> DataFrame:
    path = fresh_folder(t.spark, "health")
    checks = _events(t).select("model_id", "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    jobs.health_stream(checks, path, path + "/checkpoint").awaitTermination()
    return t.spark.read.parquet(path + "/out").select("model_id", "id", "failures", "status")


@query(
    "str_counter_rate",
    f"""
    SELECT model_id, id, delta, {r6('CASE WHEN us > prev_us THEN delta / ((us - prev_us) / 1e6) END')} AS rate
    FROM (SELECT *, CASE WHEN value < prev THEN value ELSE value - prev END AS delta
          FROM (SELECT *, epoch_us(ts) AS us, lag(value) OVER w AS prev, lag(epoch_us(ts)) OVER w AS prev_us
                FROM readings WINDOW w AS (PARTITION BY model_id ORDER BY ts, id)))""".replace(
        "readings", "(SELECT model_id, ts, event_id AS id, cents::DOUBLE AS value FROM ev)"
    ),
)
def counter_rate(t: Tables) -> DataFrame:
    """Readings that often fall, so the counter restarts often."""
    path = fresh_folder(t.spark, "rate")
    samples = _events(t).select("model_id", "ts", F.col("event_id").alias("id"), F.col("cents").cast("double").alias("value"))
    jobs.counter_stream(samples, path, path + "/checkpoint").awaitTermination()
    return t.spark.read.parquet(path + "/out").select("model_id", "id", "delta", "rate")


@query(
    "str_periodic_eval",
    f"""
    SELECT event_id, model_id, 'cpu_usage' AS type, 'WARNING' AS level, {r6('least(value, 100)')} AS value, 80.0::DOUBLE AS threshold FROM ev WHERE value > 80
    UNION ALL
    SELECT event_id, model_id, 'memory_usage', 'WARNING', {r6('least(value / 2, 100)')}, 85.0::DOUBLE FROM ev WHERE value / 2 > 85""",
)
def periodic_eval(t: Tables) -> DataFrame:
    path = fresh_folder(t.spark, "periodic")
    snapshots = _events(t).select(
        "event_id",
        "model_id",
        F.least("value", F.lit(100.0)).alias("cpu_percent"),
        F.least(F.col("value") / 2, F.lit(100.0)).alias("memory_percent"),
    )
    run = jobs.evaluate_periodically(snapshots, path + "/out", path + "/checkpoint", ["event_id", "model_id"], every=None, rules=resource_alerts)
    run.awaitTermination()
    return t.spark.read.parquet(path + "/out").drop("batch", "message")


@query("str_dedupe", f"SELECT event_id, {text('timestamp')} AS timestamp, model_id FROM logs")
def dedupe(t: Tables) -> DataFrame:
    """Every tenth log comes twice."""
    path = fresh_folder(t.spark, "dedupe")
    stream = jobs.dedupe(twice(logs_of(_events(t))), ["event_id"])
    jobs.append_to(stream, path + "/table", path + "/checkpoint").awaitTermination()
    return t.spark.read.parquet(path + "/table").select("event_id", "timestamp", "model_id")
