"""Log analytics and resource reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.catalog.sql import r6, text, view
from fleetlens.catalog.tables import Tables
from fleetlens.functions.scalars import moment
from fleetlens.functions.timeline import place
from fleetlens.operators import logs
from fleetlens.session import fresh_folder
from fleetlens.sources.days import write_days

TS = f"{text('timestamp')} AS timestamp"


@query(
    "log_normalize",
    f"""
    SELECT event_id, {TS}, model_id,
           coalesce(level, CASE WHEN error IS NOT NULL OR status_code >= 400 THEN 'ERROR' WHEN latency > 1 THEN 'WARNING' ELSE 'INFO' END) AS level,
           coalesce(message, CASE WHEN latency > 1 THEN 'High latency prediction: ' || latency || 's'
                                  WHEN error IS NOT NULL THEN 'Error: ' || error
                                  ELSE 'Prediction for model ' || model_id END) AS message
    FROM logs""",
)
def normalize(t: Tables) -> DataFrame:
    """Every 13th log lacks its time and takes that of its arrival."""
    raw = t.logs.withColumn("arrival", F.col("timestamp")).withColumn(
        "timestamp", F.when(F.col("event_id") % 13 != 0, F.col("timestamp"))
    )
    return logs.normalize(raw, F.col("arrival")).select("event_id", "timestamp", "model_id", "level", "message")


@query("log_high_latency", f"SELECT event_id, model_id, {r6('latency')} AS latency FROM logs WHERE latency > 1.0")
def high_latency(t: Tables) -> DataFrame:
    return logs.high_latency(t.logs).select("event_id", "model_id", "latency")


_found = """level IS NOT NULL AND upper(level) = 'ERROR' AND timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'
    AND (lower(coalesce(message, '')) LIKE '%request of m3%' OR lower(coalesce(context, '{}')) LIKE '%request of m3%')"""


@query(
    "log_query",
    f"""
    SELECT event_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp, model_id, level, message,
           (SELECT count(*) FROM logs WHERE {_found}) AS total
    FROM logs WHERE {_found} ORDER BY logs.timestamp DESC, event_id DESC LIMIT 20 OFFSET 5""",
)
def log_query(t: Tables) -> DataFrame:
    wanted = {"level": "Error", "start": "2024-01-03", "end": "2024-01-25", "query": "REQUEST of m3"}
    total = logs.search(t.logs, **wanted).agg(F.count("*")).scalar()
    page = logs.query(t.logs, limit=20, offset=5, **wanted)
    return page.select("event_id", "timestamp", "model_id", "level", "message", total.alias("total"))


def _section(section: str, key: str, ratio: str) -> str:
    return f"""SELECT '{section}' AS section, {key} AS key, count(*) AS n, {text('min(timestamp)')} AS first,
           {text('max(timestamp)')} AS last, {ratio} AS fill_ratio FROM logs GROUP BY {key}"""


@query(
    "log_summary",
    " UNION ALL ".join(
        [
            f"SELECT 'total' AS section, 'all' AS key, count(*) AS n, {text('min(timestamp)')} AS first, "
            f"{text('max(timestamp)')} AS last, {r6('count(*) / 10000.0::DOUBLE')} AS fill_ratio FROM logs",
            _section("level", "coalesce(upper(level), 'UNKNOWN')", "NULL"),
            _section("model", "model_id", "NULL"),
        ]
    ),
)
def summary(t: Tables) -> DataFrame:
    return logs.summary(t.logs)


@query(
    "log_retention",
    f"SELECT event_id, {TS} FROM logs WHERE timestamp >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS",
)
def retention(t: Tables) -> DataFrame:
    """Logs lie in a folder per day; those of the days that are too old are removed."""
    path = fresh_folder(t.spark, "retained")
    write_days(t.logs.select("event_id", "timestamp"), path)
    return logs.expire(t.spark, path, datetime(2024, 1, 31), 7).select("event_id", "timestamp")


@query(
    "log_error_breakdown",
    """
    SELECT model_id, CASE WHEN status_code = 404 THEN 'not_found' ELSE 'prediction' END AS error_type, count(*) AS n
    FROM logs WHERE error IS NOT NULL GROUP BY ALL""",
)
def error_breakdown(t: Tables) -> DataFrame:
    return logs.error_breakdown(t.logs)


def bytes_sql(b: str) -> str:
    return f"""CASE WHEN {b} < 1024 THEN printf('%.2f B', {b}) WHEN {b} / 1024.0 < 1024 THEN printf('%.2f KB', {b} / 1024.0)
        WHEN {b} / 1048576.0 < 1024 THEN printf('%.2f MB', {b} / 1048576.0)
        WHEN {b} / 1073741824.0 < 1024 THEN printf('%.2f GB', {b} / 1073741824.0)
        ELSE printf('%.2f TB', {b} / 1099511627776.0) END"""


view(
    "newest",
    """
    SELECT model_id, arg_max(cpu_percent, k) AS c, arg_max(memory_percent, k) AS m, arg_max(memory_bytes, k) AS b,
           arg_max(read_bytes, k) AS r, arg_max(write_bytes, k) AS w
    FROM (SELECT *, epoch_us(ts) * 10 + substr(instance, 2)::INTEGER AS k FROM snapshots) GROUP BY model_id""",
)
_state = "CASE WHEN number % 3 = 2 THEN 'STOPPED' WHEN number = 4 THEN 'ERROR' ELSE 'RUNNING' END"


def _if_running(x: str) -> str:
    return f"CASE WHEN number % 3 = 2 OR number = 4 THEN 'N/A' ELSE {x} END"


@query(
    "res_report",
    f"""
    SELECT model_id, {_state} AS status, {_if_running("printf('%.2f', c) || '%'")} AS cpu, {_if_running(bytes_sql('b'))} AS memory,
           {_if_running("printf('%.2f', m) || '%'")} AS memory_share,
           {_if_running(bytes_sql('r') + " || ' in / ' || " + bytes_sql('w') + " || ' out'")} AS network,
           {_if_running("(up // 3600) || 'h ' || (up % 3600 // 60) || 'm'")} AS uptime_text
    FROM (SELECT *, epoch_us(last_prediction) // 1000000 - epoch_us(TIMESTAMP '2024-01-01') // 1000000 AS up FROM registry) JOIN newest USING (model_id)
    UNION ALL
    SELECT 'system', 'RUNNING', printf('%.2f', avg(cpu_percent)) || '%', 'N/A', printf('%.2f', max(memory_percent)) || '%', 'N/A', 'N/A' FROM hosts""",
)
def resource_report(t: Tables) -> DataFrame:
    columns = ["cpu_percent", "memory_percent", "memory_bytes", "read_bytes", "write_bytes"]
    numbered = t.snapshots.withColumn("_host", F.substring("instance", 2, 9).cast("long"))
    newest = numbered.groupBy("model_id").agg(*[F.max_by(c, place("ts", "_host")).alias(c) for c in columns])
    number = F.col("number")
    rows = t.registry.join(newest, "model_id").select(
        "model_id",
        F.when(number % 3 == 2, "not_running").alias("status"),
        F.when(number == 4, "no process").alias("error"),
        *columns,
        (F.unix_seconds("last_prediction") - F.unix_seconds(moment("2024-01-01"))).cast("double").alias("uptime"),
    )
    host = t.hosts.agg(F.avg("cpu_percent").alias("cpu_percent"), F.max("memory_percent").alias("memory_percent"))
    report = rows.unionByName(host.withColumn("model_id", F.lit("system")), allowMissingColumns=True)
    return logs.resource_report(report)


@query(
    "res_fleet_health",
    f"""
    SELECT registered, deployed, {r6('cpu')} AS cpu_percent, {r6('mem')} AS memory_percent
    FROM (SELECT count(*) AS registered, count(*) FILTER (status = 'running') AS deployed FROM registry),
         (SELECT avg(cpu_percent) AS cpu, avg(memory_percent) AS mem FROM snapshots)""",
)
def fleet_health(t: Tables) -> DataFrame:
    return logs.fleet_health(t.registry, t.snapshots)
