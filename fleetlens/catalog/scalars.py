"""Filters, validation, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog.registry import query
from fleetlens.catalog.sources import messages
from fleetlens.catalog.sql import r6, seconds, text
from fleetlens.catalog.tables import Tables
from fleetlens.functions import scalars as fn
from fleetlens.functions.scalars import moment
from fleetlens.operators import alerts, filters, sizing
from fleetlens.operators.clean import pivot_metrics
from fleetlens.schemas import BASIC_METRICS
from fleetlens.sources.metrics import check_messages


@query(
    "flt_time_range",
    f"""
    SELECT event_id, {text('ts')} AS ts FROM ev
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-11 12:00:00'""",
)
def time_range(t: Tables) -> DataFrame:
    return filters.time_range(t.events, moment("2024-01-10"), moment("2024-01-11 12:00:00"), "ts").select("event_id", "ts")


def _samples(t: Tables) -> DataFrame:
    """Samples with a label map."""
    event = F.col("event_type")
    name = F.when(event == "click", "instance_model_cpu").when(event == "view", "old_instance_model_cpu").otherwise("node_cpu")
    labels = F.create_map(
        F.lit("endpoint"),
        F.when(F.col("user_id") % 5 == 0, "/health").otherwise("/predict"),
        F.lit("mode"),
        F.when(event == "error", "idle").otherwise("user"),
        F.lit("address"),
        F.concat("instance", F.lit(":9100")),
        F.lit("model_id"),
        F.col("model_id"),
    )
    return t.events.select("event_id", name.alias("name"), labels.alias("labels"))


@query("flt_label_match", "SELECT event_id, model_id FROM ev WHERE user_id % 5 <> 0 AND event_type = 'error'")
def label_match(t: Tables) -> DataFrame:
    matched = filters.label_match(_samples(t), {"endpoint": "/predict", "mode": "idle"})
    return matched.select("event_id", F.col("labels")["model_id"].alias("model_id"))


@query("flt_name_regex", "SELECT event_id, 'instance_model_cpu' AS name FROM ev WHERE event_type = 'click'")
def name_regex(t: Tables) -> DataFrame:
    return filters.name_regex(_samples(t), "instance_model_.*").select("event_id", "name")


@query(
    "map_relabel",
    """
    SELECT event_id, instance, 'model-runner' AS service, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'idle-or-user' END AS mode2,
           5 + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 2 END AS n_labels
    FROM ev""",
)
def relabel(t: Tables) -> DataFrame:
    """Instance from the address, a constant service label, and a label that depends on two others."""
    out = filters.relabel(_samples(t), ["address"], "instance", "$1", r"(.*):\d+")
    out = filters.relabel(out, ["address"], "service", "model-runner")
    out = filters.relabel(out, ["endpoint", "mode"], "mode2", "idle-or-user", "/predict;(idle|user)")
    label = F.col("labels")
    return out.select(
        "event_id",
        label["instance"].alias("instance"),
        label["service"].alias("service"),
        label["mode2"].alias("mode2"),
        F.size("labels").alias("n_labels"),
    )


@query("val_message_schema", "SELECT event_id, event_id % 11 > 3 AS valid FROM ev")
def message_schema(t: Tables) -> DataFrame:
    return check_messages(messages(t)).select("event_id", "valid")


@query(
    "val_required_columns",
    """
    SELECT metric_name, count(*) AS n_rows, 0::BIGINT AS n_bad_time, count(*) - count(value) AS n_null,
           count(*) FILTER (value > CASE WHEN metric_name = 'requests_total' THEN 1000000 ELSE 100 END) AS n_out_of_range,
           0::INTEGER AS n_problems
    FROM gaps GROUP BY metric_name""",
)
def required_columns(t: Tables) -> DataFrame:
    problems = filters.check_columns(t.gaps, {"timestamp": "time", "metric_name": "text", "value": "number", "model_id": "text"})
    return filters.quality_report(t.gaps).withColumn("n_problems", F.lit(len(problems)))


@query(
    "val_clip_range",
    f"""
    SELECT event_id, metric_name,
           {r6("CASE WHEN metric_name = 'requests_total' THEN least(value, 1000000) ELSE least(value, 100) END")} AS value,
           coalesce(value > CASE WHEN metric_name = 'requests_total' THEN 1000000 ELSE 100 END, false) AS clipped
    FROM gaps WHERE value IS NOT NULL
    UNION ALL SELECT event_id, metric_name, NULL, false FROM gaps WHERE value IS NULL""",
)
def clip_range(t: Tables) -> DataFrame:
    return filters.clip_to_range(t.gaps).select("event_id", "metric_name", "value", "clipped")


@query(
    "val_constraints",
    """
    SELECT model_id, CASE number WHEN 1 THEN 'Missing required constraints' WHEN 2 THEN 'Constraint must be positive'
                                 WHEN 3 THEN 'Weight must be between 0 and 1' WHEN 4 THEN 'Weights must sum to 1' END AS reason
    FROM registry""",
)
def constraints(t: Tables) -> DataFrame:
    number = F.col("number")
    rows = t.registry.select(
        "model_id",
        F.when(number != 1, F.lit(400.0)).alias("max_cpu"),
        F.when(number == 2, F.lit(0.0)).otherwise(F.lit(100.0)).alias("max_memory"),
        F.lit(100.0).alias("max_network"),
        F.lit(8.0).alias("max_latency"),
        F.when(number == 3, F.lit(1.4)).when(number == 4, F.lit(0.5)).otherwise(F.lit(0.4)).alias("w_cpu"),
        F.when(number == 3, F.lit(-0.7)).otherwise(F.lit(0.3)).alias("w_memory"),
        F.lit(0.3).alias("w_network"),
    )
    return filters.check_constraints(rows).select("model_id", "reason")


@query(
    "prj_alert_view",
    f"""
    SELECT CASE WHEN event_id % 3 = 0 THEN 'Unknown Alert' ELSE 'Latency' END AS name, 'latency' AS type,
           CASE WHEN value / 50.0 > 5 THEN 'CRITICAL' ELSE 'WARNING' END AS level, '' AS message,
           {r6('value / 50.0')} AS value, 0.0::DOUBLE AS threshold, event_id % 2 = 0 AS active, model_id,
           {seconds('ts')} AS since
    FROM ev WHERE value / 50.0 > 1""",
)
def alert_view(t: Tables) -> DataFrame:
    found = alerts.latency_alerts(t.logs, ["event_id", "model_id", "timestamp"])
    even = F.col("event_id") % 2 == 0
    sparse = found.select(
        F.when(F.col("event_id") % 3 != 0, "Latency").alias("name"),
        "type",
        "level",
        "value",
        F.when(even, F.lit(True)).alias("active"),
        "model_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("since"),
    )
    return alerts.alert_view(sparse)


@query(
    "fn_to_epoch",
    f"""
    SELECT event_id, {r6('''CASE event_id % 6 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE
        WHEN 3 THEN epoch_us(ts) / 1e6 - 7200 ELSE epoch_us(ts) / 1e6 END''')} AS epoch FROM ev""",
)
def to_epoch(t: Tables) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 6
    spelled = (
        F.when(kind == 0, None)
        .when(kind == 1, "last tuesday")
        .when(kind == 2, F.concat(iso, F.lit("Z")))
        .when(kind == 3, F.concat(iso, F.lit("+02:00")))
        .when(kind == 4, (F.unix_micros("ts") / 1e6).cast("string"))
        .otherwise(iso)
    )
    return t.events.select("event_id", fn.to_epoch(spelled).alias("epoch"))


@query(
    "fn_to_iso_utc",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
           CASE WHEN event_id % 2 = 0 OR epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS iso
    FROM ev""",
)
def to_iso_utc(t: Tables) -> DataFrame:
    epoch = F.when(F.col("event_id") % 2 == 0, F.unix_seconds("ts").cast("double")).otherwise(F.unix_micros("ts") / 1e6)
    return t.events.select("event_id", fn.to_iso_utc(epoch).alias("iso"))


@query(
    "fn_to_utc",
    f"""
    SELECT event_id, {text('CASE event_id % 3 WHEN 1 THEN ts - INTERVAL 5 HOURS WHEN 2 THEN ts + INTERVAL 210 MINUTES ELSE ts END')} AS ts
    FROM ev""",
)
def to_utc(t: Tables) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 3
    zone = F.when(kind == 1, "+05:00").when(kind == 2, "-03:30").otherwise("")
    return t.events.select("event_id", fn.to_utc(F.concat(iso, zone)).alias("ts"))


@query(
    "fn_format_bytes",
    """
    WITH s AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN value * 37 * pow(1024.0::DOUBLE, event_id % 6) END AS b FROM ev)
    SELECT event_id, CASE WHEN b IS NULL THEN 'N/A' WHEN b < 1024 THEN printf('%.2f B', b)
        WHEN b / 1024.0 < 1024 THEN printf('%.2f KB', b / 1024.0)
        WHEN b / 1048576.0 < 1024 THEN printf('%.2f MB', b / 1048576.0)
        WHEN b / 1073741824.0 < 1024 THEN printf('%.2f GB', b / 1073741824.0)
        WHEN b / 1099511627776.0 < 1024 THEN printf('%.2f TB', b / 1099511627776.0)
        ELSE printf('%.2f PB', b / 1125899906842624.0) END AS size
    FROM s""",
)
def format_bytes(t: Tables) -> DataFrame:
    size = F.when(F.col("event_id") % 17 != 0, F.col("value") * 37 * F.pow(F.lit(1024.0), F.col("event_id") % 6))
    return t.events.select("event_id", fn.format_bytes(size).alias("size"))


@query(
    "fn_format_duration",
    """
    SELECT event_id, CASE WHEN s IS NULL THEN 'N/A' WHEN s < 60 THEN printf('%.1fs', s)
        WHEN s < 3600 THEN (floor(s)::BIGINT // 60) || 'm ' || (floor(s)::BIGINT % 60) || 's'
        ELSE (floor(s)::BIGINT // 3600) || 'h ' || (floor(s)::BIGINT % 3600 // 60) || 'm' END AS duration
    FROM (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN value * value / 3 END AS s FROM ev)""",
)
def format_duration(t: Tables) -> DataFrame:
    seconds = F.when(F.col("event_id") % 17 != 0, F.col("value") * F.col("value") / 3)
    return t.events.select("event_id", fn.format_duration(seconds).alias("duration"))


@query(
    "fn_time_features",
    """
    SELECT event_id, extract(hour FROM ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week,
           (isodow(ts) >= 6)::INTEGER AS is_weekend, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day,
           weekofyear(ts)::INTEGER AS week_of_year
    FROM ev""",
)
def time_features(t: Tables) -> DataFrame:
    return t.events.select("event_id", *[c.alias(n) for n, c in fn.time_features(F.col("ts")).items()])


@query(
    "fn_derive_resource_metrics",
    f"""
    WITH w AS (SELECT model_id, timestamp, avg(value) FILTER (metric_name = 'requests_total') AS rq,
                      avg(value) FILTER (metric_name = 'latency_avg') AS la, avg(value) FILTER (metric_name = 'latency_p95') AS l95,
                      avg(value) FILTER (metric_name = 'latency_p99') AS l99,
                      avg(value) FILTER (metric_name = 'cpu_usage_real' AND model_id < 'm4') AS cpu
               FROM metrics GROUP BY ALL),
         p AS (SELECT *, max(rq) OVER (PARTITION BY model_id) AS top, count(cpu) OVER (PARTITION BY model_id) AS has FROM w)
    SELECT model_id, {text('timestamp')} AS timestamp,
           {r6('CASE WHEN has > 0 THEN cpu WHEN top > 0 THEN CASE WHEN rq IS NOT NULL THEN least(greatest(rq / top * 0.8 * 100, 0), 100) END ELSE 10 END')} AS cpu_usage,
           {r6('CASE WHEN la IS NOT NULL THEN least(greatest(la * 10, 0.1), 100) END')} AS memory_usage,
           {r6('CASE WHEN l95 IS NOT NULL THEN least(greatest(l95 * 10, 0.1), 100) END')} AS network_io, {r6('l99')} AS latency
    FROM p""",
)
def derive_resource_metrics(t: Tables) -> DataFrame:
    """Models m0 to m3 report a host CPU, the others take theirs from the request count."""
    reported = (F.col("metric_name") != "cpu_usage_real") | (F.col("model_id") < "m4")
    rows = t.metrics.withColumn("value", F.when(reported, F.col("value")))
    wide = pivot_metrics(rows, [*BASIC_METRICS, "cpu_usage_real"]).withColumns(
        {"memory_usage_real": F.lit(None).cast("double"), "network_io_real": F.lit(None).cast("double")}
    )
    return sizing.derive_resource_metrics(wide).select("model_id", "timestamp", "cpu_usage", "memory_usage", "network_io", "latency")


@query(
    "fn_feature_vector",
    f"""
    SELECT event_id, event_id % 10 <> 0 AS complete, {r6('CASE WHEN event_id % 10 <> 0 THEN value END')} AS x0,
           {r6('CASE WHEN event_id % 10 <> 0 THEN user_id::DOUBLE END')} AS x1
    FROM ev""",
)
def feature_vector(t: Tables) -> DataFrame:
    full = F.create_map(F.lit("user"), F.col("user_id").cast("double"), F.lit("value"), F.col("value"))
    part = F.create_map(F.lit("value"), F.col("value"))
    features = F.when(F.col("event_id") % 10 != 0, full).otherwise(part)
    rows = t.events.withColumn("v", fn.feature_vector(features, ["value", "user"]))
    return rows.select("event_id", F.col("v").isNotNull().alias("complete"), F.col("v")[0].alias("x0"), F.col("v")[1].alias("x1"))


@query(
    "fn_utilization",
    f"""
    SELECT event_id, {r6('CASE WHEN user_id % 4 > 0 THEN value / (user_id % 4)::DOUBLE * 100 ELSE 0 END')} AS utilization FROM ev""",
)
def utilization(t: Tables) -> DataFrame:
    used = fn.utilization(F.col("value"), (F.col("user_id") % 4).cast("double"))
    return t.events.select("event_id", used.alias("utilization"))
