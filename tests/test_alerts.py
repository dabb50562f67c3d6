from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts
from fleetlens.plans.active_alerts import active_alerts
from tests.conftest import rows


def at(spark, data, schema):
    return spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_seconds("s"))


def test_latency_levels_are_strict(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 1.5), ("m", 5.0), ("m", 5.5), ("m", None)], "model_id STRING, latency DOUBLE")
    got = rows(alerts.latency_alerts(df, ["model_id"]), "level", "value", "threshold")
    assert got == [("CRITICAL", 5.5, 5.0), ("WARNING", 1.5, 1.0), ("WARNING", 5.0, 1.0)]
    text = alerts.latency_alerts(df, ["model_id"]).where("value = 5.5").first()["message"]
    assert text == "Model m latency (5.5s) exceeds critical threshold (5.0s)"


def test_error_rate_over_last_requests(spark):
    rng = random.Random(5)
    failed = [rng.random() < 0.06 for _ in range(260)]
    data = [("m", i * 7, i, "boom" if bad else None) for i, bad in enumerate(failed)]
    df = spark.createDataFrame(data, "model_id STRING, s BIGINT, event_id BIGINT, error STRING")
    got = alerts.error_rate_alerts(df.withColumn("timestamp", F.timestamp_seconds("s")), ["event_id"])
    want = {}
    for i in range(len(failed)):
        last = failed[max(0, i - 99) : i + 1]
        if sum(last) / len(last) > 0.05:
            want[i] = sum(last) / len(last)
    assert {r["event_id"]: r["value"] for r in got.collect()} == pytest.approx(want)


def test_resource_alerts_zero_one_or_two(spark):
    df = spark.createDataFrame([("m0", 10.0, 10.0), ("m1", 81.25, 10.0), ("m2", 90.0, 99.0)], "model_id STRING, cpu_percent DOUBLE, memory_percent DOUBLE")
    got = alerts.resource_alerts(df, ["model_id"])
    assert rows(got, "model_id", "type") == [("m1", "cpu_usage"), ("m2", "cpu_usage"), ("m2", "memory_usage")]
    assert got.where("model_id = 'm1'").first()["message"] == "Model m1 CPU usage (81.2%) exceeds threshold (80.0%)"


def test_accuracy_minimum_and_drop(spark):
    df = at(spark, [("m", 0, 0.95), ("m", 86400, 0.89), ("m", 2 * 86400, 0.88)], "model_id STRING, s BIGINT, accuracy DOUBLE")
    got = alerts.accuracy_alerts(df, ["model_id", "s"])
    assert rows(got, "s", "type") == [(86400, "accuracy"), (86400, "accuracy_drop"), (172800, "accuracy")]


def test_host_breach_once_per_model_on_the_host(spark):
    hosts = at(spark, [("h1", 0, 90.0, 10.0, 95.0), ("h2", 0, 10.0, 10.0, 10.0)], "instance STRING, s BIGINT, cpu_percent DOUBLE, memory_percent DOUBLE, disk_percent DOUBLE")
    models = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h2")], "model_id STRING, instance STRING")
    breaches = alerts.system_alerts(models, hosts)
    assert rows(breaches, "instance", "type", "n_models") == [("h1", "system_cpu_usage", 2), ("h1", "system_disk_usage", 2)]
    assert rows(alerts.for_models(breaches, models, ["b"]), "model_id", "type") == [("b", "system_cpu_usage"), ("b", "system_disk_usage")]
    got = rows(alerts.for_models(breaches, models), "model_id", "type")
    assert got == [("a", "system_cpu_usage"), ("a", "system_disk_usage"), ("b", "system_cpu_usage"), ("b", "system_disk_usage")]


def test_hold_fires_after_the_wait(spark):
    true_at = [0, 75, 90, 105, 120, 135, 150, 200]
    df = at(spark, [("a", s) for s in true_at], "k STRING, s BIGINT")
    got = alerts.hold(df, ["k"], 60).withColumn("since", F.unix_seconds("since"))
    state = {r["s"]: (r["since"], r["state"]) for r in got.collect()}
    assert state[0] == (0, "pending") and state[120] == (75, "pending")
    assert state[135] == (75, "firing") and state[150] == (75, "firing") and state[200] == (200, "pending")
    spans = alerts.intervals(alerts.hold(df, ["k"], 60), ["k"])
    found = {r["s"]: (r["f"], r["u"], r["evaluations"]) for r in spans.select(F.unix_seconds("since").alias("s"), F.unix_seconds("firing_from").alias("f"), F.unix_seconds("until").alias("u"), "evaluations").collect()}
    assert found == {0: (None, 0, 1), 75: (135, 150, 6), 200: (None, 200, 1)}


def test_gauge_conditions_bring_the_rule(spark):
    df = spark.createDataFrame([("cpu", 80.0), ("cpu", 75.0), ("other", 99.0)], "name STRING, value DOUBLE")
    got = alerts.gauge_conditions(df, {"cpu": ("High", "warning", 75.0, 300)})
    assert rows(got, "alertname", "severity", "hold", "value") == [("High", "warning", 300, 80.0)]


def test_render(spark):
    df = spark.createDataFrame([("ModelHighCPUUsage", "m1", "i2"), ("Unknown", "m1", None)], "alertname STRING, model_id STRING, instance STRING")
    got = [r["description"] for r in alerts.render(df).collect()]
    assert got == ["Model m1 (i2) CPU usage is above 75% for 5 minutes", None]


def test_groups_are_counted(spark):
    firing = [("A", "x", s) for s in range(0, 7215, 15)] + [("A", "y", s) for s in range(30, 7215, 15)]
    df = at(spark, firing, "alertname STRING, k STRING, s BIGINT")
    groups = alerts.group(alerts.mark_new(df, ["alertname", "k"]))
    counts = {r["s"]: (r["alerts"], r["new_alerts"]) for r in groups.withColumn("s", F.unix_seconds("ts")).collect()}
    assert counts[0] == (1, 1) and counts[15] == (1, 0) and counts[30] == (2, 1) and counts[45] == (2, 0)


def test_inhibit_only_equal_labels_and_time(spark):
    data = [("A", "critical", "m", 0), ("A", "warning", "m", 0), ("A", "warning", "m", 15), ("B", "warning", "m", 0)]
    df = at(spark, data, "alertname STRING, severity STRING, k STRING, s BIGINT")
    assert rows(alerts.inhibit(df), "alertname", "severity", "s") == [("A", "critical", 0), ("A", "warning", 15), ("B", "warning", 0)]


def test_unavailable_after_three_failures(spark):
    oks = [True, False, False, False, False, True, False]
    df = at(spark, [("m", i * 400, i, ok) for i, ok in enumerate(oks)], "model_id STRING, s BIGINT, id BIGINT, ok BOOLEAN")
    got = rows(alerts.service_health(df), "id", "failures", "status")
    assert [f for _, f, _ in got] == [0, 1, 2, 3, 4, 0, 1]
    assert [i for i, _, s in got if s == "unavailable"] == [3, 4]


def test_active_alerts(spark):
    snapshots = at(spark, [("a", "h", 0, 99.0, 1.0), ("a", "h", 7200, 81.0, 1.0), ("b", "h", 7200, 1.0, 1.0)], "model_id STRING, instance STRING, s BIGINT, cpu_percent DOUBLE, memory_percent DOUBLE")
    hosts = at(spark, [("h", 7200, 1.0, 90.0, 1.0), ("h", 0, 99.0, 99.0, 99.0)], "instance STRING, s BIGINT, cpu_percent DOUBLE, memory_percent DOUBLE, disk_percent DOUBLE")
    got = active_alerts(snapshots, hosts, F.timestamp_seconds(F.lit(7500)))
    assert rows(got, "name", "model_id", "value", "active", "since") == [
        ("Cpu Usage", "a", 81.0, True, "1970-01-01T02:00:00Z"),
        ("System Memory Usage", "a", 90.0, True, "1970-01-01T02:00:00Z"),
        ("System Memory Usage", "b", 90.0, True, "1970-01-01T02:00:00Z"),
    ]


def test_young_alerts_and_levels(spark):
    df = at(spark, [("INFO", 0), ("WARNING", 1000), ("WARNING", 1900)], "level STRING, s BIGINT")
    young = alerts.young_alerts(df, F.timestamp_seconds(F.lit(1900)), "ts")
    assert rows(alerts.level_counts(young)) == [("WARNING", 2)]


def test_alert_view_defaults(spark):
    df = spark.createDataFrame([("cpu", None)], "type STRING, level STRING")
    assert alerts.alert_view(df).first().asDict() == {
        "name": "Unknown Alert", "type": "cpu", "level": "INFO", "message": "", "value": 0.0, "threshold": 0.0,
        "active": False, "model_id": "", "since": "",
    }
