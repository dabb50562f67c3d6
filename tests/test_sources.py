from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.scalars import moment
from fleetlens.operators import filters, joins, logs, scoring
from fleetlens.sources import documents as docs
from fleetlens.sources import metrics as src
from fleetlens.sources import registry as reg
from tests.conftest import rows


def test_range_responses(spark, tmp_path):
    def doc(metric, labels, values):
        return {"status": "success", "metric_name": metric, "data": {"resultType": "matrix", "result": [{"metric": labels, "values": values}]}}

    body = [
        doc("requests_total", {"model_id": "m"}, [[1704067200, "45.6"], [1704067210, "bad"], [1704067220, "52.1"]]),
        doc("requests_total", {}, [[1704067200, "1"]]),
        doc("cpu_usage_real", {"instance": "i", "model_id": "x"}, [[1704067200.5, "7"]]),
        {"status": "error", "metric_name": "requests_total"},
    ]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(d) for d in body))
    got = src.flatten_range_responses(src.read_range_responses(spark, str(tmp_path)))
    assert rows(got, "metric_name", "model_id", "instance", "value") == [
        ("cpu_usage_real", "system", "i", 7.0),
        ("requests_total", "m", None, 45.6),
        ("requests_total", "m", None, 52.1),
        ("requests_total", "unknown", None, 1.0),
    ]


def test_messages_of_wrong_kind_are_rejected(spark):
    good = {"metric_name": "x", "value": 1.5, "timestamp": "t", "labels": {"model_id": "m"}}
    bodies = [
        good,
        good | {"value": 3},
        good | {"value": "3"},
        good | {"metric_name": 3},
        good | {"labels": "m"},
        good | {"timestamp": None},
        {k: v for k, v in good.items() if k != "labels"},
        good | {"labels": {"value": "text"}},
    ]
    df = spark.createDataFrame([(json.dumps(b),) for b in bodies] + [("{",), (None,)], "value STRING").withColumn("timestamp", F.current_timestamp())
    assert [r["valid"] for r in src.check_messages(df).collect()] == [True, True, False, False, False, False, False, True, False, False]
    got = src.parse_messages(df)
    assert rows(got, "metric_name", "value") == [("x", 1.5), ("x", 1.5), ("x", 3.0)]
    assert got.first()["labels"] == {"model_id": "m"}


def test_registry_and_port_files(spark, tmp_path):
    (tmp_path / "registry.json").write_text(json.dumps({"m1": {"port": 8001, "status": "healthy", "features": ["a", "b"]}}))
    (tmp_path / "m1.port").write_text("9999")
    (tmp_path / "m2.port").write_text("8002\n")
    (tmp_path / "m3.port").write_text("none")
    registry = reg.read_registry(spark, str(tmp_path / "registry.json"))
    got = reg.with_port_files(registry, reg.read_port_files(spark, str(tmp_path)))
    assert rows(got, "model_id", "port", "status") == [("m1", 8001, "healthy"), ("m2", 8002, "unknown")]


def test_thresholds_overlay(spark):
    own = spark.createDataFrame([("resource_rules", "cpu_threshold", 50.0), ("mine", "x", 1.0)], "category STRING, key STRING, value DOUBLE")
    got = {(r["category"], r["key"]): r["value"] for r in reg.overlay_thresholds(reg.default_thresholds(spark), own).collect()}
    assert got[("resource_rules", "cpu_threshold")] == 50.0 and got[("mine", "x")] == 1.0
    assert got[("latency_rules", "critical")] == 5.0 and len(got) == 16


def test_stack(spark):
    a = spark.createDataFrame([("x", 1.0)], "metric_name STRING, value DOUBLE")
    b = spark.createDataFrame([("y", "i", 2.0)], "metric_name STRING, instance STRING, value DOUBLE")
    assert rows(src.stack_frames([a, b]), "metric_name", "instance", "value") == [("x", None, 1.0), ("y", "i", 2.0)]
    with pytest.raises(ValueError):
        src.stack_frames([])


def test_document_store(spark, tmp_path):
    data = [("a", 0, 1.0), ("a", 100, 2.0), ("b", 50, 3.0)]
    df = spark.createDataFrame(data, "model_id STRING, s BIGINT, cpu DOUBLE").withColumn("timestamp", F.timestamp_seconds(F.col("s") + 1704067200)).drop("s")
    path = str(tmp_path / "store")
    docs.store_documents(df, path, 300)
    store = docs.read_store(spark, path)
    assert rows(store, "key") == [("prediction:20240101000000",), ("prediction:20240101000050",), ("prediction:20240101000140",)]
    now = moment("2024-01-01 00:05:30")
    assert rows(docs.latest_document(store, now), "model_id", "cpu") == [("a", 2.0), ("b", 3.0)]
    assert [r["cpu"] for r in docs.document_history(store, now, 1).collect()] == [2.0]
    assert docs.unexpired(store, moment("2024-01-02")).count() == 0


def test_documents_format_and_check(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z", 1), (None, 1), ("soon", 1), (None, None)], "timestamp STRING, predictions INT")
    assert [r["reason"] for r in docs.check_documents(df).collect()] == [None, "Missing timestamp", "Invalid timestamp format", "Empty data"]
    raw = spark.createDataFrame(
        [("2024-01-01T00:00:00Z", [("2024-01-01T05:00:00.25+05:00", 1.0), ("later", 2.0), ("2024-01-02", 3.0)], {"n": 3}, (None, 5.0, None))],
        "timestamp STRING, predictions ARRAY<STRUCT<timestamp: STRING, cpu: DOUBLE>>, metrics MAP<STRING, INT>, utilization STRUCT<cpu: DOUBLE, memory: DOUBLE, network: DOUBLE>",
    )
    got = docs.format_documents(raw).first()
    assert got["timestamp"] == "2024-01-01 00:00:00+00:00"
    assert [p["timestamp"] for p in got["predictions"]] == ["2024-01-01 05:00:00.250000+05:00", "later", "2024-01-02 00:00:00"]
    assert got["metrics"] == {"n": 3.0} and tuple(got["utilization"]) == (0.0, 5.0, 0.0)


def test_json_and_csv_export(spark):
    forecast = spark.createDataFrame([("a", 300, 2.0), ("a", 0, 1.0)], "model_id STRING, s BIGINT, cpu DOUBLE").withColumn("timestamp", F.timestamp_seconds("s"))
    alloc = spark.createDataFrame([("a", 9.0, "optimal", "Optimal", 1.5)], "model_id STRING, cpu_allocation DOUBLE, status STRING, solver_status STRING, objective_value DOUBLE")
    doc = json.loads(docs.forecast_documents(forecast, ["cpu"], alloc).first()["value"])
    assert doc["predictions"] == {"timestamp": ["1970-01-01T00:00:00", "1970-01-01T00:05:00"], "cpu": [1.0, 2.0]}
    assert doc["optimization"]["cpu_allocation"] == 9.0 and doc["metadata"]["version"] == "1.0.0"
    flat = docs.flat_forecast(forecast, alloc)
    assert [c for c in flat.columns if c.startswith("opt_")] == ["opt_cpu_allocation", "opt_objective_value"]


def test_log_payload(spark):
    df = spark.createDataFrame([("m", 1.5, None)], "model_id STRING, latency DOUBLE, error STRING")
    row = docs.log_payload(df).first()
    assert row["key"] == "m" and json.loads(row["value"]) == {"model_id": "m", "latency": 1.5}


def test_time_range(spark):
    df = spark.createDataFrame([(0,), (10,), (20,)], "s BIGINT").withColumn("timestamp", F.timestamp_seconds("s"))
    kept = filters.time_range(df, datetime(1970, 1, 1, 0, 0, 10), datetime(1970, 1, 1, 0, 0, 20))
    assert rows(kept, "s") == [(10,), (20,)]
    assert rows(filters.lookback(df, "1970-01-01 00:01:10", 1), "s") == [(10,), (20,)]
    with pytest.raises(ValueError):
        filters.time_range(df, datetime(2024, 1, 2), datetime(2024, 1, 2))


def test_relabel(spark):
    df = spark.createDataFrame([({"a": "x:1", "b": "y"},)], "labels MAP<STRING, STRING>")

    def labels(out):
        return out.first()["labels"]

    assert labels(filters.relabel(df, ["a"], "host", "$1", r"(.*):\d+"))["host"] == "x"
    assert labels(filters.relabel(df, ["a", "b"], "a", "z"))["a"] == "z"
    assert "host" not in labels(filters.relabel(df, ["b"], "host", "$1", r"(.*):\d+"))
    assert "b" not in labels(filters.relabel(df, ["a"], "b", ""))


def test_checks(spark):
    df = spark.createDataFrame([("x",)], "value STRING")
    assert filters.check_columns(df, {"value": "number", "timestamp": "time"}) == ["missing column timestamp", "column value must be numeric"]
    assert filters.check_any(df, [{"cpu": "number", "memory": "number"}, {"value": "text"}]) == []
    assert filters.check_any(df, [{"cpu": "number", "memory": "number"}, {"cpu": "number"}]) == ["missing column cpu"]
    rows_ = [("requests_total", 5.0), ("latency_avg", 500.0), ("latency_avg", None), ("other", 1e9)]
    clipped = filters.clip_to_range(spark.createDataFrame(rows_, "metric_name STRING, value DOUBLE"))
    assert rows(clipped, "metric_name", "value", "clipped") == [
        ("latency_avg", 100.0, True),
        ("latency_avg", None, False),
        ("other", 1e9, False),
        ("requests_total", 5.0, False),
    ]


def test_log_normalize(spark):
    schema = "id INT, level STRING, error STRING, status_code INT, latency DOUBLE, message STRING, model_id STRING, timestamp TIMESTAMP"
    data = [
        (0, None, "boom", None, 2.5, None, "m", None),
        (1, None, None, 404, None, None, None, None),
        (2, None, None, 200, 1.0, None, "m", None),
        (3, None, None, None, 1.5, "own", "m", None),
        (4, "debug", "boom", 500, 0.1, None, "m", None),
    ]
    got = rows(logs.normalize(spark.createDataFrame(data, schema), moment("2024-01-01")), "id", "level", "message")
    assert got == [
        (0, "ERROR", "High latency prediction: 2.5s"),
        (1, "ERROR", "Prediction for model unknown"),
        (2, "INFO", "Prediction for model m"),
        (3, "WARNING", "own"),
        (4, "debug", "Error: boom"),
    ]


def log_table(spark):
    schema = "event_id BIGINT, s BIGINT, level STRING, model_id STRING, message STRING, context STRING"
    data = [(1, 10, "info", "a", "Hello World", None), (2, 20, "ERROR", "b", None, '{"k": "hello"}'), (3, 20, None, None, "x", "y")]
    return spark.createDataFrame(data, schema).withColumn("timestamp", F.timestamp_seconds("s"))


def test_log_search_and_page(spark):
    df = log_table(spark)
    assert rows(logs.search(df, level="INFO"), "event_id") == [(1,)]
    assert rows(logs.search(df, query="HELLO"), "event_id") == [(1,), (2,)]
    assert rows(logs.search(df, model_id="b", query="zzz"), "event_id") == []
    assert rows(logs.search(df, start="1970-01-01 00:00:11", end="1970-01-01 00:00:20"), "event_id") == [(2,), (3,)]
    page = logs.query(df, limit=2, offset=1)
    assert [r["event_id"] for r in page.collect()] == [2, 1]
    assert page.first()["timestamp"] == "1970-01-01T00:00:20+00:00"


def test_log_summary(spark):
    got = {(r["section"], r["key"]): r["n"] for r in logs.summary(log_table(spark)).collect()}
    assert got == {("total", "all"): 3, ("level", "INFO"): 1, ("level", "ERROR"): 1, ("level", "UNKNOWN"): 1, ("model", "a"): 1, ("model", "b"): 1, ("model", "unknown"): 1}


def test_log_without_time_is_oldest(spark):
    df = log_table(spark).withColumn("timestamp", F.when(F.col("event_id") != 3, F.col("timestamp")))
    assert rows(logs.search(df, end="1970-01-01 00:00:10"), "event_id") == [(1,), (3,)]
    assert rows(logs.search(df, start="1970-01-01 00:00:05"), "event_id") == [(1,), (2,)]
    assert [r["event_id"] for r in logs.query(df).collect()] == [2, 1, 3]


def test_coverage(spark):
    df = spark.createDataFrame([("x",), ("x",)], "metric_name STRING")
    assert rows(src.coverage(df, ["x", "y"])) == [("x", 2), ("y", 0)]


def test_latest_logs(spark):
    assert rows(logs.latest(log_table(spark), 2), "event_id", "level") == [(2, "ERROR"), (3, "INFO")]


def test_model_status(spark):
    models = spark.createDataFrame([("a", 8, 3, 0.0123456, None), ("b", 8, 0, 0.0, None)], "model_id STRING, feature_count INT, prediction_count BIGINT, avg_latency DOUBLE, last_prediction TIMESTAMP")
    processes = spark.createDataFrame([("a", True, True)], "model_id STRING, running BOOLEAN, healthy BOOLEAN")
    services = spark.createDataFrame([("a", "running", "u", 1), ("z", None, "v", 2)], "model_id STRING, service_status STRING, url STRING, port INT")
    got = {r["model_id"]: r for r in joins.model_status(models, processes, services).collect()}
    assert (got["a"]["status"], got["b"]["status"], got["z"]["status"]) == ("active", "inactive", "unknown")
    assert got["a"]["performance"]["avg_latency_ms"] == 12.35 and got["a"]["deployment"]["url"] == "u"
    assert got["b"]["performance"]["last_prediction"] == "Never" and not got["b"]["deployment"]["deployed"]
    assert got["z"]["deployment"]["deployed"] and got["z"]["deployment"]["url"] == "v"


def test_resource_report(spark):
    schema = "model_id STRING, status STRING, error STRING, cpu_percent DOUBLE, memory_bytes DOUBLE, memory_percent DOUBLE, read_bytes DOUBLE, write_bytes DOUBLE, uptime DOUBLE"
    data = [("a", None, None, 12.345, 2048.0, 3.0, 1024.0, 0.0, 75.0), ("b", "not_running", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("c", None, "gone", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("d", None, None, None, None, None, None, None, None)]
    got = rows(logs.resource_report(spark.createDataFrame(data, schema)))
    assert got[0] == ("a", "RUNNING", f"{12.345:.2f}%", "2.00 KB", "3.00%", "1.00 KB in / 0.00 B out", "1m 15s")
    assert got[1] == ("b", "STOPPED", *["N/A"] * 5) and got[2][1] == "ERROR"
    assert got[3] == ("d", "RUNNING", "0.00%", "N/A", "0.00%", "N/A", "N/A")


def test_batch_score(spark):
    models = spark.createDataFrame([("m", [1.0, 2.0], 0.5)], "model_id STRING, coefficients ARRAY<DOUBLE>, intercept DOUBLE")
    asked = spark.createDataFrame([("m", [1.0, 1.0]), ("m", [1.0]), ("m", None), ("x", [1.0, 1.0]), (None, [1.0])], "model_id STRING, features ARRAY<DOUBLE>")
    got = {(r["error"], r["status_code"]): r["prediction"] for r in scoring.batch_score(asked, models).collect()}
    assert got == {
        (None, 200): 3.5,
        ("Feature count mismatch", 500): None,
        ("Missing features in request", 400): None,
        ("Model not registered", 404): None,
        ("Missing model_id", 400): None,
    }


def test_linear_fit_recovers_a_plane(spark):
    data = [([float(i % 7), float(i % 5)], 2.0 * (i % 7) - 3.0 * (i % 5) + 1.0) for i in range(40)]
    model = scoring.linear_fit(spark.createDataFrame(data, "features ARRAY<DOUBLE>, label DOUBLE"))
    assert list(model.coefficients) == pytest.approx([2.0, -3.0]) and model.intercept == pytest.approx(1.0)
