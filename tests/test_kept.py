"""Rows that must not get lost, and values that must not change on the way out."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fleetlens.catalog.registry import present
from fleetlens.functions.timeline import previous, running
from fleetlens.operators import alerts, clean, forecast
from fleetlens.plans.predict_and_size import predict_and_size
from tests.conftest import rows


def test_values_stay_what_they_are(spark):
    df = spark.createDataFrame([(1e13,), (5e15,), (float("inf"),), (float("nan"),), (None,), (0.1234565,), (-0.1234565,), (1e-9,)], "x DOUBLE")
    got = [r.x for r in present(df.coalesce(1)).collect()]
    assert got[:3] == [1e13, 5e15, math.inf] and math.isnan(got[3]) and got[4] is None
    assert got[5:] == [0.123457, -0.123457, 0.0]
    at = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00.123456' AS t")
    assert present(at).first().t == "2024-01-01 00:00:00.123456"


@pytest.fixture
def odd(spark):
    """A null model, a null time, and a plain row."""
    df = spark.createDataFrame([(None, 1, 0, 1.0), ("a", None, 1, 2.0), ("a", 5, 2, 3.0), ("a", 700, 3, 4.0)], "model_id STRING, s BIGINT, id BIGINT, v DOUBLE")
    return df.withColumn("ts", F.timestamp_seconds("s"))


def test_no_row_is_lost_in_a_timeline(odd):
    got = running(odd, ["model_id"], "ts", ["ts", "id"], {"total": ("sum", F.col("v"))})
    assert rows(got, "id", "model_id", "total") == [(0, "unknown", 1.0), (1, "a", 2.0), (2, "a", 5.0), (3, "a", 9.0)]
    got = previous(odd, ["model_id"], "ts", ["ts", "id"], ["v"])
    assert rows(got, "id", "prev_v") == [(0, None), (1, None), (2, 2.0), (3, 3.0)]


def test_no_row_is_lost_beside_its_statistics(odd):
    capped = clean.cap_outliers(odd, ["model_id"], ["v"])
    assert capped.count() == 4
    scaled = clean.minmax(odd, ["v"], ["model_id"])
    assert scaled.count() == 4 and clean.zscore(odd, ["v"], ["model_id"]).count() == 4


def test_short_series_are_sized(spark):
    data = [("long", "cpu_usage_real", 3600 * i, 50.0 + i) for i in range(48)] + [("short", "cpu_usage_real", 3600 * i, 40.0) for i in range(7)]
    df = spark.createDataFrame(data, "model_id STRING, metric_name STRING, s BIGINT, value DOUBLE")
    df = df.withColumn("timestamp", F.timestamp_seconds("s")).withColumn("instance", F.lit("i"))
    got = predict_and_size(df)
    assert rows(got, "model_id") == [("long",), ("short",)]
    fits = forecast.seasonal_fit(df)
    assert rows(predict_and_size(df, fits=fits), "model_id") == [("long",), ("short",)]


def test_user_rows_are_handed_on_as_they_are(spark):
    df = spark.createDataFrame([("m", "x", i, float(i)) for i in range(10)], "model_id STRING, metric_name STRING, s BIGINT, value DOUBLE")
    df = df.withColumn("timestamp", F.timestamp_seconds("s"))

    def count(model, pdf):  # noqa: ANN001, ANN202
        return pdf.iloc[:1][["model_id"]].assign(n=len(pdf))

    got = forecast.series_model(df, lambda pdf: None, count, "model_id STRING, n BIGINT")
    assert rows(got, "n") == [(10,)]


def test_rows_of_one_time_do_not_break_a_run(spark):
    df = spark.createDataFrame([("a", m, 15 * i) for i in range(4) for m in ("/data", "/var")], "k STRING, mount STRING, s BIGINT")
    held = alerts.hold(df.withColumn("ts", F.timestamp_seconds("s")), ["k"], 30)
    assert rows(held.select(F.unix_seconds("ts").alias("ts"), "state"), "ts", "state") == [
        (0, "pending"), (0, "pending"), (15, "pending"), (15, "pending"), (30, "firing"), (30, "firing"), (45, "firing"), (45, "firing"),
    ]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from fleetlens import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: ANN202, N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
