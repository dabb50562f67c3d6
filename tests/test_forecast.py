from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import forecast
from fleetlens.plans.predict_and_size import predict_and_size
from fleetlens.session import fresh_folder, shared_folder
from tests.conftest import rows

START = 1704067200  # a Monday, midnight


def series(spark, value, days=14, step=300, key="a", metric="requests_total", noise=0.0):
    rng = random.Random(1)
    data = [
        (key, metric, START + s, value(s / 86400) + (rng.gauss(0, noise) if noise else 0.0)) for s in range(0, days * 86400, step)
    ]
    df = spark.createDataFrame(pd.DataFrame(data, columns=["model_id", "metric_name", "sec", "value"]))
    return df.withColumn("timestamp", F.timestamp_seconds("sec")).drop("sec")


def shape(day):
    return 50 + 3 * day + 10 * math.sin(2 * math.pi * day) + 4 * math.cos(2 * math.pi * day / 7)


def test_recovers_trend_and_seasons(spark):
    df = series(spark, shape)
    got = forecast.seasonal_predict(forecast.seasonal_fit(df), 24 * 60, 5, include_start=False).toPandas()
    assert len(got) == 288
    day = (got["timestamp"].astype("int64") / (1e9 if got["timestamp"].dt.unit == "ns" else 1e6) - START) / 86400
    want = np.array([shape(d) for d in day])
    assert np.max(np.abs(got["yhat"] - want)) < 0.05
    assert ((got["yhat_lower"] <= got["yhat"]) & (got["yhat"] <= got["yhat_upper"])).all()


def test_interval_covers_the_noise(spark):
    df = series(spark, lambda d: 20.0, noise=2.0)
    fit = forecast.seasonal_fit(df).first()
    assert fit["sigma"] == pytest.approx(2.0, rel=0.05)
    row = forecast.seasonal_predict(forecast.seasonal_fit(df)).first()
    assert row["yhat_upper"] - row["yhat"] == pytest.approx(1.96 * fit["sigma"])


def test_fit_equals_least_squares_on_rows(spark):
    """Sums per slot give the normal equations of the rows themselves."""
    df = series(spark, lambda d: 5 + d * d % 3, days=9, step=900)
    fit = forecast.seasonal_fit(df).first()
    pdf = df.toPandas()
    sec = pdf["timestamp"].astype("int64") // (10**9 if pdf["timestamp"].dt.unit == "ns" else 10**6)
    days = sec / 86400
    u = (days - fit["center"]) / fit["scale"]
    columns = [np.ones(len(u)), u]
    for period, order in ((86400, 4), (7 * 86400, 3)):
        for k in range(1, order + 1):
            columns += [np.sin(2 * math.pi * k * sec / period), np.cos(2 * math.pi * k * sec / period)]
    x = np.column_stack(columns)
    penalty = np.eye(x.shape[1]) * 1e-3
    penalty[0, 0] = 0
    want = np.linalg.solve(x.T @ x + penalty, x.T @ pdf["value"])
    assert np.allclose(fit["coefficients"], want, atol=1e-6)


def test_short_series_are_skipped(spark):
    both = series(spark, shape).unionByName(series(spark, shape, days=1, step=86400 // 7, key="b").limit(7))
    assert [r["model_id"] for r in forecast.seasonal_fit(both).collect()] == ["a"]


def test_postprocess_floor_and_order(spark):
    schema = "model_id STRING, metric_name STRING, yhat DOUBLE, yhat_lower DOUBLE, yhat_upper DOUBLE"
    df = spark.createDataFrame([("a", "latency_avg", -1.0, 2.0, -3.0), ("a", "other", -1.0, -2.0, 5.0)], schema)
    got = rows(forecast.postprocess(df), "metric_name", "yhat", "yhat_lower", "yhat_upper")
    assert got == [("latency_avg", 0.005, 0.005, 2.0), ("other", 0.0, 0.0, 5.0)]
    exp = forecast.postprocess(df, latency_exp=True).where("metric_name = 'latency_avg'").first()
    assert exp["yhat"] == pytest.approx(math.exp(-1))


def test_override_takes_last_host_value(spark):
    df = series(spark, lambda d: d, days=1, step=3600, metric="cpu_usage_real").unionByName(series(spark, lambda d: d, days=1, step=3600))
    got = forecast.override_latest(forecast.mean_forecast(df, 2), df)
    assert {(r["metric_name"], round(r["yhat"], 6)) for r in got.collect()} == {
        ("cpu_usage_real", round(23 / 24, 6)),
        ("requests_total", round(11.5 / 24, 6)),
    }


def test_flat_allocation(spark):
    df = series(spark, lambda d: 25.0, days=1, step=3600, metric="cpu_usage_real")
    row = forecast.flat_allocation(df).first()
    assert (row["cpu_allocation"], row["memory_allocation"], row["network_allocation"]) == (100.0, 1024.0, 1024.0)
    assert (row["utilization_cpu"], row["utilization_memory"], row["utilization_network"]) == (25.0, 0.0, 0.0)


def test_wide_forecast(spark):
    wide = forecast.to_wide(forecast.mean_forecast(series(spark, lambda d: 10.0, days=1), 3), ["requests_total", "latency_avg"])
    row = wide.first()
    assert wide.count() == 3 and (row["requests_total"], row["requests_total_lower"], row["latency_avg"]) == (10.0, 9.0, 0.0)


def test_forest_learns_hours_and_falls_back(spark):
    df = series(spark, lambda d: 100.0 if (d % 1) < 0.5 else 0.0, days=10, step=3600)
    few = series(spark, lambda d: 7.0, days=1, step=86400 // 5, key="b")
    got = forecast.forest_forecast(df.unionByName(few), ["requests_total"], 5).toPandas()
    assert len(got) == 10
    assert (got[got.model_id == "b"]["yhat"] == 7.0).all()
    assert (got[got.model_id == "a"]["yhat"] < 30).all()  # the last reading is at 23:00


def test_forest_recursive_follows_a_level(spark):
    shared_folder(spark)
    df = series(spark, lambda d: 40.0, days=2, step=3600).unionByName(series(spark, lambda d: 8.0, days=2, step=3600, key="b"))
    got = forecast.forest_recursive(df, ["requests_total"], horizon=4, checkpoint_every=2)
    found = got.groupBy("model_id").agg(F.count("*").alias("n"), F.avg("yhat").alias("y")).orderBy("model_id").collect()
    assert [(r["n"], round(r["y"])) for r in found] == [(4, 40), (4, 8)]


def test_forests_of_several_metrics(spark):
    """Metrics of different sizes and opposite shapes in one forest; wide, with a metric that isn't there."""
    shared_folder(spark)
    day = series(spark, lambda d: 1e6 if (d % 1) < 0.5 else 0.0, days=10, step=3600, metric="requests_total")
    night = series(spark, lambda d: 0.0 if (d % 1) < 0.5 else 2.0, days=10, step=3600, metric="latency_avg")
    both = day.unionByName(night)
    metrics = ["requests_total", "latency_avg", "latency_p95"]
    wide = forecast.to_wide(forecast.forest_forecast(both, metrics, 5), metrics).toPandas()
    assert len(wide) == 5 and (wide["requests_total"] < 4e5).all() and (wide["latency_avg"] > 1.2).all() and (wide["latency_p95_upper"] == 0).all()
    steps = forecast.to_wide(forecast.forest_recursive(both, metrics, 30, 60), metrics).orderBy("timestamp").toPandas()
    assert len(steps) == 30 and list(steps.columns) == ["model_id", "timestamp", *metrics]
    morning = steps["timestamp"].dt.hour.between(3, 9)
    assert (steps[morning]["requests_total"] > 7e5).all() and (steps[morning]["latency_avg"] < 0.6).all()
    assert steps["requests_total"].between(0, 1e6).all()


def test_forest_with_few_features_or_rows(spark):
    df = series(spark, lambda d: 100.0 if (d % 1) < 0.5 else 0.0, days=10, step=3600)
    got = forecast.forest_forecast(df, ["requests_total"], 5, features=["day"]).toPandas()
    assert (got["yhat"] < 30).all()
    few = df.limit(9)
    assert {r["yhat"] for r in forecast.forest_forecast(few, ["requests_total"], 2).collect()} == {few.agg(F.avg("value")).first()[0]}
    assert forecast.forest_recursive(few, ["requests_total"], 2).count() == 0


def test_store_loads_the_newest_fit(spark):
    path = fresh_folder(spark, "test-fits")
    forecast.save_fits(forecast.seasonal_fit(series(spark, lambda d: 1.0, days=3)), path, "2024-01-01")
    newest = forecast.seasonal_fit(series(spark, lambda d: 2.0, days=3))
    forecast.save_fits(newest, path, "2024-02-01")
    loaded = forecast.load_fits(spark, path)
    assert loaded.count() == 1
    assert loaded.first()["coefficients"] == pytest.approx(newest.first()["coefficients"])


def test_custom_model_and_scorer(spark):
    df = series(spark, lambda d: 3.0, days=1, step=3600)

    def predict(model, pdf):
        return pd.DataFrame({"model_id": [pdf["model_id"].iloc[0]], "y": [model[0]], "n": [model[1]]})

    got = forecast.series_model(df, lambda pdf: (pdf["value"].mean(), len(pdf)), predict, "model_id STRING, y DOUBLE, n BIGINT", 7200)
    assert rows(got) == [("a", 3.0, 12)]
    scored = forecast.score_rows(df.select("value"), lambda pdf: pd.DataFrame({"y": pdf["value"] * 2}), "y DOUBLE")
    assert {r["y"] for r in scored.collect()} == {6.0}


def test_predict_and_size(spark):
    metrics = None
    for name, level in (("requests_total", 500.0), ("latency_avg", 0.5), ("latency_p95", 0.6), ("latency_p99", 0.7), ("cpu_usage_real", 30.0)):
        part = series(spark, lambda d, v=level: v, days=1, step=900, metric=name)
        metrics = part if metrics is None else metrics.unionByName(part)
    limits = {"max_cpu": 100.0, "max_memory": 100.0, "max_network": 100.0, "max_latency": 1.0}
    row = predict_and_size(metrics, limits=limits).first()
    assert row["status"] == "optimal"
    assert row["cpu_allocation"] == pytest.approx(36.0)
    assert row["memory_allocation"] == pytest.approx(6.0, rel=1e-3)
    assert row["network_allocation"] == pytest.approx(7.2, rel=1e-3)


def hours_of(pdf):
    return pdf["timestamp"].astype("int64") // (10**9 if pdf["timestamp"].dt.unit == "ns" else 10**6)


def test_yearly_terms_equal_least_squares_on_rows(spark):
    """A series of more than a year; its fit are the normal equations of its rows, with forty-two terms."""
    df = series(spark, lambda d: 50 + d / 40 + 8 * math.sin(2 * math.pi * d / 365.25) + 3 * math.cos(2 * math.pi * d / 24), days=420, step=10_000, noise=0.1)
    for seasons in (forecast.SEASONS, forecast.SEASONS_24_DAYS):
        fit = forecast.seasonal_fit(df, seasons=seasons).first()
        pdf = df.toPandas()
        sec = hours_of(pdf)
        columns = [np.ones(len(sec)), (sec / 86400 - fit["center"]) / fit["scale"]]
        for period, order in seasons:
            for k in range(1, order + 1):
                angle = 2 * math.pi * k * (sec // 300 * 300) / period
                columns += [np.sin(angle), np.cos(angle)]
        x = np.column_stack(columns)
        penalty = np.eye(x.shape[1]) * 1e-3
        penalty[0, 0] = 0
        want = np.linalg.solve(x.T @ x + penalty, x.T @ pdf["value"])
        assert len(want) == len(fit["coefficients"]) and np.allclose(fit["coefficients"], want, atol=1e-5)
    assert fit["sigma"] == pytest.approx(0.1, rel=0.1)
    ahead = forecast.seasonal_predict(forecast.seasonal_fit(df, seasons=forecast.SEASONS_24_DAYS), 600, 60, seasons=forecast.SEASONS_24_DAYS).toPandas()
    day = (hours_of(ahead) - START) / 86400
    assert np.allclose(ahead["yhat"], 50 + day / 40 + 8 * np.sin(2 * np.pi * day / 365.25) + 3 * np.cos(2 * np.pi * day / 24), atol=0.3)


def test_yearly_terms_need_a_year(spark):
    df = series(spark, shape, days=20, step=3600)
    assert len(forecast.seasonal_fit(df).first()["coefficients"]) == 16
    assert len(forecast.seasonal_fit(df, whole_cycles=False).first()["coefficients"]) == 36
    gap = forecast.seasonal_fit(series(spark, shape, days=30, step=3600), seasons=forecast.SEASONS_24_DAYS).first()["coefficients"]
    assert len(gap) == 52 and gap[16:36] == [0.0] * 20 and any(gap[36:])


def test_multiplicative_seasons(spark):
    """Swings grow with the level; the fit is the two least squares problems over the rows."""
    df = series(spark, lambda d: (20 + 5 * d) * (1 + 0.5 * math.sin(2 * math.pi * d)), days=28, step=3600)
    fits = forecast.seasonal_fit(df, multiplicative=True)
    fit, pdf = fits.first(), df.toPandas()
    sec = hours_of(pdf)
    u, y = (sec / 86400 - fit["center"]) / fit["scale"], pdf["value"].to_numpy()
    line = np.column_stack([np.ones(len(u)), u])
    trend = np.linalg.solve(line.T @ line + np.diag([0, 1e-3]), line.T @ y)
    g = line @ trend
    waves = np.column_stack([f(2 * math.pi * k * sec / p) for p, order in ((86400, 4), (604800, 3)) for k in range(1, order + 1) for f in (np.sin, np.cos)])
    x = waves * g[:, None]
    seasonal = np.linalg.solve(x.T @ x + 1e-3 * np.eye(14), x.T @ (y - g))
    assert np.allclose(fit["coefficients"], np.concatenate([trend, seasonal]), atol=1e-6)
    back = forecast.fitted_values(df, fits).toPandas()
    assert fit["sigma"] == pytest.approx(math.sqrt(((back["value"] - back["yhat"]) ** 2).mean()), rel=1e-6)
    plain = forecast.seasonal_fit(df).first()
    assert fit["sigma"] < 0.2 * plain["sigma"]
