from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import clean
from tests.conftest import rows


def wide(spark, values, key="a", step=60):
    """One series of values at a fixed step."""
    data = [(key, i * step, v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "model_id STRING, sec BIGINT, v DOUBLE").withColumn("timestamp", F.timestamp_seconds("sec"))


def column(df, name="v"):
    return [r[0] for r in df.orderBy("model_id", "timestamp").select(name).collect()]


GAPS = [None, None, 1.0, None, None, 4.0, 5.0, None, None]


def test_interpolate_linear_edges(spark):
    got = column(clean.interpolate(wide(spark, GAPS), ["v"]))
    assert got == [None, None, 1.0, 2.0, 3.0, 4.0, 5.0, 5.0, 5.0]
    assert got[2:] == pd.Series(GAPS, dtype=float).interpolate("linear").tolist()[2:]


def test_interpolate_by_time(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 10, None), ("a", 40, 4.0)], "model_id STRING, s BIGINT, v DOUBLE")
    df = df.withColumn("timestamp", F.timestamp_seconds("s"))
    assert column(clean.interpolate(df, ["v"], by_time=True)) == [0.0, 1.0, 4.0]
    assert column(clean.interpolate(df, ["v"])) == [0.0, 2.0, 4.0]


def test_interpolate_all_null_and_single(spark):
    assert column(clean.interpolate(wide(spark, [None, None]), ["v"])) == [None, None]
    assert column(clean.interpolate(wide(spark, [3.0]), ["v"])) == [3.0]


def test_fill_gaps_forward_then_backward(spark):
    got = column(clean.fill_gaps(wide(spark, GAPS), ["model_id"], "timestamp", ["v"]))
    assert got == [1.0, 1.0, 1.0, 1.0, 1.0, 4.0, 5.0, 5.0, 5.0]


def test_series_do_not_mix(spark):
    both = wide(spark, [None, 2.0]).unionByName(wide(spark, [7.0, None], key="b"))
    assert column(clean.fill_gaps(both, ["model_id"], "timestamp", ["v"])) == [2.0, 2.0, 7.0, 7.0]


@pytest.mark.parametrize("regular", [False, True])
def test_cap_outliers(spark, regular):
    values = [1.0] * 30 + [100.0]
    mean, std = np.mean(values), np.std(values, ddof=1)
    got = column(clean.cap_outliers(wide(spark, values), ["model_id"], ["v"], regular=regular))
    assert got[:30] == [1.0] * 30
    assert got[30] == pytest.approx(mean + 3 * std)
    assert column(clean.cap_outliers(wide(spark, [5.0]), ["model_id"], ["v"], regular=regular)) == [5.0]


@pytest.mark.parametrize("span", [1, 5, 32, 36, 288, 37])
def test_rolling_means_equal_pandas(spark, span):
    rng = random.Random(span)
    values = [None if rng.random() < 0.03 else rng.uniform(0, 100) for _ in range(400)]
    got = column(clean.rolling_means(wide(spark, values), ["v"], {"r": span}), "v_r")
    want = pd.Series(values, dtype=float).rolling(span).mean()
    assert [g is None for g in got] == want.isna().tolist()
    assert np.allclose([g for g in got if g is not None], want.dropna())


def test_lag_features_drop_incomplete_rows(spark):
    got = clean.lag_features(wide(spark, [1.0, 2.0, 3.0, 4.0]), ["v"], 2)
    assert rows(got, "v", "v_lag_1", "v_lag_2") == [(3.0, 2.0, 1.0), (4.0, 3.0, 2.0)]


@pytest.mark.parametrize("regular", [False, True])
def test_minmax_and_zscore(spark, regular):
    both = wide(spark, [0.0, 5.0, 10.0]).unionByName(wide(spark, [3.0, 3.0], key="b"))
    assert column(clean.minmax(both, ["v"], regular=regular), "v_normalized") == [0.0, 0.5, 1.0, 0.0, 0.0]
    z = column(clean.zscore(both, ["v"], regular=regular), "v_z")
    assert z == pytest.approx([-1.224744871391589, 0.0, 1.224744871391589, 0.0, 0.0])


LONG = "model_id STRING, metric_name STRING, sec BIGINT, value DOUBLE, instance STRING, arrival BIGINT"


def long(spark, data):
    return spark.createDataFrame(data, LONG).withColumn("timestamp", F.timestamp_seconds("sec")).drop("sec")


def test_pivot_zero_for_absent_metric_null_for_missing_point(spark):
    df = long(spark, [("a", "x", 0, 1.0, "i", 1), ("a", "x", 0, 3.0, "i", 2), ("a", "y", 60, 5.0, "i", 3), ("b", "x", 0, 7.0, "i", 4)])
    got = rows(clean.pivot_metrics(df, ["x", "y"]), "model_id", "x", "y")
    assert got == [("a", 2.0, None), ("a", None, 5.0), ("b", 7.0, 0.0)]


def test_dedupe(spark):
    df = long(spark, [("a", "x", 0, 9.0, "i", 5), ("a", "x", 0, 1.0, "i", 2), ("a", "x", 1, 4.0, None, 3)])
    assert rows(clean.dedupe_mean(df), "value") == [(4.0,), (5.0,)]
    assert rows(clean.dedupe_first(df, ["model_id", "metric_name", "timestamp"], "arrival"), "value", "arrival") == [(1.0, 2), (4.0, 3)]


def test_points_per_timestamp_of_each_model(spark):
    df = long(spark, [("a", "x", 0, 1.0, "i", 9), ("a", "x", 0, 5.0, "j", 2), ("b", "x", 0, None, "i", 1), ("a", "z", 60, 2.0, "i", 3)])
    got = rows(clean.points_per_timestamp(df, ["x", "z"], basic=["x"]), "model_id", "x", "z")
    assert got == [("a", 0.0, 2.0), ("a", 5.0, None), ("b", 0.0, None)]


def test_future_grid(spark):
    df = wide(spark, [1.0, 2.0])
    five = [r["timestamp"].timestamp() for r in clean.future_grid(df, horizon_minutes=12).orderBy("step").collect()]
    assert five == [60.0, 360.0]
    assert clean.future_grid(df, horizon_minutes=3).count() == 1
    one = [r["timestamp"].timestamp() for r in clean.future_grid(df, horizon_minutes=3, step_minutes=1, include_start=False).orderBy("step").collect()]
    assert one == [120.0, 180.0, 240.0]


def test_preprocess_equals_pandas(spark):
    rng = random.Random(0)
    values = [None if rng.random() < 0.1 else rng.uniform(0, 10) for _ in range(330)]
    values[100] = 500.0
    df = wide(spark, values, step=300).select("model_id", "timestamp", "v")
    got = clean.preprocess(df, ["v"]).orderBy("timestamp").toPandas()
    s = pd.Series(values, dtype=float).ffill().bfill()
    s = s.clip(s.mean() - 3 * s.std(), s.mean() + 3 * s.std())
    assert np.allclose(got["v"], s)
    for name, n in (("lag_1h", 12), ("lag_24h", 288)):
        r = s.rolling(n).mean()
        assert np.allclose(got[f"v_{name}"], r.fillna(0))
        assert np.allclose(got[f"v_{name}_normalized"], ((r - r.min()) / (r.max() - r.min())).fillna(0))
    assert got["hour"].tolist() == [(i * 300 // 3600) % 24 for i in range(330)]


def test_train_frame_clips(spark):
    df = long(spark, [("a", "latency_avg", 0, -5.0, "i", 1), ("a", "latency_avg", 60, 500.0, "i", 2)])
    got = rows(clean.train_frame(df, ["latency_avg"]), "latency_avg")
    assert got == [(0.0,), (100.0,)]


def test_long_frames_do_not_cost_a_window_to_the_end(spark):
    """No operator uses a frame that runs to the end of the series from each row."""
    plan = clean.fill_gaps(clean.interpolate(wide(spark, GAPS), ["v"]), ["model_id"], "timestamp", ["v"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in text
