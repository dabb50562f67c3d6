"""Raw times: filling by chunks equals the plain window, ranges by time block equal those of one block."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import clean, tsexpr
from tests.conftest import rows


@pytest.fixture(scope="module")
def gaps(spark):
    rng = random.Random(8)
    data = []
    for model in ("a", "b", "c", "d"):
        times = sorted(rng.sample(range(4000), 90))
        for s in times:
            data.append((model, s, rng.random() if rng.random() < 0.3 and model != "d" else None, rng.random() if rng.random() < 0.8 else None))
    data.append(("e", 5, 1.0, None))
    return spark.createDataFrame(data, "model_id STRING, s INT, x DOUBLE, y DOUBLE").withColumn("timestamp", F.timestamp_seconds("s")).cache()


@pytest.mark.parametrize("seconds", [7, 60, 900, 10_000])
@pytest.mark.parametrize("by_time", [True, False])
def test_interpolation_by_chunks(gaps, seconds, by_time):
    want = rows(clean.interpolate(gaps, ["x", "y"], by_time=by_time))
    assert rows(clean.interpolate(gaps, ["x", "y"], by_time=by_time, regular=False, seconds=seconds)) == want


@pytest.mark.parametrize("seconds", [7, 60, 900, 10_000])
def test_filling_by_chunks(gaps, seconds):
    want = rows(clean.fill_gaps(gaps, ["model_id"], columns=["x", "y"]))
    assert rows(clean.fill_gaps(gaps, ["model_id"], columns=["x", "y"], regular=False, seconds=seconds)) == want


def test_filling_by_chunks_of_rows_without_time_or_model(spark):
    data = [("a", None, None), ("a", 3, 2.0), ("a", 900, None), (None, 1, None), (None, 700, 5.0)]
    df = spark.createDataFrame(data, "model_id STRING, s INT, value DOUBLE").withColumn("timestamp", F.timestamp_seconds("s"))
    got = clean.fill_gaps(df, ["model_id"], regular=False, seconds=10)
    assert rows(got, "model_id", "s", "value") == [("a", 3, 2.0), ("a", 900, 2.0), ("a", None, 2.0), ("unknown", 1, 5.0), ("unknown", 700, 5.0)]
    assert got.where("false").count() == 0


@pytest.fixture(scope="module")
def counters(spark):
    rng = random.Random(3)
    data, total = [], 0.0
    for i in range(400):
        total = 0.0 if rng.random() < 0.02 else total + rng.random()
        data.append(("a" if rng.random() < 0.9 else "b", rng.randrange(20_000), i, total))
    df = spark.createDataFrame(data, "model_id STRING, s INT, id BIGINT, value DOUBLE")
    return df.withColumn("ts", F.timestamp_seconds("s")).cache()


def rounded(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows(df)]


@pytest.mark.parametrize("block", [1, 300, 700, 3600])
def test_growth_by_time_block(counters, block):
    for keys in (["model_id"], []):
        want = rounded(tsexpr.growth(counters, keys, range_seconds=300, step=15, latest=True, block_seconds=10**6))
        assert rounded(tsexpr.growth(counters, keys, range_seconds=300, step=15, latest=True, block_seconds=block)) == want


@pytest.mark.parametrize("block", [1, 300, 700, 3600])
def test_instant_by_time_block(counters, block):
    want = rows(tsexpr.instant(counters, ["model_id"], 300, 15, block_seconds=10**6))
    got = rows(tsexpr.instant(counters, ["model_id"], 300, 15, block_seconds=block))
    assert got == want and len({r[:2] for r in got}) == len(got)


def test_one_series_keeps_many_tasks_busy(spark, counters):
    one = counters.where("model_id = 'a'")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        grown = tsexpr.growth(one, ["model_id"], range_seconds=300, step=15, block_seconds=600)
        assert grown.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
