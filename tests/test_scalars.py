from __future__ import annotations

import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import scalars as fn


def one(spark, value, kind, build):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [
        (None, 0.0),
        ("garbage", 0.0),
        ("12.5", 12.5),
        ("1970-01-01T00:01:00Z", 60.0),
        ("1970-01-01T00:01:00+00:00", 60.0),
        ("1970-01-01T02:01:00+02:00", 60.0),
        ("1970-01-01T00:01:00", 60.0),
        ("1970-01-01 00:01:00.25", 60.25),
    ],
)
def test_to_epoch(spark, text, want):
    assert one(spark, text, "STRING", fn.to_epoch) == want


@pytest.mark.parametrize("epoch", [0.0, 1704067207.179575, 1704067207.0, 1e9 + 0.5])
def test_to_iso_utc_is_python_isoformat(spark, epoch):
    assert one(spark, epoch, "DOUBLE", fn.to_iso_utc) == datetime.fromtimestamp(epoch, tz=timezone.utc).isoformat()


@pytest.mark.parametrize(
    "size,want",
    [(None, "N/A"), (0.0, "0.00 B"), (1023.99, "1023.99 B"), (1024.0, "1.00 KB"), (1536.0, "1.50 KB"), (2.0**50, "1.00 PB"), (2.0**60, "1024.00 PB")],
)
def test_format_bytes(spark, size, want):
    assert one(spark, size, "DOUBLE", fn.format_bytes) == want


@pytest.mark.parametrize("size", [0.125, 0.375, 1.005, 2.675, 1024 * 0.185])
def test_fixed_rounds_like_python(spark, size):
    assert one(spark, size, "DOUBLE", lambda c: fn.fixed(c, 2)) == f"{size:.2f}"


@pytest.mark.parametrize(
    "seconds,want", [(None, "N/A"), (12.34, "12.3s"), (59.9, "59.9s"), (60.0, "1m 0s"), (245.9, "4m 5s"), (3600.0, "1h 0m"), (7380.0, "2h 3m")]
)
def test_format_duration(spark, seconds, want):
    assert one(spark, seconds, "DOUBLE", fn.format_duration) == want


def test_time_features(spark):
    features = fn.time_features(F.timestamp_seconds(F.col("x")))
    sunday = int(datetime(2024, 1, 7, 13, tzinfo=timezone.utc).timestamp())
    row = spark.createDataFrame([(sunday,)], "x BIGINT").select(*[c.alias(n) for n, c in features.items()]).first()
    assert row.asDict() == {"hour": 13, "day_of_week": 6, "is_weekend": 1, "month": 1, "day": 7, "week_of_year": 1}


def test_utilization_is_zero_without_allocation(spark):
    df = spark.createDataFrame([(5.0, 10.0), (5.0, 0.0), (5.0, -1.0), (math.nan, 1.0), (math.inf, 1.0), (None, 1.0)], "d DOUBLE, a DOUBLE")
    got = [r[0] for r in df.select(fn.utilization(F.col("d"), F.col("a"))).collect()]
    assert got == [50.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_feature_vector_needs_every_name(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 2.0},), ({"a": 1.0},)], "f MAP<STRING, DOUBLE>")
    got = [r[0] for r in df.select(fn.feature_vector(F.col("f"), ["b", "a"])).collect()]
    assert got == [[2.0, 1.0], None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (0.5,), (9.0,)], "x DOUBLE")
    assert [r[0] for r in df.select(fn.clip(F.col("x"), 0.0, 1.0)).collect()] == [None, 0.0, 0.5, 1.0]


def test_moment_means_utc(spark):
    naive, aware = datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 14, tzinfo=timezone.utc)
    got = spark.range(1).select(F.unix_seconds(fn.moment(naive)), F.unix_seconds(fn.moment(aware)), F.unix_seconds(fn.moment("2024-01-01"))).first()
    assert tuple(got) == (1704110400, 1704117600, 1704067200)
