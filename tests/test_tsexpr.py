from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import tsexpr
from tests.conftest import rows


def samples(spark, data):
    """(series, seconds, value) rows; the id is the position."""
    numbered = [(k, float(s), i, float(v)) for i, (k, s, v) in enumerate(data)]
    df = spark.createDataFrame(numbered, "k STRING, s DOUBLE, id BIGINT, value DOUBLE")
    return df.withColumn("ts", F.timestamp_micros((F.col("s") * 1000000).cast("bigint"))).drop("s")


def seconds(df, *cols):
    return rows(df.withColumn("ts", F.unix_seconds("ts")), *cols)


def test_counter_delta_and_reset(spark):
    df = samples(spark, [("a", 0, 5), ("a", 10, 8), ("a", 20, 2), ("a", 500, 2), ("b", 5, 1)])
    got = {(r["k"], r["id"]): r["delta"] for r in tsexpr.counter_delta(df, ["k"]).collect()}
    assert got == {("a", 0): None, ("a", 1): 3.0, ("a", 2): 2.0, ("a", 3): 0.0, ("b", 4): None}


def test_rate_by_hand(spark):
    df = samples(spark, [("a", 1, 0), ("a", 31, 60), ("a", 61, 30)])
    got = seconds(tsexpr.rate(df, ["k"], 60, 30), "ts", "value")
    # [0, 60) holds 1 and 31; [30, 90) holds 31 and 61, where the counter restarted at 0.
    assert got == [(60, 2.0), (90, 1.0)]


def test_single_sample_has_no_rate(spark):
    df = samples(spark, [("a", 1, 0), ("b", 1, 0), ("b", 1, 4)])
    assert tsexpr.rate(df, ["k"], 60, 30).count() == 0
    assert seconds(tsexpr.increase(df, ["k"], 60, 30), "k", "ts", "value") == [("b", 30, 4.0), ("b", 60, 4.0)]


def test_range_must_fit_the_grid(spark):
    df = samples(spark, [("a", 1, 0)])
    with pytest.raises(ValueError):
        tsexpr.rate(df, ["k"], 50, 30)
    with pytest.raises(ValueError):
        tsexpr.instant(df, ["k"], 50, 30)


@pytest.mark.parametrize("seed,range_s,step", [(0, 60, 15), (1, 300, 15), (2, 45, 45), (3, 120, 30)])
def test_growth_equals_brute_force(spark, seed, range_s, step):
    rng = random.Random(seed)
    data = [(rng.choice("aab"), rng.randrange(0, 900), rng.randrange(0, 20)) for _ in range(150)]
    want = {}
    for key in "ab":
        mine = sorted((s, i, v) for i, (k, s, v) in enumerate(data) if k == key)
        for e in range(step, 900 + range_s + 1, step):
            inside = [x for x in mine if e - range_s <= x[0] < e]
            if inside:
                grown = sum(b[2] if b[2] < a[2] else b[2] - a[2] for a, b in zip(inside, inside[1:]))
                want[(key, e)] = (float(grown), len(inside), float(inside[-1][0] - inside[0][0]))
    got = tsexpr.growth(samples(spark, data), ["k"], ["value"], range_s, step)
    assert {(r["k"], r["eval"]): (r["value"], r["n"], r["elapsed"]) for r in got.collect()} == want


@pytest.mark.parametrize("lookback,step", [(60, 15), (30, 30)])
def test_instant_equals_brute_force(spark, lookback, step):
    rng = random.Random(7)
    data = [(rng.choice("ab"), rng.randrange(0, 600), rng.randrange(0, 99)) for _ in range(60)]
    want = {}
    for key in "ab":
        mine = sorted((s, i, v) for i, (k, s, v) in enumerate(data) if k == key)
        for e in range(step, 600 + lookback + 1, step):
            inside = [x for x in mine if e - lookback <= x[0] < e]
            if inside:
                want[(key, e)] = float(inside[-1][2])
    got = seconds(tsexpr.instant(samples(spark, data), ["k"], lookback, step), "k", "ts", "value")
    assert {(k, e): v for k, e, v in got} == want
    assert len(got) == len(want)


def test_latency_avg_of_two_columns(spark):
    df = samples(spark, [("a", 1, 0), ("a", 16, 0)]).withColumns({"total": F.col("id") * 6.0, "count": F.col("id") * 3.0})
    assert {v for _, v in seconds(tsexpr.latency_avg(df, ["k"], 30, 15), "ts", "value")} == {2.0}
    idle = df.withColumn("count", F.lit(1.0))
    assert tsexpr.latency_avg(idle, ["k"], 30, 15).count() == 0


def histogram(spark, counts, bounds=(0.1, 0.5, 1.0, float("inf"))):
    data = [("a", le, float(c)) for le, c in zip(bounds, counts)]
    return spark.createDataFrame(data, "k STRING, le DOUBLE, value DOUBLE")


@pytest.mark.parametrize(
    "q,counts,want",
    [
        (0.5, [10, 20, 20, 20], 0.1),
        (0.75, [10, 20, 20, 20], 0.3),
        (0.05, [10, 20, 20, 20], 0.01),
        (0.99, [0, 0, 0, 5], 1.0),
        (0.9, [0, 0, 10, 10], 0.95),
        (0.9, [0, 0, 0, 0], None),
    ],
)
def test_histogram_quantile(spark, q, counts, want):
    got = tsexpr.histogram_quantile(histogram(spark, counts), q, ["k"]).first()["value"]
    assert got == (pytest.approx(want) if want is not None else None)


def test_histogram_build_is_cumulative(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 0.1), ("a", 0.7), ("a", 20.0)], "k STRING, latency DOUBLE")
    got = tsexpr.histogram_build(df, ["k"], bounds=[0.1, 1.0, float("inf")])
    assert rows(got, "le", "n", "count") == [(0.1, 2, 4), (1.0, 3, 4), (float("inf"), 4, 4)]


def test_io_rate_skips_first_and_equal_times(spark):
    df = spark.createDataFrame(
        [("m", "i", 0, 0.0, 0.0), ("m", "i", 10, 50.0, 50.0), ("m", "i", 4000, 50.0, 449.0)],
        "model_id STRING, instance STRING, s BIGINT, read_bytes DOUBLE, write_bytes DOUBLE",
    ).withColumn("ts", F.timestamp_seconds("s"))
    assert seconds(tsexpr.io_rate(df), "ts", "value") == [(10, 10.0), (4000, 0.1)]


def test_cpu_memory_disk_network(spark):
    idle = samples(spark, [("x", 0, 0), ("x", 10, 5)]).withColumns({"instance": F.lit("i"), "cpu": F.lit("c")})
    assert {v for _, v in seconds(tsexpr.cpu_percent(idle, 15, 15), "ts", "value")} == {50.0}
    one = spark.createDataFrame([("i", 25.0)], "instance STRING, value DOUBLE").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    total = one.withColumn("value", F.lit(100.0))
    assert tsexpr.memory_percent(one, total).first()["value"] == 75.0
    assert tsexpr.memory_percent(one, one.withColumn("value", F.lit(0.0))).count() == 0
    mount = one.withColumn("mountpoint", F.lit("/"))
    assert tsexpr.disk_percent(mount, total.withColumn("mountpoint", F.lit("/"))).first()["value"] == 75.0
    net = idle.withColumns({"device": F.lit("d"), "received": F.col("value"), "sent": F.col("value") * 3})
    assert {v for _, v in seconds(tsexpr.network_bytes(net, [], 15, 15), "ts", "value")} == {2.0}


def test_running_stats(spark):
    df = spark.createDataFrame([("m", 0, 1, 2.0), ("m", 1, 2, 4.0), ("m", 9999, 3, 9.0)], "model_id STRING, s BIGINT, event_id BIGINT, latency DOUBLE")
    got = tsexpr.running_stats(df.withColumn("timestamp", F.timestamp_seconds("s")))
    assert rows(got, "event_id", "prediction_count", "avg_latency") == [(1, 1, 2.0), (2, 2, 3.0), (3, 3, 5.0)]
