"""Chunked helpers against plain pandas on small chunks and blocks."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetlens.functions.timeline import chunked, place, previous, rows_back, running, with_position


def samples(seed: int, n: int = 300) -> pd.DataFrame:
    """Three series; one holds most rows; times tie often."""
    rng = random.Random(seed)
    keys = rng.choices(["a", "b", "c"], weights=[8, 1, 1], k=n)
    return pd.DataFrame(
        {
            "k": keys,
            "sec": [rng.randrange(0, 120) for _ in range(n)],
            "id": rng.sample(range(10 * n), n),
            "v": [float(rng.randrange(0, 50)) for _ in range(n)],
        }
    )


def as_frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")


@pytest.mark.parametrize("seconds", [1, 7, 1000])
def test_running_equals_cumulative(spark, seconds):
    pdf = samples(1)
    want = pdf.sort_values(["k", "sec", "id"]).copy()
    g = want.groupby("k")["v"]
    want["total"], want["low"], want["high"] = g.cumsum(), g.cummin(), g.cummax()
    want["n"] = want.groupby("k").cumcount() + 1
    aggs = {"total": ("sum", F.col("v")), "low": ("min", F.col("v")), "high": ("max", F.col("v")), "n": ("count", F.lit(1))}
    got = running(as_frame(spark, pdf), ["k"], "ts", ["ts", "id"], aggs, seconds).toPandas()
    merged = want.merge(got, on=["k", "id"], suffixes=("", "_got"))
    assert len(merged) == len(pdf)
    for c in aggs:
        assert (merged[c] == merged[f"{c}_got"]).all()


@pytest.mark.parametrize("seconds", [1, 7, 1000])
def test_previous_equals_shift(spark, seconds):
    pdf = samples(2)
    want = pdf.sort_values(["k", "sec", "id"]).copy()
    want["p"] = want.groupby("k")["v"].shift(1)
    got = previous(as_frame(spark, pdf), ["k"], "ts", ["ts", "id"], ["v"], seconds).toPandas()
    merged = want.merge(got, on=["k", "id"])
    assert len(merged) == len(pdf)
    assert merged["p"].fillna(-1).tolist() == merged["prev_v"].fillna(-1).tolist()


def test_previous_keeps_nulls_apart_from_missing_rows(spark):
    df = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 2, 2, None), ("a", 400, 3, 7.0)], "k STRING, s INT, id BIGINT, v DOUBLE")
    df = df.withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: (r["prev_v"], r["prev_s"]) for r in previous(df, ["k"], "ts", ["ts", "id"], ["v", "s"]).collect()}
    assert got == {1: (None, None), 2: (5.0, 1), 3: (None, 2)}


@pytest.mark.parametrize("back,block", [(1, 1), (3, 4), (10, 10), (10, 64)])
def test_rows_back_equals_shift(spark, back, block):
    pdf = samples(3)
    want = pdf.sort_values(["k", "sec", "id"]).copy()
    want["p"] = want.groupby("k")["v"].shift(back)
    placed = with_position(as_frame(spark, pdf), ["k"], "ts", ["ts", "id"], "n")
    got = rows_back(placed, ["k"], "n", back, ["v"], block).toPandas()
    merged = want.merge(got, on=["k", "id"])
    assert len(merged) == len(pdf)
    assert merged["p"].fillna(-1).tolist() == merged["back_v"].fillna(-1).tolist()


def test_rows_back_needs_room():
    with pytest.raises(ValueError):
        rows_back(None, ["k"], "n", 11, ["v"], 10)


def test_chunked_frame_saves_shuffles(spark):
    """With the chunk column kept, the second helper finds its rows where the first left them."""

    def shuffles(df):
        counted = running(df, ["k"], "ts", ["ts", "id"], {"n": ("count", F.lit(1))})
        both = previous(counted, ["k"], "ts", ["ts", "id"], ["v", "n"])
        return both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    df = as_frame(spark, samples(4))
    assert shuffles(chunked(df, "ts")) < shuffles(df)


def test_place_orders_by_time_then_tie(spark):
    df = spark.createDataFrame([(1, 9, "x"), (2, 1, "y"), (2, 5, "z")], "s INT, id BIGINT, v STRING").withColumn("ts", F.timestamp_seconds("s"))
    got = df.agg(F.max_by("v", place("ts", "id")).alias("last"), F.min_by("v", place("ts", "id")).alias("first")).first()
    assert (got["last"], got["first"]) == ("z", "x")


def test_empty_input(spark):
    df = spark.createDataFrame([], "k STRING, ts TIMESTAMP, id BIGINT, v DOUBLE")
    assert running(df, ["k"], "ts", ["ts", "id"], {"n": ("count", F.lit(1))}).count() == 0
    assert previous(df, ["k"], "ts", ["ts", "id"], ["v"]).count() == 0
