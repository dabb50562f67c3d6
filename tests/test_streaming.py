"""Streams cut into several micro-batches end in the state of their batch twins."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts, tsexpr
from fleetlens.session import ROCKSDB, fresh_folder
from fleetlens.sources.documents import latest_document, read_store
from fleetlens.sources.metrics import parse_messages
from fleetlens.streaming import jobs
from fleetlens.streaming.alert_state import hold_stream
from tests.conftest import rows


def sliced(spark, df, order, parts=3):
    """The frame as a stream of ``parts`` files, one per micro-batch, in the order of a column."""
    path = fresh_folder(spark, "test-stream") + "/in"
    pdf = df.orderBy(order).toPandas()
    size = -(-len(pdf) // parts)
    for i in range(parts):
        piece = spark.createDataFrame(pdf.iloc[i * size : (i + 1) * size], df.schema)
        piece.coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are read by modification time
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), path


def checks(spark, n=120):
    rng = random.Random(3)
    data = [(rng.choice("ab"), 60 * i, i, rng.random() < 0.5) for i in range(n)]
    return spark.createDataFrame(data, "model_id STRING, s BIGINT, id BIGINT, ok BOOLEAN").withColumn("ts", F.timestamp_seconds("s"))


def test_health_equals_batch(spark):
    df = checks(spark)
    stream, path = sliced(spark, df, "id", 4)
    jobs.health_stream(stream, path + "-out", path + "-ck").awaitTermination()
    out = spark.read.parquet(path + "-out/out")
    assert out.select("batch").distinct().count() == 4
    assert rows(out, "id", "failures", "status") == rows(alerts.service_health(df), "id", "failures", "status")


def test_counter_rate_equals_batch(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), 45 * i, i, float(rng.randrange(0, 30))) for i in range(100)]
    df = spark.createDataFrame(data, "model_id STRING, s BIGINT, id BIGINT, value DOUBLE").withColumn("ts", F.timestamp_seconds("s"))
    stream, path = sliced(spark, df, "id", 4)
    jobs.counter_stream(stream, path + "-out", path + "-ck").awaitTermination()
    got = spark.read.parquet(path + "-out/out")
    assert rows(got, "id", "delta") == rows(tsexpr.counter_delta(df, ["model_id"]), "id", "delta")
    assert got.where("rate IS NULL").count() == 2


def test_late_rows_are_set_aside(spark):
    data = [("a", 0, 1, 5.0), ("a", 60, 2, 8.0), ("a", 30, 3, 1.0), ("a", 90, 4, 9.0), ("b", 1, 5, 2.0), ("a", 120, 6, 9.5)]
    df = spark.createDataFrame(data, "model_id STRING, s BIGINT, id BIGINT, value DOUBLE").withColumn("ts", F.timestamp_seconds("s"))
    stream, path = sliced(spark, df, "id", 3)
    jobs.counter_stream(stream, path + "-out", path + "-ck").awaitTermination()
    assert rows(spark.read.parquet(path + "-out/late"), "id") == [(3,)]
    assert rows(spark.read.parquet(path + "-out/out"), "id", "delta") == [(1, None), (2, 3.0), (4, 1.0), (5, None), (6, 0.5)]
    assert rows(spark.read.parquet(path + "-out/state").select("batch").distinct(), "batch") == [(1,), (2,)]


def test_alert_state_equals_batch(spark):
    rng = random.Random(5)
    true_at = [(k, 900 + 15 * i) for k in "ab" for i in range(80) if rng.random() < 0.85]
    df = spark.createDataFrame(true_at, "series STRING, epoch BIGINT")
    stream, path = sliced(spark, df, "epoch", 3)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        jobs.append_to(hold_stream(stream, 60), path + "-out", path + "-ck").awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = spark.read.parquet(path + "-out")
    batch = alerts.hold(df.withColumn("ts", F.timestamp_seconds("epoch")), ["series"], 60)
    assert rows(got.where("state <> 'resolved'"), "series", "ts", "since", "state") == rows(batch, "series", "ts", "since", "state")
    fired = alerts.intervals(batch, ["series"]).where("firing_from IS NOT NULL").count()
    last = df.agg(F.max("epoch")).first()[0]
    ended = alerts.intervals(batch, ["series"]).where(F.col("firing_from").isNotNull() & (F.unix_seconds("until") + 15 <= last - 15))
    want = rows(ended.select("series", (F.unix_seconds("until") + 15).alias("ts")), "series", "ts")
    assert rows(got.where("state = 'resolved'").select("series", F.unix_seconds("ts").alias("ts")), "series", "ts") == want
    assert fired >= len(want) > 2


def test_sliding_equals_batch(spark):
    rng = random.Random(6)
    data = [(rng.choice("ab"), i, 7 * i, float(rng.randrange(1, 9))) for i in range(300)]
    df = spark.createDataFrame(data, "model_id STRING, event_id BIGINT, s BIGINT, latency DOUBLE").withColumn("timestamp", F.timestamp_seconds("s"))
    stream, path = sliced(spark, df, "event_id", 3)
    jobs.append_to(jobs.sliding_metrics(stream, ["model_id"]), path + "-out", path + "-ck").awaitTermination()
    closed = spark.read.parquet(path + "-out")
    got = closed.unionByName(jobs.open_ranges(df, closed, ["model_id"]))
    want = (
        df.groupBy("model_id", F.window("timestamp", "5 minutes", "15 seconds").alias("w"))
        .agg(F.count("*").alias("n"), F.avg("latency").alias("mean"))
        .select("model_id", F.col("w.end").alias("ts"), "n", "mean")
    )
    a, b = rows(got, "model_id", "ts", "n"), rows(want, "model_id", "ts", "n")
    assert a == b and len(a) > 100
    assert [r[3] for r in rows(got, "model_id", "ts", "n", "mean")] == pytest.approx([r[3] for r in rows(want, "model_id", "ts", "n", "mean")])


def test_dedupe_across_batches(spark):
    data = [(i, 1704067200 + 30 * i) for i in range(50)] * 2
    df = spark.createDataFrame(data, "event_id BIGINT, s BIGINT").withColumn("timestamp", F.timestamp_seconds("s"))
    stream, path = sliced(spark, df, "s", 3)
    jobs.append_to(jobs.dedupe(stream, ["event_id"]), path + "-out", path + "-ck").awaitTermination()
    assert rows(spark.read.parquet(path + "-out"), "event_id") == [(i,) for i in range(50)]


def test_ingest_continues_from_its_checkpoint(spark):
    schema = "event_id BIGINT, s BIGINT, model_id STRING, latency DOUBLE, error STRING, status_code INT, level STRING, message STRING"
    df = spark.createDataFrame([(i, i * 3600 * 13, "m", 0.5 + i, None, 200, None, None) for i in range(6)], schema).withColumn("timestamp", F.timestamp_seconds("s"))
    stream, path = sliced(spark, df, "s", 2)
    jobs.ingest_logs(stream, path + "-out", path + "-ck").awaitTermination()
    late = df.withColumn("event_id", F.col("event_id") + 100)
    late.coalesce(1).write.mode("append").parquet(path)
    jobs.ingest_logs(stream, path + "-out", path + "-ck").awaitTermination()
    table = spark.read.parquet(path + "-out")
    assert table.count() == 12 and table.select("day").distinct().count() == 3
    assert rows(table.where("event_id < 2"), "event_id", "level") == [(0, "INFO"), (1, "WARNING")]


def test_prediction_store(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 86400, 2.0)], "model_id STRING, s BIGINT, cpu DOUBLE").withColumn("timestamp", F.timestamp_seconds("s"))
    stream, path = sliced(spark, df, "s", 2)
    jobs.store_predictions(stream, path + "-out", path + "-ck", 300).awaitTermination()
    store = read_store(spark, path + "-out")
    assert rows(store, "key", "batch") == [("prediction:19700101000000", 0), ("prediction:19700102000000", 1)]
    assert rows(latest_document(store, "1970-01-02 00:01:00"), "model_id", "cpu") == [("a", 2.0)]


def test_messages_as_a_stream(spark):
    body = '{"metric_name": "x", "value": %s, "timestamp": "t", "labels": {"model_id": "m"}}'
    df = spark.createDataFrame([(i, body % v) for i, v in enumerate(["1", '"1"', "2.5"])], "s BIGINT, value STRING").withColumn("timestamp", F.timestamp_seconds("s"))
    stream, path = sliced(spark, df, "s", 2)
    jobs.append_to(parse_messages(stream), path + "-out", path + "-ck").awaitTermination()
    assert rows(spark.read.parquet(path + "-out"), "metric_name", "value") == [("x", 1.0), ("x", 2.5)]


def test_periodic_evaluation(spark):
    df = spark.createDataFrame([("a", 90.0, 1.0), ("b", 1.0, 1.0)], "model_id STRING, cpu_percent DOUBLE, memory_percent DOUBLE")
    stream, path = sliced(spark, df, "model_id", 2)
    jobs.evaluate_periodically(stream, path + "-out", path + "-ck", ["model_id"], every=None).awaitTermination()
    got = spark.read.parquet(path + "-out")
    assert rows(got, "model_id", "type") == [("a", "cpu_usage")]
