"""Streaming jobs over logs, samples, checks and counters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.functions.timeline import CHUNK, chunked, matched, place, running
from fleetlens.operators.alerts import resource_alerts
from fleetlens.operators.logs import normalize
from fleetlens.operators.tsexpr import counter_delta
from fleetlens.schemas import MAX_FAILED_CHECKS
from fleetlens.session import remove_folder
from fleetlens.sources.documents import store_documents

WATERMARK = "5 minutes"


def read_kafka_logs(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """Logs of a topic as a stream. Needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    body = F.from_json(F.col("value").cast("string"), schema)
    return raw.option("startingOffsets", "earliest").load().select(body.alias("log"), F.col("timestamp").alias("arrival")).select("log.*", "arrival")


def ingest_logs(logs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Normalise logs and append them to a table with a folder per day."""
    arrival = F.col("arrival") if "arrival" in logs.columns else None
    return (
        normalize(logs, arrival)
        .withColumn("day", F.to_date("timestamp"))
        .writeStream.partitionBy("day")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .start(path)
    )


def sliding_metrics(
    samples: DataFrame,
    keys: Sequence[str],
    ts: str = "timestamp",
    value: str = "latency",
    range_: str = "5 minutes",
    step: str = "15 seconds",
    watermark: str = WATERMARK,
) -> DataFrame:
    """Count and mean over a sliding range.

    Samples are first summed per step, so a sample is not copied into each range that holds it;
    only the step sums are.
    """
    steps = (
        samples.withWatermark(ts, watermark)
        .groupBy(*keys, F.window(ts, step).alias("step"))
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    )
    ranges = (
        steps.withColumn("at", F.window_time("step"))
        .groupBy(*keys, F.window("at", range_, step).alias("w"))
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )
    return ranges.select(*keys, F.col("w.end").alias("ts"), "n", (F.col("total") / F.col("n")).alias("mean"))


def open_ranges(
    samples: DataFrame,
    closed: DataFrame,
    keys: Sequence[str],
    ts: str = "timestamp",
    value: str = "latency",
    range_: str = "5 minutes",
    step: str = "15 seconds",
) -> DataFrame:
    """The ranges a finished stream still held open, from the samples as a table.

    The watermark closes ranges by their end, all series at once: what is left ends after the last one in
    ``closed`` and needs only samples of its reach.
    """
    last = closed.agg(F.coalesce(F.max("ts"), F.to_timestamp(F.lit("1900-01-01")))).scalar()
    recent = samples.where(F.col(ts) >= last - F.expr(f"INTERVAL {range_}"))
    return sliding_metrics(recent, keys, ts, value, range_, step).where(F.col("ts") > last)


def dedupe(logs: DataFrame, keys: Sequence[str], ts: str = "timestamp", watermark: str = WATERMARK) -> DataFrame:
    """One row per key within the watermark."""
    return logs.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .start(path)
    )


def store_predictions(documents: DataFrame, path: str, checkpoint: str, expire_seconds: int) -> StreamingQuery:
    """Append prediction documents to their store; a repeated batch overwrites its own folder."""

    def store(batch: DataFrame, batch_id: int) -> None:
        store_documents(batch, f"{path}/batch={batch_id}", expire_seconds, mode="overwrite")

    return (
        documents.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )


def evaluate_periodically(
    snapshots: DataFrame,
    path: str,
    checkpoint: str,
    keep: Sequence[str],
    every: str | None = "60 seconds",
    rules: Callable[[DataFrame, Sequence[str]], DataFrame] = resource_alerts,
) -> StreamingQuery:
    """Evaluate alert rules on each new set of snapshots; ``every=None`` handles what is there and ends.

    A repeated batch overwrites its own folder.
    """

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        rules(batch, keep).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(evaluate)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return writer.start()


def _with_state(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    state_schema: str,
    step: Callable[[DataFrame, DataFrame], DataFrame],
    advance: Callable[[DataFrame, DataFrame], DataFrame],
) -> StreamingQuery:
    """Micro-batches computed from their rows and a small table with the last row of each model.

    ``step(batch, state)`` gives the output; ``advance(written output, state)`` the next state, so the
    batch is computed once. Rows of one model are spread over tasks inside ``step``, which a stateful
    operator keyed by it could not do. A batch that runs twice after a failure gives the same tables:
    the state it started from is kept until the next batch is done, older ones are removed.

    Rows that come late, at or before the last row of their model in earlier batches, are left out of
    results and state and written to ``late``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            state = spark.createDataFrame([], state_schema)
        else:
            state = spark.read.schema(state_schema).parquet(f"{path}/state/batch={batch_id - 1}")
        written = f"{path}/out/batch={batch_id}"
        last = state.select("model_id", F.struct("ts", "id").alias("_last"))
        placed = matched(batch, last, ["model_id"], "left").withColumn("_late", F.coalesce(F.struct("ts", "id") <= F.col("_last"), F.lit(False)))
        placed.where("_late").drop("_late", "_last").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        out = step(placed.where("NOT _late").drop("_late", "_last"), state)
        out.write.mode("overwrite").parquet(written)
        done = spark.read.schema(out.schema).parquet(written)
        advance(done, state).write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
        remove_folder(spark, f"{path}/state/batch={batch_id - 2}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(run)
        .start()
    )


def health_stream(checks: DataFrame, path: str, checkpoint: str, limit: int = MAX_FAILED_CHECKS) -> StreamingQuery:
    """Consecutive failed checks per model, carried over micro-batches (see ``alerts.service_health``)."""
    order = ["ts", "id"]

    def step(batch: DataFrame, state: DataFrame) -> DataFrame:
        numbered = running(chunked(batch, "ts"), ["model_id"], "ts", order, {"_n": ("count", F.lit(1))})
        marked = running(numbered, ["model_id"], "ts", order, {"_ok": ("max", F.when(F.col("ok"), F.col("_n")))})
        carried = matched(marked, state.select("model_id", F.col("failures").alias("_carry")), ["model_id"], "left")
        failures = F.col("_n") - F.coalesce("_ok", -F.coalesce("_carry", F.lit(0)))
        status = F.when(F.col("failures") >= limit, "unavailable").otherwise("available")
        return carried.withColumn("failures", failures).withColumn("status", status).drop("_n", "_ok", "_carry", CHUNK)

    def advance(out: DataFrame, state: DataFrame) -> DataFrame:
        last = out.groupBy("model_id").agg(*[F.max_by(c, place(*order)).alias(c) for c in ("ts", "id", "failures")])
        return matched(state, last.select("model_id"), ["model_id"], "left_anti").unionByName(last)

    return _with_state(checks, path, checkpoint, "model_id STRING, ts TIMESTAMP, id BIGINT, failures BIGINT", step, advance)


def counter_stream(samples: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rate of a counter between each reading and the one before, across micro-batches."""
    columns = ["model_id", "ts", "id", "value"]

    def step(batch: DataFrame, state: DataFrame) -> DataFrame:
        seeds = state.withColumn("seed", F.lit(True))
        rows = batch.select(*columns).withColumn("seed", F.lit(False)).unionByName(seeds)
        elapsed = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / F.lit(1e6)
        return (
            counter_delta(rows, ["model_id"])
            .where("NOT seed")
            .withColumn("rate", F.when(elapsed > 0, F.col("delta") / F.when(elapsed > 0, elapsed)))
            .select(*columns, "delta", "rate")
        )

    def advance(out: DataFrame, state: DataFrame) -> DataFrame:
        readings = out.select(*columns).unionByName(state)
        return readings.groupBy("model_id").agg(*[F.max_by(c, place("ts", "id")).alias(c) for c in columns[1:]])

    return _with_state(samples, path, checkpoint, "model_id STRING, ts TIMESTAMP, id BIGINT, value DOUBLE", step, advance)
