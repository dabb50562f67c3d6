"""Telemetry tables derived from the driver's tables (see FIXTURES.md); lazy DataFrames.

Running counters are built with ``functions.timeline``, so a model with a large share of the
events is spread over tasks. Their values are whole numbers, or whole numbers divided once, so that
they do not depend on the order of summation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.functions.timeline import CHUNK, chunked, running, with_position
from fleetlens.operators.clean import dedupe_mean, pivot_metrics
from fleetlens.operators.tsexpr import histogram_build
from fleetlens.schemas import BASIC_METRICS
from fleetlens.session import prepare

METRIC_OF = {
    "click": "requests_total",
    "view": "latency_avg",
    "purchase": "latency_p95",
    "signup": "latency_p99",
    "error": "cpu_usage_real",
}
LIMITS = {"max_cpu": 400.0, "max_memory": 100.0, "max_network": 100.0, "max_latency": 8.0}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = prepare(spark)
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table as a stream. The pattern lets the table be one file or a folder of files."""
        schema = self.read(name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{name}.parque[t]")

    @cached_property
    def events(self) -> DataFrame:
        return events_of(self.read("events"))

    @cached_property
    def metrics(self) -> DataFrame:
        """Long metric table; the time is the hour, so duplicates occur."""
        return self.events.select(
            "event_id",
            F.date_trunc("hour", "ts").alias("timestamp"),
            metric_name().alias("metric_name"),
            "value",
            "model_id",
            "instance",
        )

    @cached_property
    def gaps(self) -> DataFrame:
        """Metrics with missing values."""
        return self.metrics.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))

    @cached_property
    def hourly(self) -> DataFrame:
        """One value per model, metric and hour; some are missing."""
        return dedupe_mean(self.gaps, ["model_id", "metric_name", "timestamp"])

    @cached_property
    def wide(self) -> DataFrame:
        return pivot_metrics(self.gaps, BASIC_METRICS)

    @cached_property
    def logs(self) -> DataFrame:
        return logs_of(self.events)

    @cached_property
    def counted(self) -> DataFrame:
        """Events with their number in the model, from 1."""
        return with_position(chunked(self.events, "ts"), ["model_id"], "ts", ["ts", "event_id"], "n")

    @cached_property
    def latency(self) -> DataFrame:
        """Latency sum and request count per model; both fall back after 49 requests."""
        life = F.floor(F.col("n") / 50)
        inside = W.partitionBy("model_id", "life").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
        return self.counted.withColumn("life", life).select(
            "model_id",
            "ts",
            F.col("event_id").alias("id"),
            (F.sum("cents").over(inside) / F.lit(5000.0)).alias("total"),
            (F.col("n") % 50).cast("double").alias("count"),
            CHUNK,
        )

    @cached_property
    def counts(self) -> DataFrame:
        """Request counter per model that falls back to 0 after 49."""
        return self.counted.select(
            "model_id", "ts", F.col("event_id").alias("id"), (F.col("n") % 50).cast("double").alias("value"), CHUNK
        )

    @cached_property
    def sums(self) -> DataFrame:
        return self.latency.select("model_id", "ts", "id", F.col("total").alias("value"), CHUNK)

    def _total(self, keys: list[str], amount: Column, scale: float) -> DataFrame:
        total = running(chunked(self.events.withColumn("_a", amount), "ts"), keys, "ts", ["ts", "event_id"], {"_t": ("sum", F.col("_a"))})
        return total.select(*keys, "ts", F.col("event_id").alias("id"), (F.col("_t") / F.lit(scale)).alias("value"), CHUNK)

    @cached_property
    def errors(self) -> DataFrame:
        """Error counter per model and instance; an error event adds 1 to 7."""
        amount = F.when(F.col("event_type") == "error", F.col("user_id") % 7 + 1).otherwise(0)
        return self._total(["model_id", "instance"], amount, 1.0)

    @cached_property
    def idle(self) -> DataFrame:
        """Idle seconds per instance and CPU."""
        return self._total(["instance", "cpu"], F.col("cents"), 10000.0)

    @cached_property
    def network(self) -> DataFrame:
        """Bytes received and sent per instance and device."""
        total = running(chunked(self.events, "ts"), ["instance", "device"], "ts", ["ts", "event_id"], {"_t": ("sum", F.col("cents"))})
        return total.select(
            "instance",
            "device",
            "ts",
            F.col("event_id").alias("id"),
            (F.col("_t") * 100).cast("double").alias("received"),
            (F.col("_t") * 50).cast("double").alias("sent"),
            CHUNK,
        )

    @cached_property
    def host_counters(self) -> DataFrame:
        """Both of the above in one table: ``kind`` cpu or network, ``part`` the CPU or device, running cents ``t``."""
        parts = F.array(F.struct(F.lit("cpu").alias("kind"), F.col("cpu").alias("part")), F.struct(F.lit("network").alias("kind"), F.col("device").alias("part")))
        rows = chunked(self.events.select("instance", "ts", "event_id", "cents", F.inline(parts)), "ts")
        total = running(rows, ["kind", "instance", "part"], "ts", ["ts", "event_id"], {"t": ("sum", F.col("cents"))})
        return total.select("kind", "instance", "part", "ts", F.col("event_id").alias("id"), "t")

    @cached_property
    def buckets(self) -> DataFrame:
        """Latency bucket counters per model and bound, read once an hour."""
        hours = histogram_build(self.logs.withColumn("ts", F.date_trunc("hour", "timestamp")), ["model_id", "ts"])
        total = F.sum("n").over(W.partitionBy("model_id", "le").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
        return hours.select("model_id", "le", "ts", F.lit(0).alias("id"), total.cast("double").alias("value"))

    @cached_property
    def snapshots(self) -> DataFrame:
        """Resource snapshot per model, instance and hour."""
        hours = self.events.groupBy("model_id", "instance", F.date_trunc("hour", "ts").alias("ts")).agg(
            F.least(mean_value(), F.lit(100.0)).alias("cpu_percent"),
            F.least(F.max("value") / 3, F.lit(100.0)).alias("memory_percent"),
            (mean_value() * 3e7).alias("memory_bytes"),
            F.sum("cents").alias("_cents"),
            F.count("*").alias("_n"),
        )
        so_far = W.partitionBy("model_id", "instance").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
        return hours.select(
            "model_id",
            "instance",
            "ts",
            "cpu_percent",
            "memory_percent",
            "memory_bytes",
            (F.sum("_cents").over(so_far) * 10).cast("double").alias("read_bytes"),
            (F.sum("_n").over(so_far) * 500).cast("double").alias("write_bytes"),
        )

    @cached_property
    def hosts(self) -> DataFrame:
        """Host reading per instance and hour."""
        return self.events.groupBy("instance", F.date_trunc("hour", "ts").alias("ts")).agg(
            F.least(mean_value() * 1.5, F.lit(100.0)).alias("cpu_percent"),
            F.least(F.max("value") / 2, F.lit(100.0)).alias("memory_percent"),
            F.least(F.min("value") * 4, F.lit(100.0)).alias("disk_percent"),
        )

    def host_gauge(self, value: Column, *labels: Column) -> DataFrame:
        """A gauge of the hosts as samples."""
        return self.hosts.select("instance", *labels, "ts", F.lit(0).alias("id"), value.cast("double").alias("value"))

    @cached_property
    def checks(self) -> DataFrame:
        """Health checks per model."""
        return self.events.select("model_id", "ts", F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))

    @cached_property
    def accuracy(self) -> DataFrame:
        """Share of events without error per model and day."""
        return self.events.groupBy("model_id", F.date_trunc("day", "ts").alias("ts")).agg(
            F.avg((F.col("event_type") != "error").cast("double")).alias("accuracy")
        )

    @cached_property
    def registry(self) -> DataFrame:
        """Models m0 to m7."""
        number = F.substring("model_id", 2, 9).cast("int")
        return (
            self.events.groupBy("model_id")
            .agg(F.count("*").alias("prediction_count"), F.avg("value").alias("_v"), F.max("ts").alias("last_prediction"))
            .select(
                "model_id",
                number.alias("number"),
                F.lit(8).alias("feature_count"),
                "prediction_count",
                (F.col("_v") / 50).alias("avg_latency"),
                "last_prediction",
                F.when(number % 3 != 2, "running").otherwise("stopped").alias("status"),
            )
        )

    @cached_property
    def services(self) -> DataFrame:
        """Services m0 to m9; the registry does not know m8 and m9."""
        return (
            self.events.select((F.col("user_id") % 10).alias("number"))
            .distinct()
            .select(
                F.concat(F.lit("m"), F.col("number").cast("string")).alias("model_id"),
                F.when(F.col("number") % 2 == 0, "running").otherwise("unknown").alias("service_status"),
                F.concat(F.lit("http://localhost:"), (F.col("number") + 8000).cast("string")).alias("url"),
                (F.col("number") + 8000).cast("int").alias("port"),
            )
        )

    @cached_property
    def documents(self) -> DataFrame:
        """Prediction document per model and day."""
        return self.events.groupBy("model_id", F.to_date("ts").alias("d")).agg(
            F.date_trunc("second", F.max("ts")).alias("timestamp"),
            F.max("value").alias("cpu_allocation"),
            F.avg("value").alias("memory_allocation"),
            F.count("*").alias("n"),
        )

    @cached_property
    def demand(self) -> DataFrame:
        """Peak demand per model with the sizing limits of the tests."""

        def peak(event_type: str, value: Column) -> Column:
            return F.max(F.when(F.col("event_type") == event_type, value))

        use = F.least(F.greatest(F.col("value") / 50 * 10, F.lit(0.1)), F.lit(100.0))
        return (
            self.events.groupBy("model_id")
            .agg(
                peak("error", F.col("value")).alias("demand_cpu"),
                peak("view", use).alias("demand_memory"),
                peak("purchase", use).alias("demand_network"),
                peak("signup", F.col("value") / 50).alias("demand_latency"),
            )
            .withColumns({k: F.lit(v) for k, v in LIMITS.items()})
        )

    @cached_property
    def vectors(self) -> DataFrame:
        """Feature vectors; the model is chosen by the vector's id."""
        return self.read("embeddings").select(
            "vec_id",
            F.concat(F.lit("m"), (F.col("vec_id") % 10).cast("string")).alias("model_id"),
            F.col("embedding").cast("array<double>").alias("features"),
            F.col("label").cast("double").alias("label"),
        )

    @cached_property
    def linear_models(self) -> DataFrame:
        """Linear model m0 to m7: coefficient i is the mean of label times feature i over its vectors."""
        known = self.vectors.withColumn("model_id", F.concat(F.lit("m"), (F.col("vec_id") % 8).cast("string")))
        terms = known.select("model_id", "label", F.posexplode("features").alias("i", "x"))
        means = terms.groupBy("model_id", "i").agg(F.avg(F.col("x") * F.col("label")).alias("w"))
        rows = means.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("w"))
        return rows.select("model_id", F.col("w.w").alias("coefficients"), F.lit(0.5).alias("intercept"))


def mean_value() -> Column:
    """Mean value from whole cents: the same double in any order of summation."""
    return F.sum("cents") / (F.count("*") * F.lit(100.0))


def metric_name() -> Column:
    pairs = [F.lit(x) for item in METRIC_OF.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.col("event_type"))


def events_of(raw: DataFrame) -> DataFrame:
    """Events with model, instance, CPU, device and whole cents; works on batch and streaming frames."""

    def label(prefix: str, n: int) -> Column:
        return F.concat(F.lit(prefix), (F.col("user_id") % n).cast("string"))

    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        "props",
        label("m", 8).alias("model_id"),
        label("i", 3).alias("instance"),
        label("c", 2).alias("cpu"),
        label("eth", 2).alias("device"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


def logs_of(events: DataFrame) -> DataFrame:
    latency, failed = F.col("value") / 50.0, F.col("event_type") == "error"
    level = F.when(F.col("event_id") % 3 == 0, None).when(failed, "error").when(latency > 1, "WARNING").otherwise("INFO")
    return events.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        "model_id",
        "instance",
        F.when(F.col("user_id") % 5 == 0, "/health").otherwise("/predict").alias("endpoint"),
        latency.alias("latency"),
        F.when(failed, "prediction failed").alias("error"),
        F.when(~failed, 200).when(F.col("event_id") % 2 == 0, 404).otherwise(500).alias("status_code"),
        level.alias("level"),
        F.col("props").alias("context"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("Completed request of "), "model_id")).alias("message"),
    )
