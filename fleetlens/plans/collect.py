"""All metrics of a fleet from one stacked table of samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.tsexpr import bucket_columns, bucket_quantile, growth
from fleetlens.schemas import EVAL_STEP, RATE_RANGE

#: What a sample is of: ``owner`` is its model or instance, ``part`` what there is several of.
REQUESTS, BUCKET, CPU, MEMORY, NETWORK = "requests", "bucket", "cpu", "memory", "network"
QUANTILES: Mapping[str, float] = {"latency_p95": 0.95, "latency_p99": 0.99}


def samples_of(df: DataFrame, kind: str | Column, owner: str, part: str | None, first: str | Column, second: str | Column | None = None, ts: str = "ts", tie: str = "id") -> DataFrame:
    """Samples in the form of the stacked table: kind, owner, part, ts, id, first, second."""

    def value(c: str | Column | None) -> Column:
        return (F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast("double")

    return df.select(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        F.col(owner).alias("owner"),
        (F.lit("") if part is None else F.col(part).cast("string")).alias("part"),
        F.col(ts).alias("ts"),
        F.col(tie).cast("long").alias("id"),
        value(first).alias("first"),
        value(second).alias("second"),
    )


def collect_metrics(samples: DataFrame, range_seconds: int = RATE_RANGE, step: int = EVAL_STEP, quantiles: Mapping[str, float] = QUANTILES) -> DataFrame:
    """metric_name, model_id, instance, ts, value of every metric on one grid.

    ``samples`` is the stacked table (``samples_of``): requests (latency sum and request count), cumulative buckets (``part``
    the bound), idle seconds per CPU, memory in use in percent, bytes received and sent per device. Rates and latest
    values of all of them come from one ``growth``, so rows are shuffled as for one metric, and the expressions from one
    aggregate per owner and evaluation.
    """
    series = growth(samples, ["kind", "owner", "part"], ["first", "second"], range_seconds, step, latest=True)
    kind, good = F.col("kind"), (F.col("n") >= 2) & (F.col("elapsed") > 0)
    first, second = (F.when(good, F.col(c) / F.col("elapsed")) for c in ("first", "second"))

    def of(name: str, value: Column) -> Column:
        return F.when(kind == name, value)

    rates = series.select(
        "kind", F.when(kind != NETWORK, F.col("owner")).alias("owner"), "eval",
        of(REQUESTS, F.col("last_second")).alias("count"),
        of(REQUESTS, F.try_divide(first, second)).alias("latency"),
        of(BUCKET, F.when(first.isNotNull(), F.col("part").try_cast("double"))).alias("bound"),
        of(BUCKET, first).alias("reached"),
        of(CPU, first).alias("idle"),
        of(MEMORY, F.col("last_first")).alias("memory"),
        of(NETWORK, first + second).alias("bytes"),
    )
    group = ["kind", "owner", "eval"]
    buckets = bucket_columns(group, F.col("bound"), F.col("reached"))  # the same partitioning serves the aggregate
    found = rates.select("*", *[c.alias(name) for name, c in buckets.items()]).groupBy(*group).agg(
        F.max("count").alias("count"), F.max("latency").alias("latency"), *[bucket_quantile(q).alias(m) for m, q in quantiles.items()],
        F.avg("idle").alias("idle"), F.max("memory").alias("memory"), F.sum("bytes").alias("bytes"),
    )
    service = {"requests_total": F.col("count"), "latency_avg": F.col("latency"), **{m: F.col(m) for m in quantiles}}
    host = {"cpu_usage_real": F.lit(100.0) - F.col("idle") * 100, "memory_usage_real": F.col("memory"), "network_io_real": F.col("bytes")}

    def rows(values: Mapping[str, Column]) -> list[Column]:
        return [F.struct(F.lit(m).alias("metric_name"), v.alias("value")) for m, v in values.items()]

    is_host = F.col("metric_name").isin(*host)
    return (
        found.select("owner", "eval", F.inline(F.filter(F.array(*rows(service), *rows(host)), lambda r: r["value"].isNotNull())))
        .select(
            "metric_name",
            F.when(is_host, "system").otherwise(F.col("owner")).alias("model_id"),
            F.when(is_host, F.coalesce("owner", F.lit("unknown"))).alias("instance"),
            F.timestamp_seconds("eval").alias("ts"),
            "value",
        )
    )
