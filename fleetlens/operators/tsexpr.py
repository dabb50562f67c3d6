"""Time-series expressions over counter, gauge and histogram samples.

Samples are rows ``(keys..., ts, id, value)``; ``id`` breaks ties of equal times. Evaluation times
are multiples of ``step`` seconds since 1970 and a range of r seconds at time e covers
``e - r <= ts < e``. Raw samples of one series may be a large share of the table, so differences
to the sample before use ``functions.timeline``; everything after the first aggregate has at most
one row per series and step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.functions.timeline import CHUNK, place, previous, running
from fleetlens.operators.joins import vector_ratio
from fleetlens.schemas import EVAL_STEP, LATENCY_BUCKETS, RATE_RANGE


def _first_eval(ts: str, step: int) -> Column:
    """The first evaluation after a sample, as seconds."""
    return (F.floor(F.unix_seconds(F.col(ts)) / F.lit(step)) + 1) * step


#: Step rows are dealt out by series and time block, so that one series keeps many tasks busy.
BLOCK_SECONDS = 6 * 3600
BLOCK = "_block"


def _block(seconds: Column, block_seconds: int) -> Column:
    return F.floor(seconds / F.lit(block_seconds))


def _block_length(block_seconds: int, range_seconds: int, step: int) -> int:
    """Whole steps, and no range reaches beyond the next block."""
    return -(-max(block_seconds, range_seconds) // step) * step


def _spread(steps: DataFrame, keys: Sequence[str], range_seconds: int, step: int, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """One row per series and evaluation time whose range holds a sample.

    ``steps`` has one row per series and first evaluation ``e``. Each row is stretched up to the
    series' next row only, so the result has no duplicates and nothing is copied per range. The first rows of a block, as far
    as a range reaches, go to the block before as well, which needs to know where its last rows end.
    """
    length = _block_length(block_seconds, range_seconds, step)
    home = _block(F.col("e"), length)
    halo = F.col("e") - home * length < range_seconds
    rows = steps.withColumn("_home", home).withColumn(BLOCK, F.explode(F.when(halo, F.array(home, home - 1)).otherwise(F.array(home))))
    series = W.partitionBy(*keys, BLOCK).orderBy("e")
    ahead = F.lead("e").over(series)
    last = F.least(F.col("e") + range_seconds - step, F.coalesce(ahead - step, F.col("e") + range_seconds - step))
    stretched = rows.withColumn("_until", last).where(F.col(BLOCK) == F.col("_home")).drop(BLOCK, "_home")
    return stretched.withColumn("eval", F.explode(F.sequence("e", "_until", F.lit(step))))


def instant(
    df: DataFrame, keys: Sequence[str], lookback: int = RATE_RANGE, step: int = EVAL_STEP, block_seconds: int = BLOCK_SECONDS
) -> DataFrame:
    """Latest sample of each series at each evaluation time within the lookback."""
    if lookback % step:
        raise ValueError("lookback must be a multiple of step")
    latest = df.groupBy(*keys, _first_eval("ts", step).alias("e")).agg(
        F.max_by("value", place("ts", "id")).alias("value")
    )
    return _spread(latest, keys, lookback, step, block_seconds).select(*keys, F.timestamp_seconds("eval").alias("ts"), "value")


def _delta(value: str) -> Column:
    now, before = F.col(value), F.col(f"prev_{value}")
    return F.when(before.isNotNull(), F.when(now < before, now).otherwise(now - before))


def counter_delta(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Growth since the sample before; a drop means the counter restarted from 0. First sample: null."""
    with_prev = previous(df, keys, "ts", ["ts", "id"], ["value", "ts"])
    return with_prev.withColumn("delta", _delta("value")).drop("prev_value")


def growth(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str] = ("value",),
    range_seconds: int = RATE_RANGE,
    step: int = EVAL_STEP,
    latest: bool = False,
    block_seconds: int = BLOCK_SECONDS,
) -> DataFrame:
    """Per series and evaluation: growth of each counter column inside the range, samples, elapsed seconds.

    With ``latest`` also the last value of each column in the range (``last_<c>``), as ``instant`` gives.

    Growth counts differences between two samples that both lie in the range. Samples are summed per
    step first; the step rows, bounded by time span / step per series, are then brought together by
    series and time block and summed per evaluation in place, without another shuffle. A step row whose
    range reaches into the next block goes there as well.
    """
    if range_seconds % step:
        raise ValueError("range must be a multiple of step")
    first = _first_eval("ts", step)
    narrow = df.select(*keys, "ts", "id", *values, *[c for c in (CHUNK,) if c in df.columns])
    samples = previous(narrow, keys, "ts", ["ts", "id"], [*values, "ts"]).withColumn("e", first)
    # The first sample of a step has its predecessor in an earlier step; that predecessor may be out of range.
    enters = F.coalesce(F.unix_seconds("prev_ts") < F.col("e") - step, F.lit(True))
    sums = []
    for v in values:
        delta = F.coalesce(_delta(v), F.lit(0.0))
        sums.append(F.sum(F.when(~enters, delta).otherwise(0.0)).alias(f"_in_{v}"))
        sums.append(F.sum(F.when(enters, delta).otherwise(0.0)).alias(f"_enter_{v}"))
    newest = [F.max_by(v, place("ts", "id")).alias(f"_last_{v}") for v in values if latest]
    steps = samples.groupBy(*keys, "e").agg(
        *sums,
        *newest,
        F.max(F.when(enters, F.unix_micros("prev_ts"))).alias("_before"),
        F.count("*").alias("n"),
        F.min(F.unix_micros("ts")).alias("t0"),
        F.max(F.unix_micros("ts")).alias("t1"),
    )
    length = _block_length(block_seconds, range_seconds, step)
    last = F.col("e") + range_seconds - step
    blocks = F.array_distinct(F.array(_block(F.col("e"), length), _block(last, length)))
    placed = steps.withColumn(BLOCK, F.explode(blocks)).repartition(*keys, BLOCK)
    begin, end = F.greatest("e", F.col(BLOCK) * length), F.least(last, (F.col(BLOCK) + 1) * length - step)
    evals = placed.select("*", F.explode(F.sequence(begin, end, F.lit(step))).alias("eval"))
    in_range = F.col("_before") >= (F.col("eval") - range_seconds) * 1000000
    grown = [
        F.sum(F.col(f"_in_{v}") + F.when(in_range, F.col(f"_enter_{v}")).otherwise(0.0)).alias(v) for v in values
    ]
    grown += [F.max_by(f"_last_{v}", "e").alias(f"last_{v}") for v in values if latest]
    return evals.groupBy(*keys, BLOCK, "eval").agg(
        *grown, F.sum("n").alias("n"), ((F.max("t1") - F.min("t0")) / F.lit(1e6)).alias("elapsed")
    ).drop(BLOCK)


def increase(df: DataFrame, keys: Sequence[str], range_seconds: int = RATE_RANGE, step: int = EVAL_STEP) -> DataFrame:
    """Growth of a counter over the range; needs two samples."""
    grown = growth(df, keys, ["value"], range_seconds, step).where("n >= 2")
    return grown.select(*keys, F.timestamp_seconds("eval").alias("ts"), "value")


def rate(
    df: DataFrame,
    keys: Sequence[str],
    range_seconds: int = RATE_RANGE,
    step: int = EVAL_STEP,
    values: Sequence[str] = ("value",),
) -> DataFrame:
    """Growth per second between the first and last sample of the range, of one or more counter columns."""
    grown = growth(df, keys, values, range_seconds, step).where("n >= 2 AND elapsed > 0")
    per_second = [(F.col(v) / F.col("elapsed")).alias(v) for v in values]
    return grown.select(*keys, F.timestamp_seconds("eval").alias("ts"), *per_second)


def latency_avg(
    df: DataFrame, keys: Sequence[str], range_seconds: int = RATE_RANGE, step: int = EVAL_STEP, total: str = "total", count: str = "count"
) -> DataFrame:
    """rate(sum) / rate(count); no result where nothing was counted.

    Both counters are columns of one sample table, as they are read together: one pass, no join.
    """
    rates = rate(df, keys, range_seconds, step, [total, count])
    return rates.select(*keys, "ts", F.try_divide(total, count).alias("value")).where("value IS NOT NULL")


def agg_by_label(df: DataFrame, by: Sequence[str], how: str = "sum") -> DataFrame:
    """``sum by`` / ``avg by`` over series at each evaluation; no labels means one global series."""
    agg = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[how]
    return df.groupBy(*by, "ts").agg(agg("value").alias("value"))


def histogram_build(
    df: DataFrame, keys: Sequence[str], value: str = "latency", bounds: Sequence[float] = tuple(LATENCY_BUCKETS)
) -> DataFrame:
    """Cumulative bucket counts, sum and count of the observations of each key.

    One pass with a conditional counter per bound; rows are made per bucket only after grouping.
    """
    counts = [F.count_if(F.col(value) <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    grouped = df.groupBy(*keys).agg(*counts, F.sum(value).alias("sum"), F.count(value).alias("count"))
    buckets = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)])
    return grouped.select(*keys, "sum", "count", F.explode(buckets).alias("b")).select(*keys, "b.le", "b.n", "sum", "count")


def bucket_columns(keys: Sequence[str], le: Column, count: Column) -> dict[str, Column]:
    """For each bucket its bound ``le`` and count ``c``, those of the bucket below and the ``total``."""
    by_bound = W.partitionBy(*keys).orderBy(le)
    total = F.max(count).over(W.partitionBy(*keys))
    return {"le": le, "c": count, "le0": F.lag(le, 1, 0.0).over(by_bound), "c0": F.lag(count, 1, 0.0).over(by_bound), "total": total}


def bucket_quantile(q: float) -> Column:
    """Aggregate over ``bucket_columns``: the quantile, linear inside the first bucket that reaches its rank."""
    rank = F.lit(q) * F.col("total")
    inside = F.col("le0") + (F.col("le") - F.col("le0")) * F.try_divide(rank - F.col("c0"), F.col("c") - F.col("c0"))
    quantile = F.when(F.col("le") == float("inf"), F.col("le0")).otherwise(inside)
    hit = (F.col("total") > 0) & (F.col("c") >= rank)
    return F.min_by(quantile, F.when(hit, F.col("le")))


def histogram_quantiles(
    df: DataFrame, qs: Sequence[float], keys: Sequence[str], le: str = "le", value: str = "value"
) -> DataFrame:
    """Quantiles (rows q, value) of cumulative buckets, linear inside the bucket; one pass for all of them.

    A quantile in the +Inf bucket gives the bound below it; no observations give null.
    """
    below = df.select(*keys, *[c.alias(name) for name, c in bucket_columns(keys, F.col(le), F.col(value)).items()])
    found = below.groupBy(*keys).agg(*[bucket_quantile(q).alias(f"_q{i}") for i, q in enumerate(qs)])
    each = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"_q{i}").alias("value")) for i, q in enumerate(qs)])
    return found.select(*keys, F.explode(each).alias("x")).select(*keys, "x.q", "x.value")


def histogram_quantile(df: DataFrame, q: float, keys: Sequence[str], le: str = "le", value: str = "value") -> DataFrame:
    """One quantile of cumulative buckets."""
    return histogram_quantiles(df, [q], keys, le, value).drop("q")


def request_counts(logs: DataFrame, every: str = "1 hour") -> DataFrame:
    """Requests by endpoint and model per window."""
    return (
        logs.groupBy("endpoint", "model_id", F.window("timestamp", every).alias("w"))
        .agg(F.count("*").alias("requests"), F.count("error").alias("errors"))
        .select("endpoint", "model_id", F.col("w.start").alias("window_start"), "requests", "errors")
    )


def cpu_percent(idle: DataFrame, range_seconds: int = RATE_RANGE, step: int = EVAL_STEP) -> DataFrame:
    """100 - 100 * mean idle rate over the CPUs of an instance."""
    per_cpu = rate(idle, ["instance", "cpu"], range_seconds, step)
    mean = agg_by_label(per_cpu, ["instance"], "avg")
    return mean.withColumn("value", F.lit(100.0) - F.col("value") * 100)


def memory_percent(available: DataFrame, total: DataFrame, keys: Sequence[str] = ("instance", "ts")) -> DataFrame:
    """(1 - available / total) * 100."""
    ratio = vector_ratio(available, total, keys)
    return ratio.withColumn("value", (F.lit(1.0) - F.col("value")) * 100)


def disk_percent(free: DataFrame, size: DataFrame, keys: Sequence[str] = ("instance", "mountpoint", "ts")) -> DataFrame:
    """(size - free) / size * 100 per mount."""
    both = free.select(*keys, F.col("value").alias("free")).join(size.select(*keys, F.col("value").alias("size")), list(keys))
    used = F.try_divide((F.col("size") - F.col("free")) * 100.0, F.col("size"))
    return both.select(*keys, used.alias("value")).where("value IS NOT NULL")


def network_bytes(
    df: DataFrame,
    by: Sequence[str] = (),
    range_seconds: int = RATE_RANGE,
    step: int = EVAL_STEP,
    keys: Sequence[str] = ("instance", "device"),
) -> DataFrame:
    """Receive plus transmit rate, summed over all instances or by label; both are columns ``received`` and ``sent``."""
    rates = rate(df, keys, range_seconds, step, ["received", "sent"])
    return agg_by_label(rates.withColumn("value", F.col("received") + F.col("sent")), by)


def io_rate(snapshots: DataFrame, keys: Sequence[str] = ("model_id", "instance")) -> DataFrame:
    """(read + written bytes) per second since the snapshot before; none for the first or without elapsed time."""
    rows = previous(snapshots, keys, "ts", ["ts"], ["ts", "read_bytes", "write_bytes"])
    elapsed = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / F.lit(1e6)
    moved = F.col("read_bytes") - F.col("prev_read_bytes") + F.col("write_bytes") - F.col("prev_write_bytes")
    return (
        rows.withColumn("_elapsed", elapsed)
        .where("prev_ts IS NOT NULL AND _elapsed > 0")
        .select(*keys, "ts", (moved / F.col("_elapsed")).alias("value"))
    )


def active_services(services: DataFrame, status: str = "status") -> DataFrame:
    return services.agg(F.count_if(F.col(status) == "running").alias("active_services"))


def running_stats(logs: DataFrame, keys: Sequence[str] = ("model_id",), ts: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """Prediction count and mean latency of each model up to each prediction."""
    aggs: Mapping[str, tuple[str, Column]] = {
        "prediction_count": ("count", F.lit(1)),
        "_total": ("sum", F.col("latency")),
    }
    stats = running(logs, keys, ts, [ts, tie], dict(aggs))
    return stats.withColumn("avg_latency", F.col("_total") / F.col("prediction_count")).drop("_total")
