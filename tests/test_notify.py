from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import notify
from tests.conftest import rows

KEYS = ["alertname", "k"]


def brute(spans, wait, interval, repeat):
    """Second by second, with the members of a group by name."""
    out = []
    for group in sorted({g for g, *_ in spans}):
        own = [s for s in spans if s[0] == group]
        began = next_flush = sent_at = None
        told, waiting, nth = set(), set(), 0
        every = -(-repeat // interval) * interval
        for now in range(0, max(e for *_, e in own) + wait + interval + 1):
            firing_before = {k for _, k, s, e in own if s < now <= e}  # what a flush at this moment sees
            if began is not None and now == next_flush and not (wait == 0 and now == began):
                firing = firing_before
                new, gone = firing - told, told - firing
                short = waiting - firing - told
                if new or gone or (short and firing):
                    out.append((group, began, now, len(firing), len(new), len(gone) + len(short), 0))
                    sent_at, nth = now, 0
                elif firing and now - sent_at >= every:
                    nth += 1
                    sent_at = now
                    out.append((group, began, now, len(firing), 0, 0, nth))
                told, waiting = firing, set()
                next_flush = now + interval
                if not firing:
                    began = None
            arrived = {k for _, k, s, e in own if s == now}
            if arrived and began is None:
                began, next_flush, told, waiting = now, now + wait, set(), set()
            waiting |= arrived
    return sorted(out)


def found(spark, spans, **settings):
    df = spark.createDataFrame(spans, "alertname STRING, k STRING, starts BIGINT, ends BIGINT")
    got = notify.notifications(df, KEYS, **settings)
    assert all((r["status"] == "resolved") == (r["alerts"] == 0) for r in got.select("status", "alerts").collect())
    return rows(got.select("alertname", F.unix_seconds("since").alias("b"), F.unix_seconds("sent_at").alias("s"), "alerts", "new_alerts", "resolved_alerts", "repeat"))


def test_spans(spark):
    firing = [("A", "x", s) for s in (0, 15, 30, 75, 300, 315)] + [("A", "y", 315)]
    df = spark.createDataFrame(firing, "alertname STRING, k STRING, s BIGINT").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(notify.alert_spans(df, KEYS), "k", "starts", "ends") == [("x", 0, 45), ("x", 75, 90), ("x", 300, 330), ("y", 315, 330)]
    last = F.timestamp_seconds(F.lit(320))
    assert rows(notify.alert_spans(df, KEYS, stopped=last), "k", "starts", "ends") == [("x", 0, 45), ("x", 75, 90), ("x", 300, 615), ("y", 315, 615)]


def test_a_life(spark):
    """Two alerts join, one leaves, the group is repeated hourly and resolved."""
    spans = [("A", "x", 0, 7215), ("A", "y", 30, 45)]
    assert found(spark, spans) == [
        ("A", 0, 10, 1, 1, 0, 0), ("A", 0, 40, 2, 1, 0, 0), ("A", 0, 50, 1, 0, 1, 0), ("A", 0, 3650, 1, 0, 0, 1), ("A", 0, 7220, 0, 0, 1, 0)
    ]


@pytest.mark.parametrize(("wait", "interval", "repeat"), [(10, 10, 60), (30, 60, 200), (5, 100, 100), (45, 7, 30), (20, 20, 1000)])
def test_like_brute_force(spark, wait, interval, repeat):
    draw = random.Random(wait * interval)
    spans = []
    for group in "ABCDEFGH":
        for k in "wxyz":
            at = draw.randrange(200)
            while at < 1500:
                end = at + 5 * draw.randrange(1, 40)
                spans.append((group, k, at, end))
                at = end + 5 * draw.randrange(1, draw.choice([4, 60]))
    assert found(spark, spans, wait=wait, interval=interval, repeat=repeat) == brute(spans, wait, interval, repeat)


def test_empty(spark):
    assert found(spark, []) == []


def test_stream_like_batch(spark, tmp_path):
    """Changes come in three files, out of order; what the watermark has passed is what the batch form says."""
    from fleetlens.session import prepare
    from fleetlens.streaming import jobs
    from fleetlens.streaming.notify_state import notification_stream

    prepare(spark)
    draw = random.Random(9)
    spans = []
    for group in "AB":
        for k in "wxyz":
            at = draw.randrange(200)
            while at < 1500:
                end = at + 5 * draw.randrange(1, 40)
                spans.append((group, k, at, end))
                at = end + 5 * draw.randrange(1, 20)
    changes = sorted(c for g, k, s, e in spans for c in ((s, g, k, True), (e, g, k, False)))
    late, settings = 100, {"wait": 20, "interval": 30, "repeat": 60}
    schema = "epoch BIGINT, alertname STRING, alert STRING, fires BOOLEAN"
    for i, (low, high) in enumerate(((0, 600), (600, 1000), (1000, 9999))):
        part = [c for c in changes if low <= c[0] < high]
        draw.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream = notification_stream(source, late, **settings)
    jobs.append_to(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    got = rows(got.select("alertname", F.unix_seconds("since").alias("b"), F.unix_seconds("sent_at").alias("s"), "alerts", "new_alerts", "resolved_alerts", "repeat"))
    passed = max(c[0] for c in changes) - late
    assert got == [r for r in brute(spans, **settings) if r[2] <= passed] and len(got) > 40
