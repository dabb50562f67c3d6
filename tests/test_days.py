"""Day folders, kept newest documents, keyset pages."""

from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.scalars import moment
from fleetlens.operators import joins, logs
from fleetlens.sources import days
from fleetlens.sources import documents as docs
from tests.conftest import rows

NEW_YEAR = 1704067200


def stamped(spark, data, schema):
    return spark.createDataFrame(data, schema).withColumn("timestamp", F.timestamp_seconds(F.col("s") + NEW_YEAR)).drop("s")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_old_days_go_and_the_others_are_not_touched(spark, tmp_path):
    path = str(tmp_path / "logs")
    df = stamped(spark, [(i, i * 43200) for i in range(20)] + [(99, None)], "id INT, s BIGINT")
    days.write_days(df, path)
    before = files(path)
    for _ in range(2):  # a second time nothing is left to do
        kept = logs.expire(spark, path, datetime(2024, 1, 9, 12), 4)
        assert rows(kept, "id") == [(i,) for i in range(9, 20)]
        after = files(path)
        assert after and after.items() <= before.items()
        assert {d.split("day=")[1].split("/")[0] for d in after} == {f"2024-01-{d:02d}" for d in range(5, 11)}
    assert "PartitionFilters: [isnotnull(day" in kept._jdf.queryExecution().toString()
    assert logs.expire(spark, path, datetime(2025, 1, 1), 1).count() == 0 and not files(path)
    assert days.remove_days(spark, str(tmp_path / "nowhere"), datetime(2024, 1, 1).date()) == []


def test_expired_documents_are_not_read_and_removed_by_folder(spark, tmp_path):
    path = str(tmp_path / "store")
    df = stamped(spark, [("a", 0, 1.0), ("b", 2 * 86400, 2.0), ("a", 2 * 86400 + 60, 3.0)], "model_id STRING, s BIGINT, cpu DOUBLE")
    docs.store_documents(df, path, 86400)
    now = datetime(2024, 1, 4, 0, 0, 30)
    held = docs.unexpired(docs.read_store(spark, path), now)
    assert "PartitionFilters: [isnotnull(until" in held._jdf.queryExecution().toString()
    assert rows(held, "model_id", "cpu") == [("a", 3.0)]
    assert docs.remove_expired(spark, path, now) == ["until=2024-01-02"]
    assert rows(docs.read_store(spark, path), "cpu") == [(2.0,), (3.0,)]
    assert docs.remove_expired(spark, path, now) == []


def test_newest_documents_are_kept_as_batches_come_in_any_order(spark, tmp_path):
    path = str(tmp_path / "latest")
    data = [(f"m{i % 7}" if i % 7 else None, (i * 37) % 101, float(i)) for i in range(100)]
    want = {}
    for model, s, cpu in data:
        if model not in want or (s, -cpu) > (want[model][0], -want[model][1]):
            want[model] = (s, cpu)
    for part in range(5):
        batch = stamped(spark, data[part::5], "model_id STRING, s BIGINT, cpu DOUBLE")
        docs.keep_latest(batch, path, 3600, buckets=3)
    again = stamped(spark, data[3::5], "model_id STRING, s BIGINT, cpu DOUBLE")
    untouched = files(path)
    docs.keep_latest(again.where("model_id = 'm2'"), path, 3600, buckets=3)  # an old batch once more
    assert len(files(path).items() & untouched.items()) >= len({f.split("bucket=")[1][0] for f in untouched}) - 1
    latest = docs.read_latest(spark, path, moment("2024-01-01 00:30:00"))
    assert {r.model_id: r.cpu for r in latest.collect()} == {m: cpu for m, (_, cpu) in want.items()}
    assert "Exchange" not in latest._jdf.queryExecution().toString()
    assert docs.read_latest(spark, path, moment("2024-01-02")).count() == 0


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_pages_by_bookmark_equal_pages_by_offset(spark, size):
    df = stamped(spark, [(i, None if i % 5 == 0 else i // 3) for i in range(17)], "event_id INT, s BIGINT")
    order, after, found = ["timestamp", "event_id"], None, []
    for nth in range(17 // size + 2):
        page = joins.page_after(df, order, after, size)
        assert [r.event_id for r in page.collect()] == [r.event_id for r in joins.page(df, [F.col(c).desc() for c in order], size, nth * size).collect()]
        found += [r.event_id for r in page.collect()]
        after = joins.bookmark(page, order) or after
    assert sorted(found) == list(range(17))
    assert joins.bookmark(df.where("false"), order) is None


def test_a_page_by_bookmark_holds_no_more_than_its_rows(spark):
    df = stamped(spark, [(i, i) for i in range(100)], "event_id INT, s BIGINT")
    plan = joins.page_after(df, ["timestamp", "event_id"], (datetime(2024, 1, 1, 0, 0, 50), 50), 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=10" in plan and "Offset" not in plan


def test_logs_by_bookmark(spark):
    df = stamped(spark, [(i, i // 2, "ERROR" if i % 3 else "INFO") for i in range(12)], "event_id INT, s BIGINT, level STRING")
    first = logs.query(df, limit=4, level="error")
    after = joins.bookmark(joins.page_after(logs.search(df, level="error"), ["timestamp", "event_id"], None, 4), ["timestamp", "event_id"])
    second = logs.query(df, limit=4, after=after, level="error")
    assert [r.event_id for r in first.collect()] == [11, 10, 8, 7] and [r.event_id for r in second.collect()] == [5, 4, 2, 1]


def test_answered_in_one_join(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, "a")], "id INT, model_id STRING")
    registry = spark.createDataFrame([("a",), ("a",), ("b",)], "model_id STRING")
    got = rows(joins.answered(asked, registry), "id", "error")
    assert got == [(1, None), (2, "Model not registered"), (3, "Model not registered"), (4, None)]
