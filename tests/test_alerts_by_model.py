from __future__ import annotations

from datetime import datetime

from fleetlens.catalog import QUERIES, TWINS
from tests.conftest import rows


def test_a_breach_is_an_alert_of_each_model_on_the_host(spark, tmp_path):
    # users 0 and 6 are models m0 and m6 on host i0, user 1 is m1 on i1; at least two thirds of 80 breach CPU
    times = [datetime(2024, 1, 1, 5, minute) for minute in (0, 10, 20, 20)]
    data = [(i, ts, user, "view", value, None) for i, (ts, user, value) in enumerate(zip(times, (0, 6, 1, None), (60.0, 60.0, 1.0, 90.0), strict=True))]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["alr_system"](spark, str(tmp_path))
    assert rows(got, "model_id", "instance", "type") == [
        (model, "i0", kind) for model in ("m0", "m6") for kind in ("system_cpu_usage", "system_disk_usage")
    ]
    assert "n_models" not in got.columns
    assert TWINS["alr_system"] == TWINS["join_alerts_system_x_models"]
