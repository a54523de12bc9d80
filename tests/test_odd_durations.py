"""Slices that took no time, or whose time or length is not known."""

import datetime as dt

import pytest
from comparing import duck, same

from millrace.operators import records
from millrace.plans.catalogue import ORACLE_SQL
from millrace.plans.entities import Exchange


@pytest.mark.parametrize("name", ["ml_live_monitor", "ml_sustained_bench"])
def test_slices_of_no_time(spark, tmp_path, name):
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    values = {1: [0.0, 1.0, 2.0, 3.0, 4.0, 0.0], 2: [1.0, 1.0, 0.0, 5.0, 5.0, 5.0, 0.0], 3: [0.0], 4: [0.0] * 9, 5: [1.0, None, 2.0, 2.0, 2.0], 6: [0.0004, 0.0004, 1.0, 1.0, 1.0]}
    rows = [(100 * u + i, None if u == 5 and i == 0 else at(i), u, "view", v, "{}") for u, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    same(getattr(records, name)(Exchange(spark, str(tmp_path))), duck(str(tmp_path)), ORACLE_SQL[name])
