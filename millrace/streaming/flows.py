"""Structured Streaming: rolling drift with a watermark, latest heartbeats, the throughput monitor as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.entities import Exchange
from ..plans.registry import query
from .checkpoints import drained


def event_stream(e: Exchange) -> DataFrame:
    """The events table as a stream of files."""
    return e.spark.readStream.schema(e.events.schema).option("pathGlobFilter", "events.parquet").parquet(e.sf_dir)


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, avg(value) AS avg_value FROM events GROUP BY 1, 2")
def stream_drift(e: Exchange) -> DataFrame:
    """Count and mean per day and type, as they change; a watermark of an hour bounds the state, which drops days that are over."""
    stamped = event_stream(e).withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", "1 hour")
    per = stamped.groupBy(F.window("t", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("avg_value"))
    return drained(per, "update", ["w", "event_type"]).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "avg_value")


@query("SELECT user_id AS worker_id, max(ts) AS seen_at, arg_max(value, {'a': ts, 'b': event_id}) AS value FROM events GROUP BY user_id")
def stream_heartbeat(e: Exchange) -> DataFrame:
    """The newest heartbeat of each worker, one row of state per worker."""
    per = event_stream(e).groupBy(F.col("user_id").alias("worker_id")).agg(F.max("ts").alias("seen_at"), F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return drained(per, "complete")


def monitor(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Mean rate of the first two slices as the base; an alarm at every third slice in a row under 75 % of it."""
    seen, total, low = state.get if state.exists else (0, 0.0, 0)
    alarms = []
    for rate in pd.concat(list(parts)).sort_values(["created_at", "id"]).rate:
        seen += 1
        if seen <= 2:
            total += rate
            continue
        low = low + 1 if rate < 0.75 * total / 2 else 0
        if low == 3:
            alarms.append(seen)
            low = 0
    state.update((seen, total, low))
    yield pd.DataFrame({"worker_id": [key[0]] * len(alarms), "alarm_at": alarms})


@query("""WITH r AS (SELECT user_id AS worker_id, event_id, ts, 1000.0::DOUBLE / round(value * 1000) AS rate FROM events WHERE round(value * 1000) > 0), n AS (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY ts, event_id) AS n FROM r), b AS (SELECT worker_id, avg(rate) AS base FROM n WHERE n <= 2 GROUP BY worker_id),
    l AS (SELECT n.worker_id, n.n, n.n > 2 AND n.rate < 0.75::DOUBLE * b.base AS low FROM n JOIN b ON b.worker_id = n.worker_id), g AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY worker_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM l),
    p AS (SELECT *, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY worker_id, run ORDER BY n ROWS UNBOUNDED PRECEDING) AS at_ FROM g) SELECT worker_id, n AS alarm_at FROM p WHERE low AND at_ % 3 = 0""")
def stream_live_monitor(e: Exchange) -> DataFrame:
    """Alarms of the throughput monitor as a stateful stream; within a micro-batch a worker's slices are put in order of time."""
    rates = event_stream(e).where("round(value * 1000) > 0").select(F.col("user_id").alias("worker_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"), (1000.0 / F.round(F.col("value") * 1000)).alias("rate"))
    alarms = rates.groupBy("worker_id").applyInPandasWithState(monitor, "worker_id long, alarm_at long", "seen long, total double, low long", "append", GroupStateTimeout.NoTimeout)
    return drained(alarms)
