"""A streaming sink of snapshots: every micro-batch is published under its number, so that one that is run again replaces itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.entities import Exchange
from ..plans.registry import query
from ..plans.storage import new_path
from ..sources import batches

#: Bytes of a micro-batch: a file is no measure, for each batch costs a commit of every partition of the state.
TRIGGER_BYTES = 512 << 20


def into(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch that was cut off and comes again leaves its rows once."""

    def write(batch: DataFrame, number: int) -> None:
        batches.publish(batch, path, number)

    return write


def run(stream: DataFrame, at: str, mode: str) -> None:
    """All that the stream has now, from where the checkpoint at `at` stands, into the sink at `at`."""
    stream.writeStream.outputMode(mode).foreachBatch(into(f"{at}/out")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def snapshot(stream: DataFrame, at: str, mode: str, keys: list[str]) -> DataFrame:
    """What the sink holds: all rows (append), those of the last batch (complete), or the last row of each key (update)."""
    spark = stream.sparkSession
    rows = batches.published(spark, f"{at}/out", stream.schema, last=mode == "complete")
    if mode != "update":
        return rows.drop("batch")
    latest = F.max_by(F.struct(*[c for c in stream.columns if c not in keys]), "batch").alias("latest")
    return rows.groupBy(*keys).agg(latest).select(*keys, "latest.*")


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """What the stream gives for all data there is now, through a checkpoint and a table in the shared folder."""
    at = new_path(stream.sparkSession)
    run(stream, at, mode)
    return snapshot(stream, at, mode, keys or [])


def document(fields: list[str], partial: Column) -> Column:
    """A result as JSON; `"partial":true` stands in it as long as it is not all."""
    return F.to_json(F.struct(*fields, F.when(partial, F.lit(True)).alias("partial")))


@query("""WITH s AS (SELECT 'interrupted' AS stage, user_id AS worker_id, count(*) AS completions, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS duration_ms FROM events WHERE event_id % 4 < 2 GROUP BY user_id
      UNION ALL SELECT 'finished', user_id, count(*), CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) FROM events GROUP BY user_id), t AS (SELECT user_id AS worker_id, count(*) AS wanted FROM events GROUP BY user_id)
    SELECT s.stage, s.worker_id, s.completions < t.wanted AS partial, concat('{"worker_id":', s.worker_id, ',"completions":', s.completions, ',"duration_ms":', s.duration_ms, CASE WHEN s.completions < t.wanted THEN ',"partial":true}' ELSE '}' END) AS document FROM s JOIN t ON t.worker_id = s.worker_id""")
def snk_checkpoint(e: Exchange) -> DataFrame:
    """Results of workers as documents, after half of their slices have come and after all: the second run goes on from the checkpoint of the first.

    A document is partial until as many slices are in as the worker has. The stream gives each worker's running sums (update
    mode), the sink keeps them per batch, and the last of each worker is its document.
    """
    spark, at = e.spark, new_path(e.spark)
    wanted = e.events.groupBy(F.col("user_id").alias("worker_id")).agg(F.count("*").alias("wanted"))
    stages = []
    for stage, slices in (("interrupted", (0, 1)), ("finished", (2, 3))):
        e.events.where((F.col("event_id") % 4).isin(*slices)).write.parquet(f"{at}/in/{stage}")
        stream = spark.readStream.schema(e.events.schema).option("maxBytesPerTrigger", str(TRIGGER_BYTES)).option("recursiveFileLookup", "true").parquet(f"{at}/in")
        per = stream.groupBy(F.col("user_id").alias("worker_id")).agg(F.count("*").alias("completions"), F.sum(F.round(F.col("value") * 1000).cast("long")).alias("duration_ms"))
        run(per, at, "update")
        stages.append(snapshot(per, at, "update", ["worker_id"]).withColumn("stage", F.lit(stage)))
    rows = stages[0].unionByName(stages[1]).join(wanted, "worker_id")
    partial = F.col("completions") < F.col("wanted")
    return rows.select("stage", "worker_id", partial.alias("partial"), document(["worker_id", "completions", "duration_ms"], partial).alias("document"))
