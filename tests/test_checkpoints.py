"""The sink of snapshots: replayed, cut off and resumed batches."""

import pytest
from pyspark.sql import functions as F

from millrace.plans.storage import new_path
from millrace.sources import batches, files
from millrace.streaming import checkpoints


def held(spark, at, df):
    return sorted((r.batch, r.id) for r in batches.published(spark, at, df.schema).collect())


def test_a_replayed_batch_replaces_itself(spark):
    at, write = new_path(spark), None
    write = checkpoints.into(at)
    one, two = spark.range(3), spark.range(10, 12)
    write(one, 0)
    write(two, 1)
    before = held(spark, at, one)
    write(two, 1)
    write(one, 0)
    assert held(spark, at, one) == before and [i for _, i in before] == [0, 1, 2, 10, 11]
    folders = {f.split("-")[0] for f in batches.batches(at).values()}
    assert folders == {"batch=000000000000", "batch=000000000001"}
    write(spark.range(5, 6), 1)
    assert [i for _, i in held(spark, at, one)] == [0, 1, 2, 5]


def test_a_batch_cut_off_is_not_seen(spark):
    at, write = new_path(spark), None
    write = checkpoints.into(at)
    write(spark.range(2), 0)
    broken = spark.range(8).withColumn("id", F.when(F.col("id") == 7, F.raise_error("executor lost").cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="executor lost"):
        write(broken, 1)
    assert [i for _, i in held(spark, at, spark.range(1))] == [0, 1] and len(batches.batches(at)) == 1
    with pytest.raises(Exception, match="executor lost"):
        write(broken, 0)
    assert [i for _, i in held(spark, at, spark.range(1))] == [0, 1]


def test_a_stream_goes_on_and_a_lost_commit_is_written_once(spark):
    at = new_path(spark)
    spark.range(4).repartition(1).write.parquet(f"{at}/in/a")
    stream = spark.readStream.schema("id long").option("recursiveFileLookup", "true").parquet(f"{at}/in")
    checkpoints.run(stream, at, "append")
    spark.range(4, 6).repartition(1).write.parquet(f"{at}/in/b")
    checkpoints.run(stream, at, "append")
    where, path = files.at(f"{at}/checkpoint/commits/1")
    where.delete_file(path)  # the sink has batch 1, the stream does not know
    where.delete_file(path.replace("/1", "/.1.crc")) if where.get_file_info(path.replace("/1", "/.1.crc")).is_file else None
    checkpoints.run(stream, at, "append")
    assert sorted(r.id for r in checkpoints.snapshot(stream, at, "append", []).collect()) == list(range(6))


def test_nothing_published_is_an_empty_table(spark):
    assert batches.published(spark, new_path(spark), spark.range(1).schema).count() == 0
