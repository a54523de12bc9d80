"""What grows with the tables: shuffles by a few groups, micro-batches by files, aggregates over distinct values."""

from types import SimpleNamespace

from millrace.operators import aggregates, artifacts
from millrace.plans.entities import Exchange
from millrace.plans.storage import new_path
from millrace.sources import batches, multipart
from millrace.streaming import checkpoints

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ledger_is_summed_once(spark):
    rows = [(1, "buyer_charge", -5), (1, "supplier_credit", 4), (1, "platform_take", 1), (2, "buyer_charge", -5), (2, "buyer_charge", 5), (3, "buyer_charge", 1), (4, "buyer_charge", 0), (4, "clawback", -9), (None, "platform_take", 2)]
    got = aggregates.ag_zero_sum(SimpleNamespace(ledger=spark.createDataFrame(rows, "task_id long, kind string, amount_micros long")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2, 0, 2), (3, 1, 1), (None, 2, 1)], key=str)
    assert plan(got).count("Aggregate [") == 1


def test_bodies_are_not_dealt_by_job(spark):
    at = new_path(spark)
    multipart.write_ordered(spark.createDataFrame([("a/0", b"{}"), ("a/1", b"{}")], "key string, data binary"), at, [])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = artifacts.judged(spark.createDataFrame([("a", 0, 2, "x"), ("a", 1, 2, "x")], "job string, chunk long, bytes long, sha256 string"), spark, at)
        text = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [i for i, x in enumerate(text) if "SortMergeJoin" in x and "[job#" in x and "chunk#" not in x]
    assert joins and all("BinaryFile" not in text[j] for j in joins)
    first = text[min(joins) :]
    assert any("chunk#" in x and "SortMergeJoin" in x for x in text[: min(joins)]), first  # the join by job is below the one that brings the bodies


def test_batches_of_a_stream_do_not_grow_with_files(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(checkpoints, "new_path", lambda s: seen.append(new_path(s)) or seen[-1])
    e = Exchange(spark, SF)
    e._made["events"] = e.events.repartition(9)
    assert checkpoints.snk_checkpoint(e).count() == 30
    assert len(batches.batches(f"{seen[0]}/out")) == 2  # 36 before


def test_small_triggers_give_the_same_documents(spark, monkeypatch):
    e = Exchange(spark, SF)
    e._made["events"] = e.events.repartition(3)
    want = sorted(map(tuple, checkpoints.snk_checkpoint(Exchange(spark, SF)).collect()))
    monkeypatch.setattr(checkpoints, "TRIGGER_BYTES", 1)
    assert sorted(map(tuple, checkpoints.snk_checkpoint(e).collect())) == want
