"""Every query of the exchange over the smallest tables, against its SQL; those without SQL by invariants."""

import pytest
from comparing import duck, same

from millrace.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def test_fanout_gives_every_item_once(spark):
    rows = QUERIES["al_fanout"](spark, SF).collect()
    jobs = {r.id: r.id % 900 + 1 for r in __import__("millrace.plans.entities", fromlist=["Exchange"]).Exchange(spark, SF).jobs.where("status = 'running'").collect()}
    sums = {}
    for r in rows:
        sums[r.job_id] = sums.get(r.job_id, 0) + r["items"]
        assert r["items"] > 0 and r.secs > 0
    assert all(jobs[j] == n for j, n in sums.items())


def test_executable_plans_have_headroom(spark):
    rows = QUERIES["al_econ_plan"](spark, SF).collect()
    assert rows and all(r.executable == (r.headroom_usd >= -1e-6) and r.charge_usd > r.payout_usd >= 0 for r in rows)


def test_fee_shares_add_up(spark):
    rows = QUERIES["al_fee_alloc"](spark, SF).collect()
    sums = {}
    for r in rows:
        assert r.share_micros >= 0
        sums.setdefault((r.batch_id, r.fee_micros), []).append(r.share_micros)
    assert all(sum(v) == fee for (_, fee), v in sums.items())


def test_stream_monitor_alarms_as_often_as_the_fold(spark):
    alarms = QUERIES["stream_live_monitor"](spark, SF).collect()
    first = {r.worker_id: r.alarm_at for r in QUERIES["ml_live_monitor"](spark, SF).collect()}
    streamed = {}
    for r in alarms:
        streamed[r.worker_id] = min(streamed.get(r.worker_id, 1 << 60), r.alarm_at)
    assert streamed == first


def test_embedding_is_of_unit_length_and_order(spark):
    rows = QUERIES["ml_embed_runner"](spark, SF).collect()
    assert len(rows) == 40 and all(abs(sum(x * x for x in r.result) - 1) < 1e-5 for r in rows)


def test_results_do_not_hang_on_partitions(spark):
    run = lambda: sorted(map(str, QUERIES["al_fee_alloc"](spark, SF).collect()))
    before = run()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    assert run() == before
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fanout_plans_once_for_jobs_alike(spark, tmp_path):
    """Six times the jobs, shifted by 900: the same plans, laid beside the fleet no more often."""
    from pyspark.sql import functions as F

    from millrace.operators import decisions
    from millrace.plans.entities import Exchange

    for name in ("supplier", "part", "orders"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        if name == "orders":
            df = df.crossJoin(spark.range(6).select(F.col("id").alias("k"))).withColumn("o_orderkey", F.col("o_orderkey") + F.col("k") * 1800).drop("k")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    met = []
    plan = decisions.fanout
    decisions.fanout = lambda fleet, items: met.append(fleet.count()) or plan(fleet, items)
    try:
        one, six = (decisions.al_fanout(Exchange(spark, at)) for at in (SF, str(tmp_path)))
    finally:
        decisions.fanout = plan
    assert met[0] == met[1] > 0 and six.count() == 6 * one.count()
    same(six, duck(str(tmp_path)), ORACLE_SQL["al_fanout"])
