"""Ledger entries of accepted tasks, when they may be paid out, and the sealed result that a task is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.entities import Exchange
from ..plans.registry import query

#: Seconds that a supplier's credit is held at least.
LEAST_HOLD = 86_400


def release_at(now: Column, requested: Column) -> Column:
    """now and the seconds asked for, a day at least; null where now is."""
    return F.timestamp_seconds(F.unix_seconds(now.cast("timestamp")) + F.greatest(F.coalesce(requested, F.lit(0)).cast("long"), F.lit(LEAST_HOLD))).cast("timestamp_ntz")


def settled(tasks: DataFrame) -> DataFrame:
    """task_id, kind, party, amount_micros, payout_status, release_at, error: three entries per task that add up to nothing, from its frozen charge and payout.

    A charge of nothing or less, or a payout below nothing or above the charge, gives one row with an error instead. tasks
    has task_id, buyer_id, supplier_id, charge_micros, payout_micros, at and hold_secs.
    """
    charge, payout = F.col("charge_micros"), F.col("payout_micros")
    good = F.coalesce((charge > 0) & (payout >= 0) & (payout <= charge), F.lit(False))
    none = F.lit(None)
    entry = lambda kind, party, amount, status, release: F.struct(F.lit(kind).alias("kind"), party.cast("long").alias("party"), amount.cast("long").alias("amount_micros"), F.lit(status).alias("payout_status"), release.cast("timestamp_ntz").alias("release_at"), F.lit(None).cast("string").alias("error"))
    three = F.array(
        entry("buyer_charge", F.col("buyer_id"), -charge, "released", none), entry("supplier_credit", F.col("supplier_id"), payout, "held", release_at(F.col("at"), F.col("hold_secs"))), entry("platform_take", none, charge - payout, "released", none),
    )
    wrong = F.array(F.struct(none.cast("string").alias("kind"), none.cast("long").alias("party"), none.cast("long").alias("amount_micros"), none.cast("string").alias("payout_status"), none.cast("timestamp_ntz").alias("release_at"), F.lit("frozen economics").alias("error")))
    return tasks.select("task_id", F.explode(F.when(good, three).otherwise(wrong)).alias("e")).select("task_id", "e.*")


_DONE = "(SELECT t.id AS task_id, j.buyer_id, t.supplier_id, CASE WHEN t.id % 19 = 0 THEN 0 ELSE t.charge_micros END AS charge_micros, CASE WHEN t.id % 23 = 0 THEN t.charge_micros + 1 ELSE t.payout_micros END AS payout_micros, t.completed_at AS at, j.sla_secs * 60 AS hold_secs FROM tasks t JOIN jobs j ON j.id = t.job_id WHERE t.status = 'complete')"
_HELD = f"TS(EPOCH(stamp) + greatest(coalesce(hold_secs, 0), {LEAST_HOLD}))"


@query(f"""WITH d AS (SELECT *, at AS stamp, charge_micros > 0 AND payout_micros >= 0 AND payout_micros <= charge_micros AS good FROM {_DONE} x)
    SELECT task_id, 'buyer_charge' AS kind, buyer_id AS party, -charge_micros AS amount_micros, 'released' AS payout_status, NULL AS release_at, NULL AS error FROM d WHERE good UNION ALL SELECT task_id, 'supplier_credit', supplier_id, payout_micros, 'held', {_HELD}, NULL FROM d WHERE good
    UNION ALL SELECT task_id, 'platform_take', NULL, charge_micros - payout_micros, 'released', NULL, NULL FROM d WHERE good UNION ALL SELECT task_id, NULL, NULL, NULL, NULL, NULL, 'frozen economics' FROM d WHERE NOT good""".replace("at AS stamp", '"at" AS stamp').replace("AS at,", 'AS "at",'))
def tr_settle_entries(e: Exchange) -> DataFrame:
    """Entries of every complete task, a few of which have frozen amounts that cannot be."""
    t, j = e.tasks.where("status = 'complete'").alias("t"), e.jobs.alias("j")
    rows = t.join(j, F.col("j.id") == F.col("t.job_id")).select(
        F.col("t.id").alias("task_id"), "j.buyer_id", "t.supplier_id", F.when(F.col("t.id") % 19 == 0, 0).otherwise(F.col("t.charge_micros")).alias("charge_micros"), F.when(F.col("t.id") % 23 == 0, F.col("t.charge_micros") + 1).otherwise(F.col("t.payout_micros")).alias("payout_micros"),
        F.col("t.completed_at").alias("at"), (F.col("j.sla_secs") * 60).alias("hold_secs"),
    )
    return settled(rows)


@query(f"SELECT id, TS(EPOCH(stamp) + greatest(coalesce(hold_secs, 0), {LEAST_HOLD})) AS release_at FROM (SELECT id, created_at AS stamp, sla_secs * 60 AS hold_secs FROM jobs) x")
def sc_payout_release(e: Exchange) -> DataFrame:
    return e.jobs.select("id", release_at(F.col("created_at"), F.col("sla_secs") * 60).alias("release_at"))


def sealed_peers(tasks: DataFrame, work: DataFrame) -> DataFrame:
    """task_id and the artifact, digest, supplier, engine and build_hash of the first complete peer with the same input whose sealed artifact is its result.

    tasks has id, job_id, input_ref, status, retry_count, completed_at, result_ref and result_sha256; work has task_id,
    attempt, status, artifact_key, artifact_sha256, supplier_id, engine and build_hash. A task is never its own peer: of each
    input the first two candidates are kept, so a hot input costs a rank and not a pair per two tasks.
    """
    done = tasks.where("status = 'complete'").alias("p")
    w = work.where("status = 'terminal'").alias("w")
    same = (F.col("w.task_id") == F.col("p.id")) & (F.col("w.attempt") == F.col("p.retry_count")) & (F.col("p.result_ref") == F.col("w.artifact_key")) & (F.col("p.result_sha256") == F.col("w.artifact_sha256"))
    sealed = done.join(w, same).select("p.job_id", "p.input_ref", F.struct("p.completed_at", "p.id", "w.artifact_key", "w.artifact_sha256", "w.supplier_id", "w.engine", "w.build_hash").alias("c"))
    first = sealed.groupBy("job_id", "input_ref").agg(F.min("c").alias("one"))
    rest = sealed.join(first, ["job_id", "input_ref"]).where("c.id <> one.id").groupBy("job_id", "input_ref").agg(F.min("c").alias("two"))
    both = first.join(rest, ["job_id", "input_ref"], "left")
    peer = tasks.join(both, ["job_id", "input_ref"]).select("id", F.when(F.col("one.id") != F.col("id"), F.col("one")).otherwise(F.col("two")).alias("c")).where("c IS NOT NULL")
    return peer.select(F.col("id").alias("task_id"), F.col("c.artifact_key").alias("artifact"), F.col("c.artifact_sha256").alias("digest"), "c.supplier_id", "c.engine", "c.build_hash")


_RESULTS = "SELECT id, job_id, input_ref, status, retry_count, completed_at, concat(input_ref, '/', CAST(id AS STRING)) AS result_ref, sha256(CAST(id AS STRING)) AS result_sha256 FROM tasks"
_WORK = """SELECT t.id AS task_id, CASE WHEN t.id % 5 = 0 THEN t.retry_count + 1 ELSE t.retry_count END AS attempt, CASE WHEN t.id % 4 = 0 THEN 'claimed' ELSE 'terminal' END AS status, concat(t.input_ref, '/', CAST(t.id AS STRING)) AS artifact_key,
    CASE WHEN t.id % 7 = 0 THEN 'other' ELSE sha256(CAST(t.id AS STRING)) END AS artifact_sha256, t.supplier_id, coalesce(w.engine, '') AS engine, coalesce(w.build_hash, '') AS build_hash FROM tasks t LEFT JOIN workers w ON w.id = t.worker_id"""


@query(f"""WITH r AS ({_RESULTS}), v AS ({_WORK}) SELECT task_id, artifact, digest, supplier_id, engine, build_hash FROM (SELECT t.id AS task_id, v.artifact_key AS artifact, v.artifact_sha256 AS digest, v.supplier_id, v.engine, v.build_hash, row_number() OVER (PARTITION BY t.id ORDER BY p.completed_at, p.id) AS n
    FROM r t JOIN r p ON p.job_id = t.job_id AND p.input_ref = t.input_ref AND p.id <> t.id AND p.status = 'complete' JOIN v ON v.task_id = p.id AND v.attempt = p.retry_count WHERE v.status = 'terminal' AND p.result_ref = v.artifact_key AND p.result_sha256 = v.artifact_sha256) x WHERE n = 1""")
def lk_peer_sealed(e: Exchange) -> DataFrame:
    """The sealed result of each task's first peer; work of another attempt, still open, or of another digest does not count."""
    t = e.tasks.select("id", "job_id", "input_ref", "status", "retry_count", "completed_at", "supplier_id", "worker_id", F.concat_ws("/", "input_ref", "id").alias("ref"), F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    tasks = t.withColumns({"result_ref": F.col("ref"), "result_sha256": F.col("sha")})
    workers = e.workers.select(F.col("id").alias("worker_id"), "engine", "build_hash")
    work = t.join(workers, "worker_id", "left").select(
        F.col("id").alias("task_id"), F.when(F.col("id") % 5 == 0, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("attempt"), F.when(F.col("id") % 4 == 0, "claimed").otherwise("terminal").alias("status"), F.col("ref").alias("artifact_key"),
        F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("sha")).alias("artifact_sha256"), "supplier_id", F.coalesce("engine", F.lit("")).alias("engine"), F.coalesce("build_hash", F.lit("")).alias("build_hash"),
    )
    return sealed_peers(tasks, work)
