"""Time-driven sweeps and state transitions, as functions of the state at a given moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, risk
from ..plans.entities import AS_OF, Exchange
from ..plans.registry import query
from .aggregates import DAY, seconds
from .relations import EMBED, FINISHED, first

NOW = f"TS({AS_OF})"


def age(c: str):
    """Seconds from c to the moment of asking."""
    return F.lit(float(AS_OF)) - seconds(c)


# Sweeps


@query(f"SELECT id, job_id FROM tasks WHERE status = 'running' AND claimed_at < TS({AS_OF - 1800}) ORDER BY claimed_at, id LIMIT 1000")
def sw_stale(e: Exchange, timeout: int = 1800, most: int = 1000) -> DataFrame:
    return e.tasks.where((F.col("status") == "running") & (F.col("claimed_at") < e.ago(timeout))).orderBy("claimed_at", "id").limit(most).select("id", "job_id")


@query(f"SELECT id, CASE WHEN retry_count < 3 THEN 'retrying' ELSE 'failed' END AS status, CASE WHEN retry_count < 3 THEN CAST(60 * pow(2, least(retry_count, 4)) AS BIGINT) END AS wait_secs FROM tasks WHERE status = 'running' AND claimed_at < TS({AS_OF - 1800})")
def sw_stale_apply(e: Exchange) -> DataFrame:
    again = F.col("retry_count") < 3
    wait = (60 * F.pow(F.lit(2.0), F.least("retry_count", F.lit(4)))).cast("long")
    return e.tasks.where((F.col("status") == "running") & (F.col("claimed_at") < e.ago(1800))).select("id", F.when(again, "retrying").otherwise("failed").alias("status"), F.when(again, wait).alias("wait_secs"))


_LATE = f"t.status = 'running' AND t.hedged_from IS NULL AND (t.started_at < TS({AS_OF - 90}) OR (w.throttled AND t.started_at < TS({AS_OF - 15}))) AND NOT EXISTS (SELECT 1 FROM tasks h WHERE h.hedged_from = t.id)"


def stragglers(e: Exchange, after: int, throttled_after: int) -> DataFrame:
    """Running primaries that take too long and have no hedge yet."""
    slow = e.workers.select(F.col("id").alias("worker_id"), "throttled")
    hedged = e.tasks.where("hedged_from IS NOT NULL").select(F.col("hedged_from").alias("id"))
    late = (F.col("started_at") < e.ago(after)) | (F.col("throttled") & (F.col("started_at") < e.ago(throttled_after)))
    return e.tasks.where("status = 'running' AND hedged_from IS NULL").join(slow, "worker_id").where(late).join(hedged, "id", "left_anti")


@query(f"SELECT t.id FROM tasks t JOIN workers w ON t.worker_id = w.id WHERE {_LATE} AND (SELECT count(*) FROM tasks h WHERE h.job_id = t.job_id AND h.hedged_from IS NOT NULL AND h.status IN ('queued', 'running')) < 4")
def sw_straggler(e: Exchange, most: int = 4) -> DataFrame:
    flying = e.tasks.where("hedged_from IS NOT NULL AND status IN ('queued', 'running')").groupBy("job_id").agg(F.count("*").alias("n"))
    return stragglers(e, 90, 15).join(flying, "job_id", "left").where(F.coalesce("n", F.lit(0)) < most).select("id")


@query(f"SELECT t.id FROM tasks t JOIN workers w ON t.worker_id = w.id WHERE t.status = 'running' AND t.hedged_from IS NULL AND t.started_at < TS({AS_OF - 10}) AND NOT EXISTS (SELECT 1 FROM tasks h WHERE h.hedged_from = t.id) AND NOT EXISTS (SELECT 1 FROM tasks q WHERE q.job_id = t.job_id AND q.status IN ('queued', 'retrying'))")
def sw_endgame(e: Exchange) -> DataFrame:
    waiting = e.tasks.where("status IN ('queued', 'retrying')").select("job_id")
    return stragglers(e, 10, 10).join(waiting, "job_id", "left_anti").select("id")


@query(f"SELECT t.id FROM tasks t WHERE t.status = 'running' AND t.started_at > TS({AS_OF} - 360) AND NOT EXISTS (SELECT 1 FROM model_state m WHERE m.worker_id = t.worker_id AND m.model_ref = '{EMBED}' AND m.last_warm_at > TS({AS_OF - 60}))")
def sw_cold(e: Exchange) -> DataFrame:
    """Young tasks on machines that are still loading the model: too early to call them late."""
    warm = e.model_state.where((F.col("model_ref") == EMBED) & (F.col("last_warm_at") > e.ago(60))).select("worker_id")
    return e.tasks.where((F.col("status") == "running") & (F.col("started_at") > e.ago(360))).join(warm, "worker_id", "left_anti").select("id")


@query(f"SELECT t.id FROM tasks t JOIN workers w ON t.worker_id = w.id WHERE t.status = 'running' AND t.started_at < TS({AS_OF - 300}) AND w.last_seen_at > TS({AS_OF - 60})")
def sw_no_peer(e: Exchange) -> DataFrame:
    live = e.workers.where(F.col("last_seen_at") > e.ago(60)).select(F.col("id").alias("worker_id"))
    return e.tasks.where((F.col("status") == "running") & (F.col("started_at") < e.ago(300))).join(live, "worker_id", "left_semi").select("id")


@query(f"SELECT j.id FROM jobs j WHERE j.status IN ('running', 'verifying') AND j.created_at < TS({AS_OF}) - to_seconds(CASE WHEN j.sla_secs IS NOT NULL THEN j.sla_secs WHEN j.eta_secs IS NOT NULL THEN CAST(ceil(j.eta_secs * 1.5::DOUBLE) AS BIGINT) + 120 ELSE 86400 END) AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.job_id = j.id AND t.completed_at > TS({AS_OF - 600}))")
def sw_stuck(e: Exchange) -> DataFrame:
    """Open jobs past their deadline (explicit, from the estimate, or a day) without recent progress."""
    limit = F.when(F.col("sla_secs").isNotNull(), F.col("sla_secs")).when(F.col("eta_secs").isNotNull(), F.ceil(F.col("eta_secs") * 1.5) + 120).otherwise(DAY)
    moving = e.tasks.where(F.col("completed_at") > e.ago(600)).select(F.col("job_id").alias("id"))
    return e.jobs.where(F.col("status").isin("running", "verifying") & (age("created_at") > limit)).join(moving, "id", "left_anti").select("id")


@query(f"SELECT t.id FROM tasks t JOIN workers w ON t.worker_id = w.id WHERE t.status = 'running' AND w.last_seen_at < TS({AS_OF - 100})")
def sw_dead_claim(e: Exchange, silent: int = 100) -> DataFrame:
    dead = e.workers.where(F.col("last_seen_at") < e.ago(silent)).select(F.col("id").alias("worker_id"))
    return e.tasks.where("status = 'running'").join(dead, "worker_id", "left_semi").select("id")


@query("SELECT j.id FROM jobs j JOIN (SELECT job_id, bool_and(status IN ('complete', 'failed')) AND bool_or(status = 'complete') AS done FROM tasks GROUP BY job_id) t ON t.job_id = j.id WHERE t.done AND j.status IN ('running', 'verifying')")
def sw_finalizable(e: Exchange) -> DataFrame:
    per = e.tasks.groupBy(F.col("job_id").alias("id")).agg((F.bool_and(F.col("status").isin("complete", "failed")) & F.bool_or(F.col("status") == "complete")).alias("done"))
    return e.jobs.where("status IN ('running', 'verifying')").join(per.where("done"), "id", "left_semi").select("id")


@query("SELECT id FROM jobs j WHERE status = 'complete' AND merged_at IS NOT NULL AND sla_secs IS NOT NULL AND NOT EXISTS (SELECT 1 FROM refunds r WHERE r.job_id = j.id) ORDER BY merged_at, id LIMIT 500")
def sw_sla_undecided(e: Exchange, most: int = 500) -> DataFrame:
    decided = e.refunds.select(F.col("job_id").alias("id"))
    return e.jobs.where("status = 'complete' AND merged_at IS NOT NULL AND sla_secs IS NOT NULL").join(decided, "id", "left_anti").orderBy("merged_at", "id").limit(most).select("id")


@query(f"SELECT id, worker_id FROM tasks WHERE hedged_from IS NOT NULL AND is_redundancy AND status = 'queued' AND created_at < TS({AS_OF - 120})")
def sw_pinned_tiebreak(e: Exchange) -> DataFrame:
    return e.tasks.where("hedged_from IS NOT NULL AND is_redundancy AND status = 'queued'").where(F.col("created_at") < e.ago(120)).select("id", "worker_id")


@query("SELECT t.id FROM tasks t WHERE t.status = 'verifying' AND NOT EXISTS (SELECT 1 FROM verifications v WHERE v.task_id = t.id)")
def sw_legacy_verify(e: Exchange) -> DataFrame:
    return e.tasks.where("status = 'verifying'").select("id").join(e.verifications.select(F.col("task_id").alias("id")), "id", "left_anti")


@query("SELECT id FROM tasks WHERE status = 'verifying' ORDER BY created_at, id LIMIT 50")
def sw_verification_claim(e: Exchange, most: int = 50) -> DataFrame:
    return e.tasks.where("status = 'verifying'").orderBy("created_at", "id").limit(most).select("id")


@query(f"SELECT h.id FROM webhooks h JOIN jobs j ON h.job_id = j.id WHERE h.state = 'pending' AND h.next_at <= TS({AS_OF}) AND j.status IN {FINISHED} ORDER BY h.next_at, h.id LIMIT 100")
def sw_webhook_claim(e: Exchange, most: int = 100) -> DataFrame:
    ended = e.jobs.where(f"status IN {FINISHED}").select(F.col("id").alias("job_id"))
    return e.webhooks.where((F.col("state") == "pending") & (F.col("next_at") <= e.as_of)).join(ended, "job_id", "left_semi").orderBy("next_at", "id").limit(most).select("id")


@query("SELECT id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 8 THEN 'dead' ELSE 'pending' END AS state, CASE WHEN attempts + 1 < 8 THEN CAST(least(3600, 30 * pow(2, attempts)) AS BIGINT) END AS wait_secs FROM webhooks WHERE state = 'pending'")
def sw_webhook_fail(e: Exchange, most: int = 8) -> DataFrame:
    last = F.col("attempts") + 1 >= most
    return e.webhooks.where("state = 'pending'").select("id", (F.col("attempts") + 1).alias("attempts"), F.when(last, "dead").otherwise("pending").alias("state"), F.when(~last, F.least(F.lit(3600.0), 30 * F.pow(F.lit(2.0), "attempts"))).cast("long").alias("wait_secs"))


@query(f"SELECT id FROM jobs WHERE charge_status = 'failed' AND created_at + to_seconds(least(greatest(charge_attempts, 1) * 1800, 21600)) <= TS({AS_OF}) ORDER BY created_at, id LIMIT 500")
def sw_charge_due(e: Exchange, most: int = 500) -> DataFrame:
    due = age("created_at") >= money.charge_retry_secs(F.col("charge_attempts"))
    return e.jobs.where((F.col("charge_status") == "failed") & due).orderBy("created_at", "id").limit(most).select("id")


@query("SELECT id, buyer_id FROM batches WHERE status = 'attempting' ORDER BY created_at, id LIMIT 200")
def sw_attempting(e: Exchange, most: int = 200) -> DataFrame:
    return e.batches.where("status = 'attempting'").orderBy("created_at", "id").limit(most).select("id", "buyer_id")


@query("SELECT id, payment_intent FROM disputes WHERE status = 'needs_response'")
def sw_disputes(e: Exchange) -> DataFrame:
    return e.disputes.where("status = 'needs_response'").select("id", "payment_intent")


@query(f"SELECT id FROM ledger WHERE payout_status = 'sending' AND created_at BETWEEN TS({AS_OF - 20 * DAY}) AND TS({AS_OF - DAY})")
def sw_outcome_unknown(e: Exchange) -> DataFrame:
    return e.ledger.where((F.col("payout_status") == "sending") & F.col("created_at").between(e.ago(20 * DAY), e.ago(DAY))).select("id")


@query(f"SELECT 'durations' AS name, count(*) AS gone FROM durations WHERE created_at < TS({AS_OF - 14 * DAY}) UNION ALL SELECT 'samples', count(*) FROM samples WHERE created_at < TS({AS_OF - 14 * DAY}) UNION ALL SELECT 'job_events', count(*) FROM job_events WHERE created_at < TS({AS_OF - 30 * DAY})")
def sw_retention(e: Exchange) -> DataFrame:
    gone = lambda df, name, days: df.where(F.col("created_at") < e.ago(days * DAY)).agg(F.count("*").alias("gone")).select(F.lit(name).alias("name"), "gone")
    return gone(e.durations, "durations", 14).unionByName(gone(e.samples, "samples", 14)).unionByName(gone(e.job_events, "job_events", 30))


@query("SELECT w.id AS worker_id, coalesce(s.seen, w.last_seen_at) AS seen_at, s.effective_gb FROM workers w LEFT JOIN (SELECT worker_id, max(created_at) AS seen, arg_max(effective_gb, {'a': created_at, 'b': id}) AS effective_gb FROM samples GROUP BY worker_id) s ON s.worker_id = w.id")
def sw_heartbeat(e: Exchange) -> DataFrame:
    latest = e.samples.groupBy("worker_id").agg(F.max("created_at").alias("seen"), F.max_by("effective_gb", F.struct("created_at", "id")).alias("effective_gb"))
    return e.workers.select(F.col("id").alias("worker_id"), "last_seen_at").join(latest, "worker_id", "left").select("worker_id", F.coalesce("seen", "last_seen_at").alias("seen_at"), "effective_gb")


@query(f"SELECT id, EPOCH({NOW}) - EPOCH(last_seen_at) > 90 AS stale FROM workers")
def sw_liveness(e: Exchange, interval: int = 30) -> DataFrame:
    return e.workers.select("id", (age("last_seen_at") > 3 * interval).alias("stale"))


@query("SELECT hour, errors, signups, errors * 1.0::DOUBLE / greatest(signups, 1) > 1.2 AS alert FROM (SELECT date_trunc('hour', ts) AS hour, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'signup') AS signups FROM events GROUP BY 1) x")
def sw_alerts(e: Exchange) -> DataFrame:
    per = e.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "signup").alias("signups"))
    return per.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "errors", "signups", (F.col("errors") / F.greatest("signups", F.lit(1)) > 1.2).alias("alert"))


# Transitions


@query("SELECT id, job_id, 'running' AS status FROM tasks WHERE status IN ('queued', 'retrying') AND hedged_from IS NULL AND retry_count < 3")
def tr_start(e: Exchange) -> DataFrame:
    return e.tasks.where("status IN ('queued', 'retrying') AND hedged_from IS NULL AND retry_count < 3").select("id", "job_id", F.lit("running").alias("status"))


@query("SELECT t.id, 'verifying' AS status, NOT EXISTS (SELECT 1 FROM tasks o WHERE o.job_id = t.job_id AND o.status IN ('queued', 'retrying')) AS job_verifying FROM tasks t WHERE t.status = 'running'")
def tr_commit(e: Exchange) -> DataFrame:
    open_ = e.tasks.where("status IN ('queued', 'retrying')").select("job_id", F.lit(True).alias("open")).distinct()
    return e.tasks.where("status = 'running'").join(open_, "job_id", "left").select("id", F.lit("verifying").alias("status"), F.col("open").isNull().alias("job_verifying"))


@query("SELECT id, CASE WHEN accepted THEN 'complete' WHEN retry_count < 3 THEN 'retrying' ELSE 'failed' END AS status, CASE WHEN NOT accepted AND retry_count < 3 THEN CAST(least(600.0, 30 * pow(2, retry_count)) AS BIGINT) END AS wait_secs FROM (SELECT t.id, t.retry_count, bool_and(v.kind NOT IN ('redundancy_mismatch', 'honeypot_fail')) AS accepted FROM tasks t JOIN verifications v ON v.task_id = t.id WHERE t.status = 'verifying' GROUP BY t.id, t.retry_count) x")
def tr_apply(e: Exchange) -> DataFrame:
    """Verdicts folded into the next state: one failed check sends a task back, or ends it after three retries."""
    good = e.verifications.groupBy(F.col("task_id").alias("id")).agg(F.bool_and(~F.col("kind").isin("redundancy_mismatch", "honeypot_fail")).alias("accepted"))
    again = ~F.col("accepted") & (F.col("retry_count") < 3)
    both = e.tasks.where("status = 'verifying'").join(good, "id")
    return both.select("id", F.when(F.col("accepted"), "complete").when(again, "retrying").otherwise("failed").alias("status"), F.when(again, money.requeue_secs(F.col("retry_count"))).alias("wait_secs"))


@query("SELECT root, id FROM (SELECT coalesce(hedged_from, id) AS root, id, row_number() OVER (PARTITION BY coalesce(hedged_from, id) ORDER BY completed_at, id) AS r FROM tasks WHERE status = 'complete' AND NOT is_redundancy) x WHERE r = 1")
def tr_hedge_fence(e: Exchange) -> DataFrame:
    """Of a task and its hedges only the first to finish settles."""
    done = e.tasks.where("status = 'complete' AND NOT is_redundancy").withColumn("root", F.coalesce("hedged_from", "id"))
    return first(done, ["root"], [F.asc("completed_at"), F.asc("id")]).select("root", "id")


@query("SELECT f.id, CASE WHEN f.class NOT IN ('bad_input', 'bad_jsonl', 'unsupported_model', 'unsupported_job_type', 'cancelled', 'verification_failed') AND f.retries < 3 THEN 'retrying' ELSE 'failed' END AS status, f.class IN ('bad_input', 'bad_jsonl', 'unsupported_model', 'unsupported_job_type') AS buyer_fault FROM failures f")
def tr_fail(e: Exchange) -> DataFrame:
    retry, fault = risk.failure_policy(F.col("class"))
    return e.failures.select("id", F.when(retry & (F.col("retries") < 3), "retrying").otherwise("failed").alias("status"), fault.alias("buyer_fault"))


@query("SELECT id, retry_count + 1 AS retry_count, CAST(least(600.0, 30 * pow(2, least(retry_count, 20))) AS BIGINT) AS wait_secs FROM tasks WHERE status = 'retrying'")
def tr_requeue(e: Exchange) -> DataFrame:
    return e.tasks.where("status = 'retrying'").select("id", (F.col("retry_count") + 1).alias("retry_count"), money.requeue_secs(F.col("retry_count")).alias("wait_secs"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'requeued' ELSE 'cancelled' END AS outcome FROM jobs WHERE status IN ('running', 'verifying') AND charge_attempts >= 4")
def tr_rescue_job(e: Exchange) -> DataFrame:
    """First strike requeues a stuck job's open work, the second cancels it and keeps what is done."""
    return e.jobs.where("status IN ('running', 'verifying') AND charge_attempts >= 4").select("id", F.when(F.col("id") % 2 == 0, "requeued").otherwise("cancelled").alias("outcome"))


@query("SELECT id, CASE WHEN status IN ('queued', 'cancelled') THEN 'cancelled' ELSE status END AS status, status NOT IN ('queued', 'cancelled') AS refused FROM jobs")
def tr_cancel(e: Exchange) -> DataFrame:
    """Only a queued job can be cancelled; a cancelled one stays so."""
    can = F.col("status").isin("queued", "cancelled")
    return e.jobs.select("id", F.when(can, "cancelled").otherwise(F.col("status")).alias("status"), (~can).alias("refused"))


@query("SELECT j.id, CAST(coalesce(c.charged, 0) + j.sla_premium_micros AS BIGINT) AS actual_micros FROM jobs j LEFT JOIN (SELECT job_id, -sum(amount_micros) AS charged FROM ledger WHERE kind = 'buyer_charge' GROUP BY job_id) c ON c.job_id = j.id WHERE j.status = 'complete'")
def tr_complete(e: Exchange) -> DataFrame:
    charged = e.ledger.where("kind = 'buyer_charge'").groupBy(F.col("job_id").alias("id")).agg((-F.sum("amount_micros")).alias("charged"))
    return e.jobs.where("status = 'complete'").join(charged, "id", "left").select("id", (F.coalesce("charged", F.lit(0)) + F.col("sla_premium_micros")).cast("long").alias("actual_micros"))


@query("SELECT j.id, CAST(coalesce(c.charged, 0) AS BIGINT) AS actual_micros FROM jobs j LEFT JOIN (SELECT job_id, -sum(amount_micros) AS charged FROM ledger WHERE kind = 'buyer_charge' GROUP BY job_id) c ON c.job_id = j.id WHERE j.status = 'failed'")
def tr_fail_settle(e: Exchange) -> DataFrame:
    charged = e.ledger.where("kind = 'buyer_charge'").groupBy(F.col("job_id").alias("id")).agg((-F.sum("amount_micros")).alias("charged"))
    return e.jobs.where("status = 'failed'").join(charged, "id", "left").select("id", F.coalesce("charged", F.lit(0)).cast("long").alias("actual_micros"))


_STEP = "CASE kind WHEN 'redundancy_match' THEN 0.001::DOUBLE WHEN 'honeypot_pass' THEN 0.002::DOUBLE WHEN 'redundancy_mismatch' THEN -0.1::DOUBLE WHEN 'honeypot_fail' THEN -0.15::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"WITH ev AS (SELECT supplier_id, list({_STEP} ORDER BY created_at, id, task_id) AS steps FROM verifications GROUP BY supplier_id) SELECT s.id, round(list_reduce(list_prepend(s.reputation, coalesce(ev.steps, [])), lambda a, d: greatest(0.0::DOUBLE, least(1.0::DOUBLE, a + d))), 9) AS reputation FROM suppliers s LEFT JOIN ev ON ev.supplier_id = s.id")
def tr_reputation(e: Exchange) -> DataFrame:
    """Reputation after its events in order, clamped at every step: the order decides, so the fold runs over the sorted list of a supplier's events."""
    step = F.when(F.col("kind") == "redundancy_match", 0.001).when(F.col("kind") == "honeypot_pass", 0.002).when(F.col("kind") == "redundancy_mismatch", -0.1).when(F.col("kind") == "honeypot_fail", -0.15).otherwise(0.0)
    events = e.verifications.groupBy(F.col("supplier_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("created_at", F.col("id").alias("i"), "task_id", step.alias("d")))).alias("ev"))
    fold = F.aggregate(F.coalesce("ev", F.array().cast(events.schema["ev"].dataType)), F.col("reputation"), lambda a, x: risk.clamp(a + x["d"]))
    return e.suppliers.select("id", "reputation").join(events, "id", "left").select("id", F.round(fold, 9).alias("reputation"))


@query("SELECT id, CASE WHEN status = 'banned' THEN 'banned' WHEN reputation <= 0 THEN 'banned' WHEN reputation < 0.2 THEN 'suspended' ELSE status END AS status FROM suppliers")
def tr_quarantine(e: Exchange) -> DataFrame:
    r = F.col("reputation")
    return e.suppliers.select("id", F.when((F.col("status") == "banned") | (r <= 0), "banned").when(r < 0.2, "suspended").otherwise(F.col("status")).alias("status"))


@query("SELECT id, job_id, sum(1) OVER (PARTITION BY job_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) <= 2 AS granted FROM tasks WHERE is_redundancy OR hedged_from IS NOT NULL")
def tr_reserve(e: Exchange, reserve: int = 2) -> DataFrame:
    """Extra tasks of a job draw on its reserve in order, as long as it lasts."""
    order = Window.partitionBy("job_id").orderBy("created_at", "id")
    return e.tasks.where("is_redundancy OR hedged_from IS NOT NULL").select("id", "job_id", (F.row_number().over(order) <= reserve).alias("granted"))


@query("SELECT t.id AS hedged_from, t.job_id, coalesce(t.chunk_index, 0) AS chunk, 'queued' AS status FROM tasks t WHERE t.status = 'running' AND t.hedged_from IS NULL AND NOT t.is_redundancy AND NOT EXISTS (SELECT 1 FROM tasks h WHERE h.hedged_from = t.id)")
def tr_hedge(e: Exchange) -> DataFrame:
    has = e.tasks.where("hedged_from IS NOT NULL").select(F.col("hedged_from").alias("id"))
    new = e.tasks.where("status = 'running' AND hedged_from IS NULL AND NOT is_redundancy").join(has, "id", "left_anti")
    return new.select(F.col("id").alias("hedged_from"), "job_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk"), F.lit("queued").alias("status"))


@query("SELECT DISTINCT v.task_id, v.job_id, v.chunk_index AS chunk FROM verifications v WHERE v.kind = 'redundancy_mismatch' AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.job_id = v.job_id AND coalesce(t.chunk_index, 0) = v.chunk_index AND t.hedged_from IS NOT NULL AND t.is_redundancy)")
def tr_tiebreak(e: Exchange) -> DataFrame:
    there = e.tasks.where("hedged_from IS NOT NULL AND is_redundancy").select("job_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"))
    return e.verifications.where("kind = 'redundancy_mismatch'").join(there, ["job_id", "chunk_index"], "left_anti").select("task_id", "job_id", F.col("chunk_index").alias("chunk")).distinct()


@query("SELECT id, CASE WHEN payout_status = 'held' AND s.payouts_enabled THEN 'sending' WHEN payout_status = 'held' THEN 'held' ELSE payout_status END AS payout_status FROM (SELECT * FROM ledger WHERE kind = 'supplier_credit') l JOIN (SELECT id AS sid, payouts_enabled FROM suppliers) s ON s.sid = l.supplier_id")
def tr_payout_claim(e: Exchange) -> DataFrame:
    able = e.suppliers.select(F.col("id").alias("supplier_id"), "payouts_enabled")
    goes = (F.col("payout_status") == "held") & F.col("payouts_enabled")
    return e.ledger.where("kind = 'supplier_credit'").join(able, "supplier_id").select("id", F.when(goes, "sending").otherwise(F.col("payout_status")).alias("payout_status"))


@query("SELECT id, CASE WHEN amount_micros < 10000 THEN 'carried' WHEN id % 5 = 0 THEN 'outcome_unknown' WHEN id % 11 = 0 THEN 'ready' ELSE 'released' END AS payout_status FROM ledger WHERE payout_status = 'sending'")
def tr_payout_final(e: Exchange) -> DataFrame:
    out = F.when(F.col("amount_micros") < 10_000, "carried").when(F.col("id") % 5 == 0, "outcome_unknown").when(F.col("id") % 11 == 0, "ready").otherwise("released")
    return e.ledger.where("payout_status = 'sending'").select("id", out.alias("payout_status"))


@query("SELECT supplier_id, CAST(floor(sum(amount_micros) / 10000) AS BIGINT) AS cents, CAST(sum(amount_micros) - floor(sum(amount_micros) / 10000) * 10000 AS BIGINT) AS rest_micros FROM ledger WHERE payout_status = 'ready' GROUP BY supplier_id")
def tr_minor_unit(e: Exchange) -> DataFrame:
    sums = e.ledger.where("payout_status = 'ready'").groupBy("supplier_id").agg(F.sum("amount_micros").alias("m"))
    cents, rest = money.split_cents(F.col("m"))
    return sums.select("supplier_id", cents.alias("cents"), rest.alias("rest_micros"))


@query("SELECT b.id, b.fee_micros FROM batches b WHERE b.status = 'charged' AND NOT EXISTS (SELECT 1 FROM refunds r WHERE r.job_id = b.id)")
def tr_fee(e: Exchange) -> DataFrame:
    return e.batches.where("status = 'charged'").select("id", "fee_micros").join(e.refunds.select(F.col("job_id").alias("id")), "id", "left_anti")


@query("SELECT j.id, 'charged' AS charge_status FROM jobs j JOIN batches b ON b.buyer_id = j.buyer_id WHERE b.status = 'charged' AND j.charge_status = 'deferred'")
def tr_batch_charged(e: Exchange) -> DataFrame:
    paid = e.batches.where("status = 'charged'").select("buyer_id")
    return e.jobs.where("charge_status = 'deferred'").join(paid, "buyer_id", "left_semi").select("id", F.lit("charged").alias("charge_status"))


@query("SELECT j.id, 'deferred' AS charge_status FROM jobs j WHERE j.charge_status = 'no_payment_method' AND j.buyer_id IN (SELECT id FROM buyers WHERE has_payment_method)")
def tr_reflip(e: Exchange) -> DataFrame:
    able = e.buyers.where("has_payment_method").select(F.col("id").alias("buyer_id"))
    return e.jobs.where("charge_status = 'no_payment_method'").join(able, "buyer_id", "left_semi").select("id", F.lit("deferred").alias("charge_status"))


@query("SELECT payment_intent, max(event_created) AS newest, count(DISTINCT id) AS events, arg_max(status, {'a': event_created, 'b': id}) AS status FROM disputes GROUP BY payment_intent")
def tr_cash_event(e: Exchange) -> DataFrame:
    """Events applied once each, whatever their order of arrival: the newest wins."""
    return e.disputes.dropDuplicates(["id"]).groupBy("payment_intent").agg(F.max("event_created").alias("newest"), F.count("*").alias("events"), F.max_by("status", F.struct("event_created", "id")).alias("status"))


@query("SELECT id, sum(amount_micros) OVER (PARTITION BY supplier_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) <= 500000 AS authorized FROM ledger WHERE payout_status = 'held'")
def tr_subsidy(e: Exchange, fund: int = 500_000) -> DataFrame:
    upto = Window.partitionBy("supplier_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return e.ledger.where("payout_status = 'held'").select("id", (F.sum("amount_micros").over(upto) <= fund).alias("authorized"))


@query("SELECT w.id, b.eps, b.tps FROM workers w LEFT JOIN (SELECT worker_id, max(eps) AS eps, max(tps) AS tps FROM benchmarks GROUP BY worker_id) b ON b.worker_id = w.id")
def tr_worker_upsert(e: Exchange) -> DataFrame:
    rates = e.benchmarks.groupBy(F.col("worker_id").alias("id")).agg(F.max("eps").alias("eps"), F.max("tps").alias("tps"))
    return e.workers.select("id").join(rates, "id", "left")


@query("SELECT d.id, CASE WHEN d.status = 'needs_response' AND c.received_cents > 0 THEN 'reverify' WHEN d.status = 'lost' THEN 'resolved_lost' WHEN d.status = 'won' THEN 'resolved_won' ELSE 'open' END AS action FROM disputes d JOIN collections c ON c.payment_intent = d.payment_intent")
def tr_dispute(e: Exchange) -> DataFrame:
    both = e.disputes.select("id", "status", "payment_intent").join(e.collections.select("payment_intent", "received_cents"), "payment_intent")
    action = F.when((F.col("status") == "needs_response") & (F.col("received_cents") > 0), "reverify").when(F.col("status") == "lost", "resolved_lost").when(F.col("status") == "won", "resolved_won").otherwise("open")
    return both.select("id", action.alias("action"))



@query("""SELECT id, was, kind AS becomes FROM (SELECT id, CASE kind WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'verifying' WHEN 'error' THEN 'failed' ELSE 'complete' END AS kind,
    lag(CASE kind WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'verifying' WHEN 'error' THEN 'failed' ELSE 'complete' END) OVER (PARTITION BY job_id ORDER BY created_at, id) AS was FROM job_events) x
    WHERE was IS NOT NULL AND NOT EXISTS (SELECT 1 FROM transitions t WHERE t.entity = 'job' AND t.was = x.was AND t.becomes = x.kind)""")
def va_transition(e: Exchange) -> DataFrame:
    """State changes that the transition relation does not allow."""
    state = F.when(F.col("kind") == "view", "queued").when(F.col("kind") == "signup", "running").when(F.col("kind") == "purchase", "verifying").when(F.col("kind") == "error", "failed").otherwise("complete")
    order = Window.partitionBy("job_id").orderBy("created_at", "id")
    changes = e.job_events.select("id", "job_id", "created_at", state.alias("becomes")).withColumn("was", F.lag("becomes").over(order)).where("was IS NOT NULL")
    allowed = F.broadcast(e.transitions.where("entity = 'job'").select("was", "becomes"))  # a literal relation of a few rows
    return changes.join(allowed, ["was", "becomes"], "left_anti").select("id", "was", "becomes")


@query("SELECT l.id FROM ledger l JOIN tasks t ON l.task_id = t.id JOIN jobs j ON t.job_id = j.id WHERE l.buyer_id IS DISTINCT FROM j.buyer_id OR l.job_id IS DISTINCT FROM t.job_id")
def va_binding(e: Exchange) -> DataFrame:
    """Ledger rows that do not match the frozen facts of their task; none in sound books."""
    facts = e.tasks.select(F.col("id").alias("task_id"), F.col("job_id").alias("j")).join(e.jobs.select(F.col("id").alias("j"), F.col("buyer_id").alias("b")), "j")
    return e.ledger.join(facts, "task_id").where(~F.col("buyer_id").eqNullSafe(F.col("b")) | ~F.col("job_id").eqNullSafe(F.col("j"))).select("id")
