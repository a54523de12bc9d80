"""Filters, joins, first-per-group, top-k, set and lookup queries of the exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.entities import AS_OF, Exchange
from ..plans.registry import query
from ..plans.storage import written as saved
from .aggregates import FIRM, LIVE, claimable, firm_charges, live_workers

FINISHED = "('complete', 'failed', 'cancelled')"
EMBED = "all-minilm-l6-v2"


def first(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in a total order; null order is the caller's to spell out."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


# Filters and projections


@query(f"SELECT w.id, w.supplier_id, w.hw_class FROM {LIVE} w")
def flt_live_worker(e: Exchange) -> DataFrame:
    return live_workers(e).select("id", "supplier_id", "hw_class")


@query("SELECT id, hw_class FROM workers w WHERE EXISTS (SELECT 1 FROM benchmarks b WHERE b.worker_id = w.id AND b.job_type = 'embed' AND b.model_ref = 'all-minilm-l6-v2')")
def flt_exact_capability(e: Exchange) -> DataFrame:
    able = e.benchmarks.where((F.col("job_type") == "embed") & (F.col("model_ref") == EMBED)).select(F.col("worker_id").alias("id"))
    return e.workers.join(able, "id", "left_semi").select("id", "hw_class")


@query(f"SELECT id, job_id FROM tasks t WHERE t.status IN ('queued', 'retrying') AND coalesce(t.visible_at, t.created_at) <= TS({AS_OF}) AND (t.hedged_from IS NULL OR t.worker_id % 2 = 0)")
def flt_visible_task(e: Exchange) -> DataFrame:
    return claimable(e).where("hedged_from IS NULL OR worker_id % 2 = 0").select("id", "job_id")


@query(f"SELECT t.id, t.worker_id FROM tasks t WHERE t.status = 'retrying' AND NOT (t.retry_count > 2 AND coalesce(t.visible_at > TS({AS_OF - 60}), false))")
def flt_worker_exclusion(e: Exchange) -> DataFrame:
    excluded = (F.col("retry_count") > 2) & F.coalesce(F.col("visible_at") > e.ago(60), F.lit(False))
    return e.tasks.where((F.col("status") == "retrying") & ~excluded).select("id", "worker_id")




@query("SELECT j.id AS job_id, w.hw_class, count(*) AS workers FROM jobs j JOIN workers w ON w.id = j.id % 200 WHERE (CASE WHEN j.id % 3 = 0 THEN NULL WHEN j.id % 3 = 1 THEN ['pro', 'max'] ELSE ['cpu'] END) IS NULL OR list_contains(CASE WHEN j.id % 3 = 0 THEN NULL WHEN j.id % 3 = 1 THEN ['pro', 'max'] ELSE ['cpu'] END, w.hw_class) GROUP BY j.id, w.hw_class")
def flt_list_membership(e: Exchange) -> DataFrame:
    """A null list is no restriction."""
    allowed = F.when(F.col("id") % 3 == 1, F.array(F.lit("pro"), F.lit("max"))).when(F.col("id") % 3 == 2, F.array(F.lit("cpu")))
    jobs = e.jobs.select(F.col("id").alias("job_id"), (F.col("id") % 200).alias("id"), allowed.alias("allowed"))
    return jobs.join(e.workers.select("id", "hw_class"), "id").where(F.col("allowed").isNull() | F.array_contains("allowed", F.col("hw_class"))).groupBy("job_id", "hw_class").agg(F.count("*").alias("workers"))


@query("SELECT id, status, reputation FROM suppliers WHERE reputation < 0.5 OR status <> 'active'")
def flt_fraud_flags(e: Exchange) -> DataFrame:
    return e.suppliers.where("reputation < 0.5 OR status <> 'active'").select("id", "status", "reputation").orderBy("reputation", "id")


@query("SELECT item_id, sha256(text) AS answer_sha256 FROM benchmark WHERE item_id % 4 <> 0 AND length(text) <= 300 AND text NOT LIKE 'jobs/%' ORDER BY item_id LIMIT 20")
def flt_seed_honeypots(e: Exchange, most: int = 20) -> DataFrame:
    usable = e.benchmark.where((F.col("item_id") % 4 != 0) & (F.length("text") <= 300) & ~F.col("text").startswith("jobs/"))
    return usable.orderBy("item_id").limit(most).select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("answer_sha256"))


@query("SELECT j.id FROM jobs j WHERE EXISTS (SELECT 1 FROM models m WHERE m.id = j.model_ref AND m.job_type = j.job_type)")
def flt_advertised(e: Exchange) -> DataFrame:
    cells = e.models.select(F.col("id").alias("model_ref"), "job_type")
    return e.jobs.join(F.broadcast(cells), ["model_ref", "job_type"], "left_semi").select("id")  # cells: one row per advertised pair


@query("SELECT w.id, CASE WHEN w.throttled THEN 'throttled' WHEN w.thermal_degraded THEN 'thermal' WHEN w.effective_gb < 4 THEN 'memory' WHEN s.status <> 'active' THEN 'supplier' ELSE 'ok' END AS reason FROM workers w JOIN suppliers s ON w.supplier_id = s.id")
def prj_case_classify(e: Exchange) -> DataFrame:
    reason = F.when(F.col("throttled"), "throttled").when(F.col("thermal_degraded"), "thermal").when(F.col("effective_gb") < 4, "memory").when(F.col("status") != "active", "supplier").otherwise("ok")
    return e.workers.join(e.suppliers.select(F.col("id").alias("supplier_id"), "status"), "supplier_id").select("id", reason.alias("reason"))


@query(f"SELECT j.id, CAST({FIRM} AS BIGINT) AS net_micros FROM jobs j LEFT JOIN refunds r ON r.job_id = j.id WHERE j.actual_micros IS NOT NULL")
def prj_firm_charge(e: Exchange) -> DataFrame:
    return firm_charges(e).where("actual_micros IS NOT NULL").select("id", "net_micros")


@query("SELECT id, coalesce(chunk_index, 0) AS chunk, nullif(retry_count, 0) AS retries FROM tasks")
def prj_null_default(e: Exchange) -> DataFrame:
    return e.tasks.select("id", F.coalesce("chunk_index", F.lit(0)).alias("chunk"), F.nullif("retry_count", F.lit(0)).alias("retries"))


# Joins


@query("SELECT j.id AS job_id, count(*) AS waiting FROM tasks t JOIN jobs j ON t.job_id = j.id WHERE t.status = 'queued' GROUP BY j.id")
def jn_inner_equi(e: Exchange) -> DataFrame:
    return e.tasks.where("status = 'queued'").join(e.jobs.select(F.col("id").alias("job_id")), "job_id").groupBy("job_id").agg(F.count("*").alias("waiting"))


@query("SELECT d.id, d.duration_ms, j.eta_secs FROM durations d LEFT JOIN jobs j ON d.job_id = j.id AND j.eta_secs > 100")
def jn_left_outer(e: Exchange) -> DataFrame:
    eta = e.jobs.where("eta_secs > 100").select(F.col("id").alias("job_id"), "eta_secs")
    return e.durations.join(eta, "job_id", "left").select("id", "duration_ms", "eta_secs")


@query("SELECT l.id, q.quoted_micros, r.refund_micros FROM ledger l LEFT JOIN quotes q ON q.job_id = l.job_id LEFT JOIN refunds r ON r.job_id = l.job_id WHERE l.kind = 'buyer_charge'")
def jn_left_multi(e: Exchange) -> DataFrame:
    charges = e.ledger.where("kind = 'buyer_charge'").select("id", "job_id")
    return charges.join(e.quotes.select("job_id", "quoted_micros"), "job_id", "left").join(e.refunds.select("job_id", "refund_micros"), "job_id", "left").drop("job_id")


@query("SELECT s.id, s.status, coalesce(c.n, 0) AS clawbacks FROM suppliers s LEFT JOIN (SELECT t.supplier_id, count(*) AS n FROM ledger l JOIN tasks t ON l.task_id = t.id WHERE l.kind = 'clawback' GROUP BY t.supplier_id) c ON c.supplier_id = s.id")
def jn_left_subagg(e: Exchange) -> DataFrame:
    owner = e.tasks.select(F.col("id").alias("task_id"), F.col("supplier_id").alias("id"))
    per = e.ledger.where("kind = 'clawback'").select("task_id").join(owner, "task_id").groupBy("id").agg(F.count("*").alias("n"))
    return e.suppliers.join(per, "id", "left").select("id", "status", F.coalesce("n", F.lit(0)).alias("clawbacks"))


@query("SELECT w.id, avg(s.effective_gb) AS avg_gb, count(s.id) AS samples FROM workers w LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY created_at DESC, id DESC) AS r FROM samples) s ON s.worker_id = w.id AND s.r <= 20 GROUP BY w.id")
def jn_lateral_topk(e: Exchange, last: int = 20) -> DataFrame:
    newest = Window.partitionBy("worker_id").orderBy(F.desc("created_at"), F.desc("id"))
    some = e.samples.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= last).groupBy(F.col("worker_id").alias("id")).agg(F.avg("effective_gb").alias("avg_gb"), F.count("*").alias("n"))
    return e.workers.select("id").join(some, "id", "left").select("id", "avg_gb", F.coalesce("n", F.lit(0)).alias("samples"))


@query("SELECT j.id, min(h.id) AS webhook_id FROM jobs j LEFT JOIN webhooks h ON h.job_id = j.id GROUP BY j.id")
def jn_lateral_first(e: Exchange) -> DataFrame:
    per = e.webhooks.groupBy(F.col("job_id").alias("id")).agg(F.min("id").alias("webhook_id"))
    return e.jobs.select("id").join(per, "id", "left")


_NEWEST = "(SELECT *, row_number() OVER (PARTITION BY worker_id, job_type, model_ref ORDER BY created_at DESC, id) AS r FROM benchmarks)"


@query(f"SELECT w.id, b.job_type, b.id AS benchmark_id FROM workers w JOIN {_NEWEST} b ON b.worker_id = w.id AND b.r = 1")
def jn_lateral_cross1(e: Exchange) -> DataFrame:
    newest = first(e.benchmarks, ["worker_id", "job_type", "model_ref"], [F.desc("created_at"), F.asc("id")])
    return e.workers.select("id").join(newest.select(F.col("worker_id").alias("id"), "job_type", F.col("id").alias("benchmark_id")), "id")


@query("SELECT j.id AS job_id, w.id AS worker_id FROM jobs j JOIN workers w ON w.id = 42 WHERE j.status = 'running' AND j.min_memory_gb <= w.effective_gb")
def jn_cross(e: Exchange, worker: int = 42) -> DataFrame:
    """Running jobs against the one worker that asks: a single broadcast row."""
    me = e.workers.where(F.col("id") == worker).select(F.col("id").alias("worker_id"), "effective_gb").limit(1)
    return e.jobs.where("status = 'running'").join(F.broadcast(me), F.col("min_memory_gb") <= F.col("effective_gb")).select(F.col("id").alias("job_id"), "worker_id")


@query(f"SELECT s.status, w.hw_class, count(*) AS tasks FROM tasks t JOIN workers w ON w.id = 42 JOIN suppliers s ON s.id = w.supplier_id WHERE t.status IN ('queued', 'retrying') AND coalesce(t.visible_at, t.created_at) <= TS({AS_OF}) GROUP BY s.status, w.hw_class")
def jn_comma_cross(e: Exchange, worker: int = 42) -> DataFrame:
    me = e.workers.where(F.col("id") == worker).join(e.suppliers.select(F.col("id").alias("supplier_id"), "status"), "supplier_id").select(F.col("status").alias("s"), "hw_class").limit(1)
    return claimable(e).agg(F.count("*").alias("tasks")).where("tasks > 0").join(F.broadcast(me), F.lit(True)).select(F.col("s").alias("status"), "hw_class", "tasks")


@query("""SELECT id, peer_id, peer_supplier FROM (SELECT a.id, b.id AS peer_id, b.supplier_id AS peer_supplier, row_number() OVER (PARTITION BY a.id ORDER BY b.completed_at, b.id) AS r FROM tasks a JOIN tasks b ON a.job_id = b.job_id AND a.input_ref = b.input_ref AND a.id <> b.id WHERE b.status = 'complete') x WHERE r = 1""")
def jn_self_chunk(e: Exchange) -> DataFrame:
    peers = e.tasks.where("status = 'complete'").select("job_id", "input_ref", F.col("id").alias("peer_id"), F.col("supplier_id").alias("peer_supplier"), F.col("completed_at").alias("done"))
    pairs = e.tasks.select("id", "job_id", "input_ref").join(peers, ["job_id", "input_ref"]).where("id <> peer_id")
    return first(pairs, ["id"], [F.asc("done"), F.asc("peer_id")]).select("id", "peer_id", "peer_supplier")


_PRIMARY = "SELECT job_id, coalesce(chunk_index, 0) AS chunk, id, row_number() OVER (PARTITION BY job_id, coalesce(chunk_index, 0) ORDER BY completed_at NULLS LAST, id) AS r FROM tasks WHERE NOT is_redundancy AND NOT is_honeypot"
_RESOLVED = "SELECT job_id, chunk_index AS chunk, task_id, row_number() OVER (PARTITION BY job_id, chunk_index ORDER BY CASE kind WHEN 'tiebreak_win' THEN 0 ELSE 1 END, created_at DESC, id, task_id) AS r FROM verifications WHERE kind IN ('tiebreak_win', 'redundancy_match')"


def primary_results(e: Exchange) -> DataFrame:
    own = e.tasks.where("NOT is_redundancy AND NOT is_honeypot").withColumn("chunk", F.coalesce("chunk_index", F.lit(0)))
    return first(own, ["job_id", "chunk"], [F.col("completed_at").asc_nulls_last(), F.asc("id")]).select("job_id", "chunk", "id")


def resolutions(e: Exchange) -> DataFrame:
    """Per chunk: a majority before a provisional result, then the newest."""
    own = e.verifications.where("kind IN ('tiebreak_win', 'redundancy_match')").withColumnRenamed("chunk_index", "chunk")
    return first(own, ["job_id", "chunk"], [F.when(F.col("kind") == "tiebreak_win", 0).otherwise(1), F.desc("created_at"), F.asc("id"), F.asc("task_id")]).select("job_id", "chunk", F.col("task_id").alias("resolved_id"))


@query(f"SELECT p.job_id, p.chunk, coalesce(v.task_id, p.id) AS source_id FROM ({_PRIMARY}) p LEFT JOIN ({_RESOLVED}) v ON p.job_id = v.job_id AND p.chunk = v.chunk AND v.r = 1 WHERE p.r = 1")
def jn_self_using(e: Exchange) -> DataFrame:
    return primary_results(e).join(resolutions(e), ["job_id", "chunk"], "left").select("job_id", "chunk", F.coalesce("resolved_id", "id").alias("source_id"))


@query(f"SELECT w.id, EXISTS (SELECT 1 FROM model_state m WHERE m.worker_id = w.id AND m.last_warm_at > TS({AS_OF - 60})) AS warm FROM workers w")
def jn_semi_exists(e: Exchange) -> DataFrame:
    warm = e.model_state.where(F.col("last_warm_at") > e.ago(60)).select(F.col("worker_id").alias("id"), F.lit(True).alias("warm")).distinct()
    return e.workers.select("id").join(warm, "id", "left").select("id", F.coalesce("warm", F.lit(False)).alias("warm"))


_FINALIZABLE = "SELECT j.id FROM jobs j WHERE j.status IN ('running', 'verifying') AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.job_id = j.id AND t.status NOT IN ('complete', 'failed')) AND EXISTS (SELECT 1 FROM tasks t WHERE t.job_id = j.id AND t.status = 'complete')"


@query(_FINALIZABLE)
def jn_anti_not_exists(e: Exchange) -> DataFrame:
    open_ = e.tasks.where("status NOT IN ('complete', 'failed')").select(F.col("job_id").alias("id"))
    done = e.tasks.where("status = 'complete'").select(F.col("job_id").alias("id"))
    return e.jobs.where("status IN ('running', 'verifying')").select("id").join(open_, "id", "left_anti").join(done, "id", "left_semi")


@query("SELECT a.id FROM tasks a WHERE a.status IN ('queued', 'retrying') AND NOT EXISTS (SELECT 1 FROM tasks b WHERE b.job_id = a.job_id AND b.input_ref = a.input_ref AND b.id <> a.id AND b.status = 'complete' AND (b.worker_id = a.worker_id OR b.supplier_id = a.supplier_id))")
def jn_anti_or(e: Exchange) -> DataFrame:
    """Two equi anti-joins instead of one with an OR, which could only loop."""
    done = e.tasks.where("status = 'complete'").select("job_id", "input_ref", "worker_id", "supplier_id")
    waiting = e.tasks.where("status IN ('queued', 'retrying')")
    return waiting.join(done.drop("supplier_id"), ["job_id", "input_ref", "worker_id"], "left_anti").join(done.drop("worker_id"), ["job_id", "input_ref", "supplier_id"], "left_anti").select("id")


RANK = "CASE {} WHEN 'cpu' THEN 0 WHEN 'base' THEN 1 WHEN 'pro' THEN 2 WHEN 'max' THEN 3 ELSE 0 END"


def hw_rank(c):
    """Cost rank of a hardware class; an unknown one ranks 0."""
    return F.when(c == "base", 1).when(c == "pro", 2).when(c == "max", 3).otherwise(0)


@query(f"SELECT j.id, EXISTS (SELECT 1 FROM {LIVE} w WHERE w.effective_gb >= j.min_memory_gb AND {RANK.format('w.hw_class')} < 2) AS cheaper FROM jobs j WHERE j.status = 'queued'")
def jn_theta_cheaper(e: Exchange) -> DataFrame:
    """Is there a live worker of a cheaper class with the memory: the most memory of such workers decides all jobs."""
    most = live_workers(e).where(hw_rank(F.col("hw_class")) < 2).agg(F.max("effective_gb").alias("most"))
    return e.jobs.where("status = 'queued'").crossJoin(F.broadcast(most)).select("id", F.coalesce(F.col("most") >= F.col("min_memory_gb"), F.lit(False)).alias("cheaper"))


@query("SELECT w.id, (SELECT b.p99_ms FROM benchmarks b WHERE b.worker_id = w.id ORDER BY b.created_at DESC, b.id LIMIT 1) AS p99_ms FROM workers w")
def jn_scalar_corr(e: Exchange) -> DataFrame:
    latest = e.benchmarks.groupBy(F.col("worker_id").alias("id")).agg(F.max_by("p99_ms", F.struct("created_at", -F.col("id"))).alias("p99_ms"))
    return e.workers.select("id").join(latest, "id", "left")


@query("SELECT l.id, l.amount_micros FROM ledger l WHERE l.task_id IN (SELECT id FROM tasks WHERE is_redundancy)")
def jn_in_subquery(e: Exchange) -> DataFrame:
    return e.ledger.join(e.tasks.where("is_redundancy").select(F.col("id").alias("task_id")), "task_id", "left_semi").select("id", "amount_micros")


@query("SELECT DISTINCT model_ref FROM model_state WHERE model_ref NOT IN (SELECT id FROM models WHERE job_type = 'embed')")
def jn_not_in(e: Exchange) -> DataFrame:
    wanted = e.models.where("job_type = 'embed'").select(F.col("id").alias("model_ref"))
    return e.model_state.select("model_ref").distinct().join(wanted, "model_ref", "left_anti")


@query("""SELECT j.id AS job_id, x.buyer_id AS owner FROM jobs j JOIN (SELECT *, count(*) OVER (PARTITION BY buyer_id) AS nb FROM (SELECT id, buyer_id FROM jobs WHERE status = 'queued') q) x ON x.id = j.id WHERE x.nb = 1""")
def jn_update_from(e: Exchange) -> DataFrame:
    """Backfill an owner only where the match is one to one."""
    waiting = e.jobs.where("status = 'queued'").select("id", "buyer_id").withColumn("nb", F.count("*").over(Window.partitionBy("buyer_id"))).where("nb = 1")
    return waiting.select(F.col("id").alias("job_id"), F.col("buyer_id").alias("owner"))


@query("SELECT task_id, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY task_id, kind ORDER BY created_at, id) AS r FROM verifications) x WHERE r = 1")
def jn_delete_using(e: Exchange) -> DataFrame:
    return first(e.verifications, ["task_id", "kind"], [F.asc("created_at"), F.asc("id")]).select("task_id", "kind", "id")


# Windows


@query("SELECT id, payment_intent, CAST(greatest(0, least(amount_cents, sum(amount_cents) OVER (PARTITION BY payment_intent ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) - 1000)) AS BIGINT) AS exposed_cents FROM fundings")
def wn_running_exposure(e: Exchange, available: int = 1_000) -> DataFrame:
    """What each reservation lacks once earlier ones of its payment have drawn on the available cash."""
    upto = Window.partitionBy("payment_intent").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return e.fundings.select("id", "payment_intent", F.greatest(F.lit(0), F.least("amount_cents", F.sum("amount_cents").over(upto) - available)).alias("exposed_cents"))


@query("SELECT id, buyer_id, url FROM (SELECT *, row_number() OVER (PARTITION BY buyer_id, url ORDER BY CASE state WHEN 'delivered' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, id) AS r FROM webhooks) x WHERE r = 1")
def wn_row_number_dedupe(e: Exchange) -> DataFrame:
    rank = F.when(F.col("state") == "delivered", 0).when(F.col("state") == "pending", 1).otherwise(2)
    return first(e.webhooks, ["buyer_id", "url"], [rank, F.asc("id")]).select("id", "buyer_id", "url")


@query("SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY job_id, worker_id) AS a, count(*) OVER (PARTITION BY job_id, supplier_id) AS b FROM tasks) x WHERE a = 1 AND b = 1")
def wn_count_over(e: Exchange) -> DataFrame:
    counts = [F.count("*").over(Window.partitionBy("job_id", c)).alias(c) for c in ("worker_id", "supplier_id")]
    return e.tasks.select("id", *counts).where("worker_id = 1 AND supplier_id = 1").select("id")


@query(f"SELECT job_id, chunk, id FROM ({_PRIMARY}) x WHERE r = 1")
def wn_distinct_on_primary(e: Exchange) -> DataFrame:
    return primary_results(e)


@query(f"SELECT job_id, chunk, task_id AS resolved_id FROM ({_RESOLVED}) x WHERE r = 1")
def wn_distinct_on_resolution(e: Exchange) -> DataFrame:
    return resolutions(e)


@query("SELECT worker_id, id, effective_gb FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY created_at DESC, id DESC) AS r FROM samples) x WHERE r = 1")
def wn_distinct_on_latest(e: Exchange) -> DataFrame:
    return e.samples.groupBy("worker_id").agg(F.max_by(F.struct("id", "effective_gb"), F.struct("created_at", "id")).alias("s")).select("worker_id", "s.*")


@query("SELECT task_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC, id DESC) AS r FROM verifications) x WHERE r = 1")
def wn_latest_scalar(e: Exchange) -> DataFrame:
    return e.verifications.groupBy("task_id").agg(F.max_by("kind", F.struct("created_at", "id")).alias("kind"))


@query("SELECT worker_id, avg(effective_gb) AS avg_gb FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY created_at DESC, id DESC) AS r FROM samples) x WHERE r <= 20 GROUP BY worker_id")
def wn_last_n_avg(e: Exchange, last: int = 20) -> DataFrame:
    newest = Window.partitionBy("worker_id").orderBy(F.desc("created_at"), F.desc("id"))
    return e.samples.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= last).groupBy("worker_id").agg(F.avg("effective_gb").alias("avg_gb"))


@query("SELECT bucket, CAST(sum(n) OVER (ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM (SELECT least(CAST(floor(duration_ms / 50000) AS BIGINT), 8) AS bucket, count(*) AS n FROM durations GROUP BY 1) x")
def wn_cumulative_hist(e: Exchange) -> DataFrame:
    per = e.durations.groupBy(F.least(F.floor(F.col("duration_ms") / 50_000), F.lit(8)).alias("bucket")).agg(F.count("*").alias("n"))
    return per.select("bucket", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))  # nine rows


@query("SELECT job_id, chunk, CAST(coalesce(sum(n) OVER (PARTITION BY job_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM (SELECT job_id, coalesce(chunk_index, 0) AS chunk, count(*) * 3 AS n FROM tasks WHERE status = 'complete' GROUP BY 1, 2) x")
def wn_index_rebase(e: Exchange) -> DataFrame:
    """Records of earlier chunks of a job: where each chunk's global index starts."""
    per = e.tasks.where("status = 'complete'").groupBy("job_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk")).agg((F.count("*") * 3).alias("n"))
    before = Window.partitionBy("job_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("job_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


# Top-k


@query(f"SELECT id, job_id FROM (SELECT t.id, t.job_id, (t.hedged_from IS NOT NULL) AS pin, j.tier, t.retry_count, t.charge_micros, t.created_at FROM tasks t JOIN jobs j ON t.job_id = j.id WHERE t.status IN ('queued', 'retrying') AND coalesce(t.visible_at, t.created_at) <= TS({AS_OF}) AND j.status IN ('queued', 'running')) x ORDER BY pin DESC, CASE tier WHEN 'priority' THEN 0 WHEN 'express' THEN 1 ELSE 2 END, retry_count DESC, charge_micros DESC, created_at, id LIMIT 1")
def tk_claim_order(e: Exchange) -> DataFrame:
    jobs = e.jobs.where("status IN ('queued', 'running')").select(F.col("id").alias("job_id"), "tier")
    lane = F.when(F.col("tier") == "priority", 0).when(F.col("tier") == "express", 1).otherwise(2)
    return claimable(e).join(jobs, "job_id").orderBy(F.col("hedged_from").isNotNull().desc(), lane, F.desc("retry_count"), F.desc("charge_micros"), "created_at", "id").limit(1).select("id", "job_id")


SCORE = "w.reputation * w.tps * CASE WHEN w.id % 2 = 0 THEN 1.05 ELSE 1.0 END * CASE WHEN w.thermal_degraded THEN 0.7 ELSE 1.0 END"


def match_score(warm):
    """Reputation times rate, a little more if warm, less if hot."""
    return F.col("reputation") * F.col("tps") * F.when(warm, 1.05).otherwise(1.0) * F.when(F.col("thermal_degraded"), 0.7).otherwise(1.0)


_SCORED = f"(SELECT w.id, w.hw_class, {SCORE} AS score FROM {LIVE} w WHERE w.effective_gb >= 4)"


@query(f"SELECT id, hw_class, score FROM {_SCORED} s WHERE hw_class = (SELECT hw_class FROM {_SCORED} t ORDER BY score DESC, id LIMIT 1)")
def tk_match(e: Exchange, least_gb: float = 4) -> DataFrame:
    """All workers of the class that the best one belongs to, so that results stay comparable."""
    scored = live_workers(e).where(F.col("effective_gb") >= least_gb).select("id", "hw_class", match_score(F.col("id") % 2 == 0).alias("score"))
    best = scored.orderBy(F.desc("score"), "id").limit(1).select("hw_class")
    return scored.join(F.broadcast(best), "hw_class", "left_semi").select("id", "hw_class", "score")


@query(f"SELECT w.id, row_number() OVER (ORDER BY (w.id % 2 = 0) DESC, w.tps DESC, w.id) AS rank FROM {LIVE} w ORDER BY rank LIMIT 50")
def tk_peer_rank(e: Exchange, most: int = 50) -> DataFrame:
    top = live_workers(e).select("id", (F.col("id") % 2 == 0).alias("warm"), "tps").orderBy(F.desc("warm"), F.desc("tps"), "id").limit(most)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("warm"), F.desc("tps"), "id")).alias("rank"))


@query("SELECT id, supplier_id, amount_micros FROM ledger WHERE kind = 'supplier_credit' AND payout_status = 'held' ORDER BY created_at, id LIMIT 100")
def tk_due_payouts(e: Exchange, most: int = 100) -> DataFrame:
    return e.ledger.where("kind = 'supplier_credit' AND payout_status = 'held'").orderBy("created_at", "id").limit(most).select("id", "supplier_id", "amount_micros")


@query("SELECT id, status, created_at FROM jobs ORDER BY created_at DESC, id DESC LIMIT 200")
def tk_recent_jobs(e: Exchange, most: int = 200) -> DataFrame:
    return e.jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(most).select("id", "status", "created_at")


@query("SELECT id, job_id, kind FROM job_events ORDER BY created_at DESC, id DESC LIMIT 200")
def tk_admin_actions(e: Exchange, most: int = 200) -> DataFrame:
    return e.job_events.orderBy(F.desc("created_at"), F.desc("id")).limit(most).select("id", "job_id", "kind")


@query("SELECT m.id, m.job_type, m.price_per_1k, count(j.id) AS jobs, row_number() OVER (ORDER BY m.price_per_1k, m.id) AS place FROM models m LEFT JOIN jobs j ON j.model_ref = m.id GROUP BY m.id, m.job_type, m.price_per_1k")
def tk_models(e: Exchange) -> DataFrame:
    """The advertised models by price, each with the jobs that ask for it."""
    asked = e.jobs.groupBy(F.col("model_ref").alias("id")).agg(F.count("*").alias("jobs"))
    place = F.row_number().over(Window.orderBy("price_per_1k", "id"))  # a row per model
    return e.models.join(asked, "id", "left").select("id", "job_type", "price_per_1k", F.coalesce("jobs", F.lit(0)).alias("jobs"), place.alias("place")).orderBy("place")


@query("SELECT task_id, job_id FROM (SELECT id AS task_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY sha256(concat(CAST(job_id AS VARCHAR), '/', CAST(id AS VARCHAR)))) AS r FROM tasks WHERE NOT is_redundancy) x WHERE r <= 2")
def tk_redundancy_pick(e: Exchange, k: int = 2) -> DataFrame:
    """k tasks of each job in the order of a hash, so that no supplier can tell from the position which are checked."""
    mark = F.sha2(F.concat_ws("/", "job_id", "id").cast("binary"), 256)
    ranked = e.tasks.where("NOT is_redundancy").withColumn("r", F.row_number().over(Window.partitionBy("job_id").orderBy(mark)))
    return ranked.where(F.col("r") <= k).select(F.col("id").alias("task_id"), "job_id")


@query("SELECT v.id, v.kind, j.buyer_id FROM job_events v JOIN jobs j ON v.job_id = j.id WHERE j.status = 'running'")
def tk_job_events(e: Exchange) -> DataFrame:
    own = e.jobs.where("status = 'running'").select(F.col("id").alias("job_id"), "buyer_id")
    return e.job_events.join(own, "job_id").orderBy("created_at", "id").select("id", "kind", "buyer_id")


@query("SELECT f.id, f.class, j.buyer_id FROM failures f JOIN jobs j ON f.job_id = j.id")
def tk_failures(e: Exchange) -> DataFrame:
    return e.failures.join(e.jobs.select(F.col("id").alias("job_id"), "buyer_id"), "job_id").orderBy(F.desc("created_at"), "id").select("id", "class", "buyer_id")


@query("SELECT id, supplier_id, revoked FROM credentials ORDER BY created_at DESC, id LIMIT 200")
def tk_credential_audit(e: Exchange, most: int = 200) -> DataFrame:
    return e.credentials.orderBy(F.desc("created_at"), "id").limit(most).select("id", "supplier_id", "revoked")


# Sets and recursion


@query("SELECT worker_id FROM tasks WHERE status = 'running' UNION SELECT worker_id FROM tasks WHERE hedged_from IS NOT NULL AND status = 'queued'")
def st_union_busy(e: Exchange) -> DataFrame:
    return e.tasks.where("status = 'running'").select("worker_id").union(e.tasks.where("hedged_from IS NOT NULL AND status = 'queued'").select("worker_id")).distinct()


@query("SELECT job_id, chunk, supplier_id FROM (SELECT job_id, coalesce(chunk_index, 0) AS chunk, supplier_id FROM tasks WHERE status = 'running' UNION ALL SELECT job_id, coalesce(chunk_index, 0), supplier_id FROM tasks WHERE status = 'complete' UNION ALL SELECT job_id, chunk_index, supplier_id FROM verifications) x GROUP BY ALL")
def st_union_represented(e: Exchange) -> DataFrame:
    chunk = F.coalesce("chunk_index", F.lit(0)).alias("chunk")
    parts = [df.select("job_id", chunk, "supplier_id") for df in (e.tasks.where("status = 'running'"), e.tasks.where("status = 'complete'"), e.verifications)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("SELECT DISTINCT job_id, worker_id, supplier_id FROM (SELECT job_id, worker_id, supplier_id FROM tasks WHERE hedged_from IS NOT NULL UNION ALL SELECT job_id, worker_id, supplier_id FROM tasks WHERE is_redundancy UNION ALL SELECT job_id, worker_id, supplier_id FROM tasks WHERE status = 'failed') x")
def st_union_exclusions(e: Exchange) -> DataFrame:
    parts = [e.tasks.where(c).select("job_id", "worker_id", "supplier_id") for c in ("hedged_from IS NOT NULL", "is_redundancy", "status = 'failed'")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@query("SELECT 'job' AS kind, j.id FROM jobs j WHERE j.charge_status = 'charged' AND NOT EXISTS (SELECT 1 FROM refunds r WHERE r.job_id = j.id) UNION ALL SELECT 'batch', b.id FROM batches b WHERE b.status = 'charged' AND NOT EXISTS (SELECT 1 FROM refunds r WHERE r.job_id = b.id)")
def st_union_missing_fees(e: Exchange) -> DataFrame:
    covered = e.refunds.select(F.col("job_id").alias("id"))
    bare = lambda df, kind: df.select("id").join(covered, "id", "left_anti").select(F.lit(kind).alias("kind"), "id")
    return bare(e.jobs.where("charge_status = 'charged'"), "job").unionByName(bare(e.batches.where("status = 'charged'"), "batch"))


@query("SELECT c.id FROM collections c WHERE EXISTS (SELECT 1 FROM disputes d WHERE d.payment_intent = c.payment_intent AND d.status <> 'won' UNION ALL SELECT 1 FROM fundings f WHERE f.payment_intent = c.payment_intent AND f.amount_cents > 3000)")
def st_union_exists(e: Exchange) -> DataFrame:
    hits = e.disputes.where("status <> 'won'").select("payment_intent").unionByName(e.fundings.where("amount_cents > 3000").select("payment_intent"))
    return e.collections.join(hits, "payment_intent", "left_semi").select("id")


@query("SELECT DISTINCT t.job_id, w.engine, w.build_hash FROM tasks t JOIN workers w ON t.worker_id = w.id WHERE t.status = 'complete'")
def st_distinct_classes(e: Exchange) -> DataFrame:
    return e.tasks.where("status = 'complete'").select("job_id", F.col("worker_id").alias("id")).join(e.workers.select("id", "engine", "build_hash"), "id").select("job_id", "engine", "build_hash").distinct()


@query("WITH RECURSIVE chain AS (SELECT id, id AS root, 0 AS depth FROM credentials WHERE rotated_from IS NULL UNION ALL SELECT c.id, k.root, k.depth + 1 FROM credentials c JOIN chain k ON c.rotated_from = k.id) SELECT id, root, depth FROM chain")
def st_recursive_chain(e: Exchange) -> DataFrame:
    return chains(e.credentials.select("id", "rotated_from"))


def chains(links: DataFrame) -> DataFrame:
    """id, root, depth of every row under the first of its chain, however long, from (id, rotated_from).

    Pointers double: each round joins a row to what its pointer points to, so a chain of n takes about log2(n) rounds, each
    cut from its lineage; only the number of rows still under way comes back. Rows whose chain has no first are left out.
    """
    now = saved(links.select("id", F.coalesce("rotated_from", "id").alias("up"), F.when(F.col("rotated_from").isNull(), 0).otherwise(1).alias("depth"), F.col("rotated_from").isNull().alias("done")))
    left, before = now.where("not done").count(), -1
    while left != before and left:
        above = now.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        under = now.where("not done").join(above, "up").select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        now = saved(now.where("done").union(under))
        left, before = now.where("not done").count(), left
    return now.where("done").select("id", F.col("up").alias("root"), "depth")


@query("SELECT worker_id, unnest(CASE WHEN worker_id % 2 = 0 THEN ['a', 'b'] ELSE ['c'] END) AS model FROM model_state")
def st_unnest(e: Exchange) -> DataFrame:
    models = F.when(F.col("worker_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c")))
    return e.model_state.select("worker_id", F.explode(models).alias("model"))


# Lookups and guards


@query(f"SELECT j.id, j.buyer_id, CAST(CASE WHEN j.charge_status = 'failed' THEN 0 ELSE {FIRM} END AS BIGINT) AS charge_micros FROM jobs j LEFT JOIN refunds r ON r.job_id = j.id WHERE j.status IN {FINISHED} AND j.actual_micros IS NOT NULL")
def lk_job_charge(e: Exchange) -> DataFrame:
    due = firm_charges(e).where(f"status IN {FINISHED} AND actual_micros IS NOT NULL")
    return due.select("id", "buyer_id", F.when(F.col("charge_status") == "failed", F.lit(0)).otherwise(F.col("net_micros")).alias("charge_micros"))


@query("SELECT j.id, q.quoted_micros FROM jobs j JOIN quotes q ON q.job_id = j.id")
def lk_quoted(e: Exchange) -> DataFrame:
    return e.jobs.select("id").join(e.quotes.select(F.col("job_id").alias("id"), "quoted_micros"), "id")


@query("SELECT job_id, bool_and(status IN ('complete', 'failed')) AND bool_or(status = 'complete') AS all_done, bool_or(status NOT IN ('complete', 'failed')) AS pending, bool_or(status = 'verifying') AS verifying FROM tasks GROUP BY job_id")
def lk_all_done(e: Exchange) -> DataFrame:
    ended, done = F.col("status").isin("complete", "failed"), F.col("status") == "complete"
    return e.tasks.groupBy("job_id").agg((F.bool_and(ended) & F.bool_or(done)).alias("all_done"), F.bool_or(~ended).alias("pending"), F.bool_or(F.col("status") == "verifying").alias("verifying"))


@query("SELECT job_id FROM tasks WHERE status NOT IN ('complete', 'failed') GROUP BY job_id")
def lk_pending(e: Exchange) -> DataFrame:
    return e.tasks.where("status NOT IN ('complete', 'failed')").select("job_id").distinct()


@query("SELECT j.id, j.status, EXISTS (SELECT 1 FROM tasks t WHERE t.job_id = j.id AND t.status = 'verifying') OR EXISTS (SELECT 1 FROM tasks t WHERE t.job_id = j.id AND t.status IN ('queued', 'running', 'retrying')) AS pending FROM jobs j")
def lk_terminal_guard(e: Exchange) -> DataFrame:
    busy = e.tasks.where("status IN ('verifying', 'queued', 'running', 'retrying')").select(F.col("job_id").alias("id"), F.lit(True).alias("pending")).distinct()
    return e.jobs.select("id", "status").join(busy, "id", "left").select("id", "status", F.coalesce("pending", F.lit(False)).alias("pending"))


@query(f"SELECT id FROM jobs WHERE status IN {FINISHED} AND charge_status = 'not_attempted' ORDER BY created_at, id LIMIT 500")
def lk_unattempted(e: Exchange, most: int = 500) -> DataFrame:
    return e.jobs.where(f"status IN {FINISHED} AND charge_status = 'not_attempted'").orderBy("created_at", "id").limit(most).select("id")


@query("SELECT job_id, id FROM (SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(chunk_index, 0), id) AS r FROM tasks WHERE status = 'complete' AND NOT is_redundancy AND NOT is_honeypot) x WHERE r = 1")
def lk_reverify_target(e: Exchange) -> DataFrame:
    own = e.tasks.where("status = 'complete' AND NOT is_redundancy AND NOT is_honeypot")
    return first(own, ["job_id"], [F.coalesce("chunk_index", F.lit(0)), F.asc("id")]).select("job_id", "id")


@query("SELECT t.id FROM tasks t WHERE EXISTS (SELECT 1 FROM ledger l WHERE l.task_id = t.id AND l.kind = 'clawback')")
def lk_clawed(e: Exchange) -> DataFrame:
    return e.tasks.select("id").join(e.ledger.where("kind = 'clawback'").select(F.col("task_id").alias("id")), "id", "left_semi")


@query("SELECT DISTINCT job_id, coalesce(chunk_index, 0) AS chunk FROM tasks WHERE hedged_from IS NOT NULL AND is_redundancy")
def lk_tiebreak_exists(e: Exchange) -> DataFrame:
    return e.tasks.where("hedged_from IS NOT NULL AND is_redundancy").select("job_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk")).distinct()


@query("SELECT t.job_id, coalesce(t.chunk_index, 0) AS chunk, t.id, w.engine, w.build_hash FROM tasks t LEFT JOIN workers w ON t.worker_id = w.id WHERE t.status = 'complete' AND NOT t.is_honeypot")
def lk_chunk_results(e: Exchange) -> DataFrame:
    done = e.tasks.where("status = 'complete' AND NOT is_honeypot").select("job_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk"), "id", "worker_id")
    return done.join(e.workers.select(F.col("id").alias("worker_id"), "engine", "build_hash"), "worker_id", "left").drop("worker_id")


@query("SELECT b.id, w.job_id, w.url FROM (SELECT id FROM jobs WHERE status = 'complete') b JOIN webhooks w ON w.job_id = b.id WHERE w.state = 'pending'")
def lk_open_webhooks(e: Exchange) -> DataFrame:
    done = e.jobs.where("status = 'complete'").select("id")
    return e.webhooks.where("state = 'pending'").select(F.col("job_id").alias("id"), "job_id", "url").join(done, "id")


@query("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 10")
def lk_honeypots(e: Exchange, most: int = 10) -> DataFrame:
    return e.benchmark.orderBy("item_id").limit(most).select("item_id", "text")


@query("SELECT t.id AS task_id, sha256(b.text) AS answer FROM tasks t JOIN benchmark b ON b.item_id = t.worker_id % 40 WHERE t.is_honeypot")
def lk_honeypot_answer(e: Exchange) -> DataFrame:
    probes = e.tasks.where("is_honeypot").select(F.col("id").alias("task_id"), (F.col("worker_id") % 40).alias("item_id"))
    return probes.join(e.benchmark, "item_id").select("task_id", F.sha2(F.col("text").cast("binary"), 256).alias("answer"))


@query("SELECT j.id AS job_id, -j.sla_premium_micros AS amount_micros FROM jobs j WHERE j.status = 'complete' AND j.sla_premium_micros > 0 AND NOT EXISTS (SELECT 1 FROM refunds r WHERE r.job_id = j.id)")
def lk_sla_premium(e: Exchange) -> DataFrame:
    due = e.jobs.where("status = 'complete' AND sla_premium_micros > 0").select(F.col("id").alias("job_id"), (-F.col("sla_premium_micros")).alias("amount_micros"))
    return due.join(e.refunds.select("job_id"), "job_id", "left_anti")


@query("SELECT DISTINCT b.id FROM tasks a JOIN tasks b ON a.job_id = b.job_id AND a.input_ref = b.input_ref AND a.id <> b.id WHERE a.status = 'complete' AND b.status IN ('queued', 'running') AND b.hedged_from IS NOT NULL")
def lk_sibling_cancel(e: Exchange) -> DataFrame:
    won = e.tasks.where("status = 'complete'").select("job_id", "input_ref")
    return e.tasks.where("status IN ('queued', 'running') AND hedged_from IS NOT NULL").join(won, ["job_id", "input_ref"], "left_semi").select("id")


@query("SELECT job_id, chunk, id FROM (SELECT job_id, coalesce(chunk_index, 0) AS chunk, id, row_number() OVER (PARTITION BY job_id, coalesce(chunk_index, 0) ORDER BY created_at, id) AS r FROM tasks WHERE status = 'verifying') x WHERE r = 1")
def lk_chunk_turn(e: Exchange) -> DataFrame:
    own = e.tasks.where("status = 'verifying'").withColumn("chunk", F.coalesce("chunk_index", F.lit(0)))
    return first(own, ["job_id", "chunk"], [F.asc("created_at"), F.asc("id")]).select("job_id", "chunk", "id")


@query("SELECT v.id, v.task_id FROM verifications v JOIN tasks t ON v.task_id = t.id WHERE v.supplier_id <> t.supplier_id OR v.chunk_index <> coalesce(t.chunk_index, 0)")
def lk_effect_target(e: Exchange) -> DataFrame:
    """Events that name another supplier or chunk than their task has; none in a sound log."""
    own = e.tasks.select(F.col("id").alias("task_id"), F.col("supplier_id").alias("s"), F.coalesce("chunk_index", F.lit(0)).alias("c"))
    return e.verifications.join(own, "task_id").where("supplier_id <> s OR chunk_index <> c").select("id", "task_id")


@query("SELECT l.id FROM ledger l JOIN tasks t ON l.task_id = t.id WHERE (l.kind = 'buyer_charge' AND l.amount_micros <> -t.charge_micros) OR (l.kind = 'supplier_credit' AND l.amount_micros <> t.payout_micros)")
def lk_settlement_guard(e: Exchange) -> DataFrame:
    frozen = e.tasks.select(F.col("id").alias("task_id"), "charge_micros", "payout_micros")
    return e.ledger.join(frozen, "task_id").where("(kind = 'buyer_charge' AND amount_micros <> -charge_micros) OR (kind = 'supplier_credit' AND amount_micros <> payout_micros)").select("id")


@query("SELECT id FROM ledger WHERE payout_status = 'sending' ORDER BY created_at, id LIMIT 100")
def lk_stale_payouts(e: Exchange, most: int = 100) -> DataFrame:
    return e.ledger.where("payout_status = 'sending'").orderBy("created_at", "id").limit(most).select("id")


@query("SELECT b.id AS buyer_id, s.id AS supplier_id, s.status FROM buyers b LEFT JOIN suppliers s ON s.buyer_id = b.id")
def lk_supplier_for_buyer(e: Exchange) -> DataFrame:
    own = e.suppliers.select("buyer_id", F.col("id").alias("supplier_id"), "status")
    return e.buyers.select(F.col("id").alias("buyer_id")).join(own, "buyer_id", "left")


@query("SELECT c.id, s.buyer_id, c.revoked FROM credentials c JOIN suppliers s ON c.supplier_id = s.id")
def lk_credentials(e: Exchange) -> DataFrame:
    return e.credentials.join(e.suppliers.select(F.col("id").alias("supplier_id"), "buyer_id"), "supplier_id").select("id", "buyer_id", "revoked")


@query("SELECT w.id, count(b.id) AS benchmarks, max(b.p99_ms) AS worst_p99_ms FROM workers w LEFT JOIN benchmarks b ON b.worker_id = w.id GROUP BY w.id")
def lk_worker_profile(e: Exchange) -> DataFrame:
    per = e.benchmarks.groupBy(F.col("worker_id").alias("id")).agg(F.count("*").alias("n"), F.max("p99_ms").alias("worst_p99_ms"))
    return e.workers.select("id").join(per, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("benchmarks"), "worst_p99_ms")


@query("SELECT id, charge_micros / 1e6 AS charge_usd, payout_micros / 1e6 AS payout_usd FROM tasks")
def lk_task_economics(e: Exchange) -> DataFrame:
    return e.tasks.select("id", (F.col("charge_micros") / 1e6).alias("charge_usd"), (F.col("payout_micros") / 1e6).alias("payout_usd"))


@query("SELECT job_id, count(*) AS output_records, CAST(sum(length(input_ref)) AS BIGINT) AS output_bytes FROM tasks WHERE status = 'complete' GROUP BY job_id")
def lk_merge_mark(e: Exchange) -> DataFrame:
    return e.tasks.where("status = 'complete'").groupBy("job_id").agg(F.count("*").alias("output_records"), F.sum(F.length("input_ref")).alias("output_bytes"))
