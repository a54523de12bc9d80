"""Fleet, queue, latency, payout and verification aggregates of the exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.entities import AS_OF, Exchange
from ..plans.registry import query

DAY = 86_400
#: Upper bounds of the duration histogram, in milliseconds.
BOUNDS = (1_000, 5_000, 15_000, 30_000, 60_000, 120_000, 300_000)


def seconds(c):
    """Epoch seconds of a timestamp without zone, with its fraction."""
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp")) / F.lit(1e6)


def live_workers(e: Exchange) -> DataFrame:
    """Workers seen within a minute, of an active supplier, not throttled."""
    active = e.suppliers.where("status = 'active'").select(F.col("id").alias("supplier_id"), "reputation")
    return e.workers.where((F.col("last_seen_at") > e.ago(60)) & ~F.col("throttled")).join(active, "supplier_id")


LIVE = f"(SELECT w.*, s.reputation FROM workers w JOIN suppliers s ON w.supplier_id = s.id WHERE s.status = 'active' AND NOT w.throttled AND w.last_seen_at > TS({AS_OF - 60}))"
CLAIMABLE = f"t.status IN ('queued', 'retrying') AND coalesce(t.visible_at, t.created_at) <= TS({AS_OF})"


def claimable(e: Exchange) -> DataFrame:
    return e.tasks.where(F.col("status").isin("queued", "retrying") & (F.coalesce("visible_at", "created_at") <= e.as_of))


@query(f"""SELECT j.tier, j.job_type, count(*) AS depth FROM tasks t JOIN jobs j ON t.job_id = j.id
    WHERE {CLAIMABLE} AND j.status NOT IN ('complete', 'failed', 'cancelled') GROUP BY j.tier, j.job_type""")
def ag_queue_depth(e: Exchange) -> DataFrame:
    open_jobs = e.jobs.where(~F.col("status").isin("complete", "failed", "cancelled")).select(F.col("id").alias("job_id"), "tier", "job_type")
    return claimable(e).join(open_jobs, "job_id").groupBy("tier", "job_type").agg(F.count("*").alias("depth"))


@query(f"""SELECT d.job_type, d.model_ref, count(*) AS samples, avg(d.duration_ms) AS avg_ms, CAST(quantile_disc(d.duration_ms, 0.9) AS DOUBLE) AS p90_ms, avg(j.eta_secs) AS avg_eta_secs, count(*) >= 5 AS trusted
    FROM durations d LEFT JOIN jobs j ON d.job_id = j.id WHERE d.created_at > TS({AS_OF - DAY}) GROUP BY d.job_type, d.model_ref""")
def ag_drift(e: Exchange) -> DataFrame:
    eta = e.jobs.select(F.col("id").alias("job_id"), "eta_secs")
    recent = e.durations.where(F.col("created_at") > e.ago(DAY)).join(eta, "job_id", "left")
    return recent.groupBy("job_type", "model_ref").agg(F.count("*").alias("samples"), F.avg("duration_ms").alias("avg_ms"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY duration_ms)").cast("double").alias("p90_ms"), F.avg("eta_secs").alias("avg_eta_secs"), (F.count("*") >= 5).alias("trusted"))


@query(f"SELECT CASE WHEN count(*) >= 5 THEN CAST(quantile_disc(duration_ms, 0.9) AS BIGINT) END AS p90_ms, count(*) AS samples FROM durations WHERE job_type = 'embed' AND model_ref = 'all-minilm-l6-v2' AND created_at > TS({AS_OF - DAY})")
def ag_hist_p90(e: Exchange, job_type: str = "embed", model_ref: str = "all-minilm-l6-v2") -> DataFrame:
    own = e.durations.where((F.col("job_type") == job_type) & (F.col("model_ref") == model_ref) & (F.col("created_at") > e.ago(DAY)))
    return own.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY duration_ms)").cast("long").alias("p90"), F.count("*").alias("samples")).select(F.when(F.col("samples") >= 5, F.col("p90")).alias("p90_ms"), "samples")


@query(f"SELECT job_type, {', '.join(f'count(*) FILTER (WHERE duration_ms <= {b}) AS le_{b}' for b in BOUNDS)}, count(*) AS le_inf, CAST(sum(duration_ms) AS BIGINT) AS sum_ms FROM durations GROUP BY job_type")
def ag_histogram(e: Exchange) -> DataFrame:
    return e.durations.groupBy("job_type").agg(*[F.count_if(F.col("duration_ms") <= b).alias(f"le_{b}") for b in BOUNDS], F.count("*").alias("le_inf"), F.sum("duration_ms").alias("sum_ms"))


_PHASES = {"queue_wait": ("created_at", "claimed_at"), "dispatch": ("claimed_at", "started_at"), "run": ("started_at", "completed_at")}


@query(f"""SELECT j.job_type, count(*) AS tasks, {', '.join(f"CAST(quantile_disc(EPOCH(t.{b}) - EPOCH(t.{a}), {q}) AS DOUBLE) AS {k}_p{int(q * 100)}" for k, (a, b) in _PHASES.items() for q in (0.5, 0.9))}
    FROM tasks t JOIN jobs j ON t.job_id = j.id WHERE t.status = 'complete' AND t.completed_at IS NOT NULL GROUP BY j.job_type""")
def ag_latency_phases(e: Exchange) -> DataFrame:
    """Median and P90 of waiting, dispatch and run time per job type, from one pass over the finished tasks."""
    kinds = e.jobs.select(F.col("id").alias("job_id"), "job_type")
    done = e.tasks.where("status = 'complete' AND completed_at IS NOT NULL").select("job_id", *[(seconds(b) - seconds(a)).alias(k) for k, (a, b) in _PHASES.items()])
    return done.join(kinds, "job_id").groupBy("job_type").agg(F.count("*").alias("tasks"), *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {k})").alias(f"{k}_p{int(q * 100)}") for k in _PHASES for q in (0.5, 0.9)])


@query(f"SELECT CAST(median(s.effective_gb) AS DOUBLE) AS median_gb, count(*) AS workers FROM (SELECT worker_id, effective_gb, row_number() OVER (PARTITION BY worker_id ORDER BY created_at DESC, id DESC) AS r FROM samples) s JOIN {LIVE} w ON s.worker_id = w.id WHERE s.r = 1")
def ag_median_memory(e: Exchange) -> DataFrame:
    latest = e.samples.groupBy("worker_id").agg(F.max_by("effective_gb", F.struct("created_at", "id")).alias("effective_gb"))
    return latest.join(live_workers(e).select(F.col("id").alias("worker_id")), "worker_id").agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY effective_gb)").alias("median_gb"), F.count("*").alias("workers"))


@query("""SELECT supplier_id, payout_status, count(*) AS entries, CAST(sum(amount_micros) AS BIGINT) AS micros, count(*) FILTER (WHERE amount_micros > 30000) AS large, CAST(coalesce(sum(amount_micros) FILTER (WHERE amount_micros > 30000), 0) AS BIGINT) AS large_micros
    FROM ledger WHERE kind = 'supplier_credit' GROUP BY supplier_id, payout_status""")
def ag_payout_rollup(e: Exchange) -> DataFrame:
    large = F.col("amount_micros") > 30_000
    return e.ledger.where("kind = 'supplier_credit'").groupBy("supplier_id", "payout_status").agg(F.count("*").alias("entries"), F.sum("amount_micros").alias("micros"), F.count_if(large).alias("large"), F.coalesce(F.sum(F.when(large, F.col("amount_micros"))), F.lit(0)).alias("large_micros"))


@query("""SELECT supplier_id, CAST(sum(CASE WHEN payout_status IN ('held', 'ready') OR kind = 'clawback' THEN amount_micros ELSE 0 END) AS BIGINT) AS balance_micros, CAST(sum(amount_micros) AS BIGINT) AS lifetime_micros,
    CAST(sum(CASE WHEN payout_status = 'carried' THEN amount_micros ELSE 0 END) AS BIGINT) AS carried_micros, arg_max(amount_micros, {'a': created_at, 'b': id}) FILTER (WHERE payout_status = 'released') AS last_payout_micros, min(created_at) FILTER (WHERE payout_status = 'held') AS next_at
    FROM (SELECT l.id, coalesce(l.supplier_id, t.supplier_id) AS supplier_id, l.kind, l.amount_micros, l.payout_status, l.created_at FROM ledger l JOIN tasks t ON l.task_id = t.id WHERE l.kind IN ('supplier_credit', 'clawback')) x GROUP BY supplier_id""")
def ag_earnings(e: Exchange) -> DataFrame:
    owner = e.tasks.select(F.col("id").alias("task_id"), F.col("supplier_id").alias("owner"))
    own = e.ledger.where("kind IN ('supplier_credit', 'clawback')").join(owner, "task_id").withColumn("supplier_id", F.coalesce("supplier_id", "owner"))
    amount = lambda c: F.sum(F.when(c, F.col("amount_micros")).otherwise(0))
    released = F.col("payout_status") == "released"
    return own.groupBy("supplier_id").agg(
        amount(F.coalesce(F.col("payout_status").isin("held", "ready"), F.lit(False)) | (F.col("kind") == "clawback")).alias("balance_micros"), F.sum("amount_micros").alias("lifetime_micros"), amount(F.col("payout_status") == "carried").alias("carried_micros"),
        F.max_by("amount_micros", F.when(released, F.struct("created_at", "id"))).alias("last_payout_micros"), F.min(F.when(F.col("payout_status") == "held", F.col("created_at"))).alias("next_at"),
    )


@query("SELECT t.supplier_id, count(*) AS clawbacks, count(DISTINCT l.task_id) AS tasks, CAST(sum(l.amount_micros) AS BIGINT) AS micros FROM ledger l JOIN tasks t ON l.task_id = t.id WHERE l.kind = 'clawback' GROUP BY t.supplier_id")
def ag_fraud(e: Exchange) -> DataFrame:
    owner = e.tasks.select(F.col("id").alias("task_id"), F.col("supplier_id").alias("owner"))
    return e.ledger.where("kind = 'clawback'").drop("supplier_id").join(owner, "task_id").groupBy(F.col("owner").alias("supplier_id")).agg(F.count("*").alias("clawbacks"), F.count_distinct("task_id").alias("tasks"), F.sum("amount_micros").alias("micros"))


_DRIFT = """SELECT j.job_type, j.model_ref, count(*) AS jobs, avg(q.quoted_micros / 1e6) AS avg_quoted_usd, avg(j.actual_micros / 1e6) AS avg_actual_usd
    FROM jobs j JOIN quotes q ON q.job_id = j.id WHERE j.actual_micros IS NOT NULL GROUP BY j.job_type, j.model_ref"""


@query(f"SELECT *, avg_actual_usd / avg_quoted_usd AS ratio, (avg_actual_usd / avg_quoted_usd - 1) * 100 AS drift_pct FROM ({_DRIFT}) d")
def ag_cost_drift(e: Exchange) -> DataFrame:
    both = e.jobs.where("actual_micros IS NOT NULL").join(e.quotes.select(F.col("job_id").alias("id"), "quoted_micros"), "id")
    per = both.groupBy("job_type", "model_ref").agg(F.count("*").alias("jobs"), F.avg(F.col("quoted_micros") / 1e6).alias("avg_quoted_usd"), F.avg(F.col("actual_micros") / 1e6).alias("avg_actual_usd"))
    ratio = F.col("avg_actual_usd") / F.col("avg_quoted_usd")
    return per.select("*", ratio.alias("ratio"), ((ratio - 1) * 100).alias("drift_pct"))


@query(f"SELECT job_type, model_ref, CASE WHEN jobs >= 5 AND avg_quoted_usd > 0 THEN avg_actual_usd / avg_quoted_usd END AS ratio, jobs >= 5 AND avg_quoted_usd > 0 AS usable, false AS alert FROM ({_DRIFT}) d")
def ag_cost_drift_fin(e: Exchange) -> DataFrame:
    """The ratio only where five jobs and a positive quote stand behind it; the alert flag stays closed."""
    usable = (F.col("jobs") >= 5) & (F.col("avg_quoted_usd") > 0)
    return ag_cost_drift(e).select("job_type", "model_ref", F.when(usable, F.col("ratio")).alias("ratio"), usable.alias("usable"), F.lit(False).alias("alert"))


_KINDS = ("redundancy_match", "redundancy_mismatch", "honeypot_pass", "honeypot_fail", "tiebreak_win")


def verification_counts(e: Exchange) -> DataFrame:
    """Per job: events by kind, distinct delivered chunks, distinct verified ones (no more than delivered)."""
    counts = e.verifications.groupBy("job_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in _KINDS], F.count_distinct(F.when(F.col("kind").isin("redundancy_match", "honeypot_pass", "tiebreak_win"), F.col("chunk_index"))).alias("verified"))
    done = e.tasks.where("status = 'complete' AND NOT is_honeypot").groupBy("job_id").agg(F.count_distinct(F.coalesce("chunk_index", F.lit(0))).alias("delivered"))
    return done.join(counts, "job_id", "left").select("job_id", "delivered", *[F.coalesce(k, F.lit(0)).alias(k) for k in _KINDS], F.least("delivered", F.coalesce("verified", F.lit(0))).alias("verified"))


VERIFIED = f"""SELECT d.job_id, d.delivered, {', '.join(f'coalesce(v.{k}, 0) AS {k}' for k in _KINDS)}, least(d.delivered, coalesce(v.verified, 0)) AS verified
    FROM (SELECT job_id, count(DISTINCT coalesce(chunk_index, 0)) AS delivered FROM tasks WHERE status = 'complete' AND NOT is_honeypot GROUP BY job_id) d
    LEFT JOIN (SELECT job_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in _KINDS)}, count(DISTINCT chunk_index) FILTER (WHERE kind IN ('redundancy_match', 'honeypot_pass', 'tiebreak_win')) AS verified FROM verifications GROUP BY job_id) v ON d.job_id = v.job_id"""


@query(VERIFIED)
def ag_verif_rollup(e: Exchange) -> DataFrame:
    return verification_counts(e)


@query("SELECT supplier_id, count(*) FILTER (WHERE kind = 'honeypot_pass') AS passed, count(*) FILTER (WHERE kind = 'honeypot_fail') AS failed FROM verifications GROUP BY supplier_id")
def ag_supplier_verif(e: Exchange) -> DataFrame:
    return e.verifications.groupBy("supplier_id").agg(F.count_if(F.col("kind") == "honeypot_pass").alias("passed"), F.count_if(F.col("kind") == "honeypot_fail").alias("failed"))


@query("""SELECT j.id AS job_id, CAST(coalesce(sum(l.amount_micros) FILTER (WHERE l.kind = 'buyer_charge'), 0) AS BIGINT) AS ledger_charge_micros, CAST(coalesce(sum(l.amount_micros) FILTER (WHERE l.kind = 'supplier_credit'), 0) AS BIGINT) AS credit_micros,
    CAST(coalesce(sum(l.amount_micros) FILTER (WHERE l.kind = 'platform_take'), 0) AS BIGINT) AS take_micros,
    CAST(CASE WHEN coalesce(sum(l.amount_micros) FILTER (WHERE l.kind = 'buyer_charge'), 0) <> 0 THEN sum(l.amount_micros) FILTER (WHERE l.kind = 'buyer_charge') ELSE coalesce(max(j.actual_micros), max(j.estimated_micros)) END AS BIGINT) AS charged_micros
    FROM jobs j LEFT JOIN ledger l ON l.job_id = j.id GROUP BY j.id""")
def ag_invoice(e: Exchange) -> DataFrame:
    """Ledger sums keep the ledger's sign; only a sum of exactly 0 falls back to the job's own amounts. charged_abs is left to callers."""
    per = e.ledger.groupBy("job_id").agg(*[F.sum(F.when(F.col("kind") == k, F.col("amount_micros"))).alias(n) for k, n in (("buyer_charge", "charge"), ("supplier_credit", "credit"), ("platform_take", "take"))])
    charge = F.coalesce("charge", F.lit(0))
    joined = e.jobs.join(per, F.col("id") == F.col("job_id"), "left")
    return joined.select(F.col("id").alias("job_id"), charge.alias("ledger_charge_micros"), F.coalesce("credit", F.lit(0)).alias("credit_micros"), F.coalesce("take", F.lit(0)).alias("take_micros"), F.when(charge != 0, charge).otherwise(F.coalesce("actual_micros", "estimated_micros")).alias("charged_micros"))


@query("""SELECT j.id AS job_id, CAST(coalesce((SELECT -sum(l.amount_micros) FROM ledger l WHERE l.job_id = j.id AND l.kind = 'buyer_charge'), 0) + CASE WHEN j.status = 'complete' THEN j.sla_premium_micros ELSE 0 END AS BIGINT) AS actual_micros FROM jobs j WHERE j.status IN ('complete', 'failed')""")
def ag_job_actual(e: Exchange) -> DataFrame:
    tasks = e.ledger.where("kind = 'buyer_charge'").select("job_id", (-F.col("amount_micros")).alias("m"))
    ended = e.jobs.where("status IN ('complete', 'failed')")
    premium = ended.where("status = 'complete'").select(F.col("id").alias("job_id"), F.col("sla_premium_micros").cast("long").alias("m"))
    sums = tasks.unionByName(premium).groupBy("job_id").agg(F.sum("m").alias("m"))
    return ended.select(F.col("id").alias("job_id")).join(sums, "job_id", "left").select("job_id", F.coalesce("m", F.lit(0)).alias("actual_micros"))


@query("""SELECT b.id AS buyer_id, CAST(greatest(0, b.free_credit_micros - coalesce(s.spent, 0) - coalesce(f.flight, 0)) AS BIGINT) AS remaining_micros FROM buyers b
    LEFT JOIN (SELECT buyer_id, -sum(amount_micros) AS spent FROM ledger WHERE kind = 'buyer_charge' GROUP BY buyer_id) s ON s.buyer_id = b.id
    LEFT JOIN (SELECT buyer_id, sum(estimated_micros) AS flight FROM jobs WHERE status IN ('queued', 'running', 'verifying') GROUP BY buyer_id) f ON f.buyer_id = b.id""")
def ag_free_credit(e: Exchange) -> DataFrame:
    spent = e.ledger.where("kind = 'buyer_charge'").groupBy("buyer_id").agg((-F.sum("amount_micros")).alias("spent"))
    flight = e.jobs.where("status IN ('queued', 'running', 'verifying')").groupBy("buyer_id").agg(F.sum("estimated_micros").alias("flight"))
    all_ = e.buyers.withColumnRenamed("id", "buyer_id").join(spent, "buyer_id", "left").join(flight, "buyer_id", "left")
    return all_.select("buyer_id", F.greatest(F.lit(0), F.col("free_credit_micros") - F.coalesce("spent", F.lit(0)) - F.coalesce("flight", F.lit(0))).alias("remaining_micros"))


_DUE = f"""SELECT buyer_id, CAST(sum(actual_micros) AS BIGINT) AS gross_micros, min(merged_at) AS oldest_at FROM jobs WHERE charge_status = 'deferred' AND actual_micros IS NOT NULL GROUP BY buyer_id
    HAVING (sum(actual_micros) >= 500000 OR min(merged_at) < TS({AS_OF - 14 * DAY})) AND sum(actual_micros) >= 50000"""


@query(_DUE)
def ag_buyers_due(e: Exchange, threshold: int = 500_000, least: int = 50_000, max_age: int = 14 * DAY) -> DataFrame:
    per = e.jobs.where("charge_status = 'deferred' AND actual_micros IS NOT NULL").groupBy("buyer_id").agg(F.sum("actual_micros").alias("gross_micros"), F.min("merged_at").alias("oldest_at"))
    return per.where(((F.col("gross_micros") >= threshold) | (F.col("oldest_at") < e.ago(max_age))) & (F.col("gross_micros") >= least))


FIRM = "greatest(0, CASE WHEN j.firm_max_micros IS NOT NULL THEN least(j.actual_micros, j.firm_max_micros) ELSE j.actual_micros END - coalesce(r.refund_micros, 0))"


def firm_charges(e: Exchange) -> DataFrame:
    """Jobs with net_micros: the actual amount under its firm cap, less refunds, never below 0."""
    refunds = e.refunds.groupBy("job_id").agg(F.sum("refund_micros").alias("refund_micros"))
    capped = F.when(F.col("firm_max_micros").isNotNull(), F.least("actual_micros", "firm_max_micros")).otherwise(F.col("actual_micros"))
    return e.jobs.join(refunds, F.col("id") == F.col("job_id"), "left").withColumn("net_micros", F.greatest(F.lit(0), capped - F.coalesce("refund_micros", F.lit(0))))


@query(f"""SELECT buyer_id, count(*) AS jobs, CAST(sum(net) AS BIGINT) AS net_micros FROM (SELECT j.buyer_id, {FIRM} AS net, row_number() OVER (PARTITION BY j.buyer_id ORDER BY j.merged_at, j.id) AS r
    FROM jobs j LEFT JOIN refunds r ON r.job_id = j.id WHERE j.charge_status = 'deferred' AND j.actual_micros IS NOT NULL) x WHERE r <= 500 GROUP BY buyer_id""")
def ag_charge_batch(e: Exchange, most: int = 500) -> DataFrame:
    due = firm_charges(e).where("charge_status = 'deferred' AND actual_micros IS NOT NULL")
    oldest = due.withColumn("r", F.row_number().over(Window.partitionBy("buyer_id").orderBy("merged_at", "id"))).where(F.col("r") <= most)
    return oldest.groupBy("buyer_id").agg(F.count("*").alias("jobs"), F.sum("net_micros").alias("net_micros"))


def eligible(e: Exchange, job_type: str, least_gb: float) -> DataFrame:
    """Live workers with enough memory and a benchmark of the job type."""
    able = e.benchmarks.where(F.col("job_type") == job_type).select(F.col("worker_id").alias("id"))
    return live_workers(e).where(F.col("effective_gb") >= least_gb).join(able, "id", "left_semi")


_ELIGIBLE = f"(SELECT w.* FROM {LIVE} w WHERE w.effective_gb >= 4 AND EXISTS (SELECT 1 FROM benchmarks b WHERE b.worker_id = w.id AND b.job_type = 'embed'))"


@query(f"SELECT count(*) AS workers FROM {_ELIGIBLE} w")
def ag_eligible_count(e: Exchange) -> DataFrame:
    return eligible(e, "embed", 4).agg(F.count("*").alias("workers"))


@query(f"SELECT count(*) AS workers FROM {_ELIGIBLE} w WHERE EXISTS (SELECT 1 FROM model_state m WHERE m.worker_id = w.id AND m.model_ref = 'all-minilm-l6-v2' AND m.last_warm_at > TS({AS_OF - 60}))")
def ag_warm_count(e: Exchange) -> DataFrame:
    warm = e.model_state.where((F.col("model_ref") == "all-minilm-l6-v2") & (F.col("last_warm_at") > e.ago(60))).select(F.col("worker_id").alias("id"))
    return eligible(e, "embed", 4).join(warm, "id", "left_semi").agg(F.count("*").alias("workers"))


@query(f"SELECT avg(reputation) AS reputation FROM {_ELIGIBLE} w")
def ag_pool_reputation(e: Exchange) -> DataFrame:
    return eligible(e, "embed", 4).agg(F.avg("reputation").alias("reputation"))


@query(f"SELECT count(*) AS workers FROM workers WHERE last_seen_at > TS({AS_OF - 60})")
def ag_active_workers(e: Exchange) -> DataFrame:
    return e.workers.where(F.col("last_seen_at") > e.ago(60)).agg(F.count("*").alias("workers"))


@query("SELECT count(*) AS tasks FROM tasks WHERE status IN ('queued', 'retrying')")
def ag_queued_tasks(e: Exchange) -> DataFrame:
    return e.tasks.where("status IN ('queued', 'retrying')").agg(F.count("*").alias("tasks"))


_COUNTED = ("durations", "samples", "job_events", "failures")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED))
def ag_table_counts(e: Exchange) -> DataFrame:
    out = None
    for name in _COUNTED:
        one = getattr(e, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT payment_intent, CAST(least(received_cents, refunded_cents + open_cents) AS BIGINT) AS unavailable_cents FROM (SELECT c.payment_intent, c.received_cents, c.refunded_cents, coalesce(sum(d.amount_cents) FILTER (WHERE d.status <> 'won'), 0) AS open_cents
    FROM collections c LEFT JOIN disputes d ON d.payment_intent = c.payment_intent GROUP BY c.payment_intent, c.received_cents, c.refunded_cents) x""")
def ag_unavailable_cash(e: Exchange) -> DataFrame:
    held = e.disputes.where("status <> 'won'").groupBy("payment_intent").agg(F.sum("amount_cents").alias("open_cents"))
    return e.collections.join(held, "payment_intent", "left").select("payment_intent", F.least("received_cents", F.col("refunded_cents") + F.coalesce("open_cents", F.lit(0))).alias("unavailable_cents"))


@query("SELECT task_id, CAST(sum(amount_micros) AS BIGINT) AS sum_micros, count(*) AS rows FROM ledger WHERE kind IN ('buyer_charge', 'supplier_credit', 'platform_take') GROUP BY task_id HAVING sum(amount_micros) <> 0 OR count(*) <> count(DISTINCT kind)")
def ag_zero_sum(e: Exchange) -> DataFrame:
    """Tasks whose three settlement rows do not cancel out or repeat a kind; none in sound books."""
    kinds = ("buyer_charge", "supplier_credit", "platform_take")
    has = sum((F.max(F.when(F.col("kind") == k, 1).otherwise(0)) for k in kinds), F.lit(0))  # distinct kinds as flags in the one row of a task
    per = e.ledger.where(F.col("kind").isin(*kinds)).groupBy("task_id").agg(F.sum("amount_micros").alias("sum_micros"), F.count("*").alias("rows"), has.alias("kinds"))
    return per.where("sum_micros <> 0 OR rows <> kinds").drop("kinds")


@query("""SELECT supplier_id, count(*) AS samples, CAST(quantile_disc(duration_ms, 0.99) AS BIGINT) AS p99_ms, CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(duration_ms) / avg(duration_ms) * 100 END AS cv_pct, CAST(list_sort(list(duration_ms))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS BIGINT) AS upper_median_ms, CAST(median(duration_ms) AS DOUBLE) AS mid_median_ms
    FROM (SELECT worker_id AS supplier_id, duration_ms FROM durations) d GROUP BY supplier_id""")
def ag_percentile_kinds(e: Exchange) -> DataFrame:
    """Nearest rank P99, variation, upper and midpoint median: four figures that must not stand in for one another."""
    own = e.durations.select(F.col("worker_id").alias("supplier_id"), "duration_ms")
    n = F.count("*")
    whole = own.groupBy("supplier_id").agg(n.alias("samples"), F.when(n < 2, F.lit(0.0)).otherwise(F.stddev_pop("duration_ms") / F.avg("duration_ms") * 100).alias("cv_pct"))
    counts = own.groupBy("supplier_id", "duration_ms").agg(n.alias("n"))  # what is put in order are distinct values
    upto = F.sum("n").over(Window.partitionBy("supplier_id").orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("duration_ms")))
    half = F.col("samples") / 2
    ranked = counts.withColumn("upto", upto).join(whole, "supplier_id").groupBy("supplier_id", "samples", "cv_pct")
    return ranked.agg(at(F.ceil(F.col("samples") * 0.99)).alias("p99_ms"), at(F.floor(half) + 1).alias("upper_median_ms"), ((at(F.floor((F.col("samples") + 1) / 2)) + at(F.floor(half) + 1)) / 2).alias("mid_median_ms"))


@query("""SELECT worker_id, max(duration_ms) AS peak, avg(duration_ms) FILTER (WHERE r > n * 0.75) AS late, (1 - avg(duration_ms) FILTER (WHERE r > n * 0.75) / max(duration_ms)) * 100 AS gap_pct
    FROM (SELECT worker_id, duration_ms, row_number() OVER (PARTITION BY worker_id ORDER BY created_at, id) AS r, count(*) OVER (PARTITION BY worker_id) AS n FROM durations) d GROUP BY worker_id""")
def ag_sustained(e: Exchange) -> DataFrame:
    own = Window.partitionBy("worker_id")
    ranked = e.durations.select("worker_id", "duration_ms", F.row_number().over(own.orderBy("created_at", "id")).alias("r"), F.count("*").over(own).alias("n"))
    late = F.avg(F.when(F.col("r") > F.col("n") * 0.75, F.col("duration_ms")))
    return ranked.groupBy("worker_id").agg(F.max("duration_ms").alias("peak"), late.alias("late"), ((1 - late / F.max("duration_ms")) * 100).alias("gap_pct"))


@query(f"""SELECT reason, count(*) AS tasks FROM (SELECT CASE WHEN j.status IN ('complete', 'failed', 'cancelled') THEN 'job_closed' WHEN t.status NOT IN ('queued', 'retrying') THEN 'not_waiting' WHEN coalesce(t.visible_at, t.created_at) > TS({AS_OF}) THEN 'not_visible'
    WHEN j.min_memory_gb > 4 THEN 'memory' WHEN j.tier = 'priority' THEN 'tier' ELSE 'eligible' END AS reason FROM tasks t JOIN jobs j ON t.job_id = j.id) x GROUP BY reason""")
def ag_scheduler_explain(e: Exchange) -> DataFrame:
    """Why tasks are not handed out: the first failing predicate of each, counted."""
    jobs = e.jobs.select(F.col("id").alias("job_id"), F.col("status").alias("job_status"), "min_memory_gb", "tier")
    reason = F.when(F.col("job_status").isin("complete", "failed", "cancelled"), "job_closed").when(~F.col("status").isin("queued", "retrying"), "not_waiting").when(F.coalesce("visible_at", "created_at") > e.as_of, "not_visible")
    reason = reason.when(F.col("min_memory_gb") > 4, "memory").when(F.col("tier") == "priority", "tier").otherwise("eligible")
    return e.tasks.join(jobs, "job_id").groupBy(reason.alias("reason")).agg(F.count("*").alias("tasks"))


@query("""SELECT coalesce(b.supplier_id, p.supplier_id) AS supplier_id, coalesce(b.expected, 0) AS expected_micros, coalesce(p.paid, 0) AS provider_micros, abs(coalesce(b.expected, 0) - coalesce(p.paid, 0)) > 10000 AS drift FROM
    (SELECT supplier_id, CAST(sum(amount_micros) AS BIGINT) AS expected FROM ledger WHERE payout_status = 'released' GROUP BY supplier_id) b FULL JOIN (SELECT id AS supplier_id, completed_tasks * 100 AS paid FROM suppliers WHERE payouts_enabled) p ON b.supplier_id = p.supplier_id""")
def ag_reconcile(e: Exchange) -> DataFrame:
    books = e.ledger.where("payout_status = 'released'").groupBy("supplier_id").agg(F.sum("amount_micros").alias("expected"))
    feed = e.suppliers.where("payouts_enabled").select(F.col("id").alias("supplier_id"), (F.col("completed_tasks") * 100).alias("paid"))
    expected, paid = F.coalesce("expected", F.lit(0)), F.coalesce("paid", F.lit(0))
    return books.join(feed, "supplier_id", "full").select("supplier_id", expected.alias("expected_micros"), paid.alias("provider_micros"), (F.abs(expected - paid) > 10_000).alias("drift"))


@query("""SELECT b.id AS batch_id, b.fee_micros, coalesce(a.jobs, 0) AS jobs, CAST(coalesce(a.micros, 0) AS BIGINT) AS allocated_micros FROM batches b LEFT JOIN (SELECT buyer_id, count(*) AS jobs, sum(actual_micros) AS micros FROM jobs WHERE charge_status = 'charged' AND actual_micros IS NOT NULL GROUP BY buyer_id) a ON a.buyer_id = b.buyer_id
    WHERE b.status = 'charged' AND coalesce(a.micros, 0) <> b.fee_micros""")
def ag_missing_alloc(e: Exchange) -> DataFrame:
    per = e.jobs.where("charge_status = 'charged' AND actual_micros IS NOT NULL").groupBy("buyer_id").agg(F.count("*").alias("jobs"), F.sum("actual_micros").alias("micros"))
    both = e.batches.where("status = 'charged'").join(per, "buyer_id", "left").where(F.coalesce("micros", F.lit(0)) != F.col("fee_micros"))
    return both.select(F.col("id").alias("batch_id"), "fee_micros", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("micros", F.lit(0)).alias("allocated_micros"))


@query("SELECT lang, source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY lang, source")
def ag_census(e: Exchange) -> DataFrame:
    return e.documents.groupBy("lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"))


@query(f"""SELECT b.bound, count(*) FILTER (WHERE EPOCH(t.claimed_at) - EPOCH(t.created_at) <= b.bound) AS cumulative, count(*) AS total FROM tasks t CROSS JOIN (VALUES {', '.join(f'({b})' for b in (30, 60, 120, 240, 480))}) AS b(bound) WHERE t.claimed_at IS NOT NULL GROUP BY b.bound""")
def ag_claim_hist(e: Exchange) -> DataFrame:
    """Claims per bucket, then summed upwards over the bounds: one row per bound."""
    bounds = (30, 60, 120, 240, 480)
    bucket = F.coalesce(*[F.when(F.col("wait") <= b, F.lit(b)) for b in bounds], F.lit(bounds[-1] + 1))
    waits = e.tasks.where("claimed_at IS NOT NULL").select((seconds("claimed_at") - seconds("created_at")).alias("wait"))
    one = waits.agg(*[F.count_if(bucket <= b).alias(f"c{b}") for b in bounds], F.count("*").alias("total"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bound"), F.col(f"c{b}").alias("cumulative"), F.col("total").alias("total")) for b in bounds])).alias("r")).select("r.*")
