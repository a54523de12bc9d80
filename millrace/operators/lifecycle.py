"""Verification end to end, quotes, digests and the remaining transitions and guards."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, risk
from ..plans.entities import AS_OF, Exchange
from ..plans.registry import query
from ..sources import packed
from .aggregates import ag_eligible_count, ag_hist_p90, ag_warm_count, live_workers
from .decisions import MAJORITY, VOTES, candidates, chunk_votes, fee_shares, majorities
from .relations import EMBED, first

# Verification


@query("SELECT t.job_id, t.input_ref, t.id, t.supplier_id, w.engine, w.build_hash, t.worker_id % 3 AS answer FROM tasks t JOIN workers w ON t.worker_id = w.id WHERE t.status IN ('complete', 'verifying') AND NOT t.is_honeypot")
def al_gather_votes(e: Exchange) -> DataFrame:
    """All results of a chunk, the one under verification with them, each with the class of its machine."""
    kinds = e.workers.select(F.col("id").alias("worker_id"), "engine", "build_hash")
    own = e.tasks.where("status IN ('complete', 'verifying') AND NOT is_honeypot").select("job_id", "input_ref", "id", "supplier_id", "worker_id", (F.col("worker_id") % 3).alias("answer"))
    return own.join(kinds, "worker_id").drop("worker_id")


_VERDICT = f"""SELECT t.id, CASE WHEN t.is_honeypot AND t.worker_id % 7 = 0 THEN 'honeypot_fail' WHEN t.is_honeypot THEN 'honeypot_pass' WHEN v.n IS NULL THEN 'unchecked' WHEN m.winner IS NULL THEN 'tiebreak_needed' WHEN t.worker_id % 3 = m.winner THEN 'match' ELSE 'mismatch' END AS verdict
    FROM tasks t LEFT JOIN (SELECT job_id, input_ref, count(*) AS n FROM {VOTES} v GROUP BY job_id, input_ref) v ON v.job_id = t.job_id AND v.input_ref = t.input_ref LEFT JOIN {MAJORITY} m ON m.job_id = t.job_id AND m.input_ref = t.input_ref WHERE t.status = 'verifying'"""


def verdicts(e: Exchange) -> DataFrame:
    """What each task under verification is found to be: probe, then peers' majority, then the need of a third opinion."""
    counted = chunk_votes(e).groupBy("job_id", "input_ref").agg(F.count("*").alias("n"))
    both = e.tasks.where("status = 'verifying'").join(counted, ["job_id", "input_ref"], "left").join(majorities(e).select("job_id", "input_ref", "winner"), ["job_id", "input_ref"], "left")
    verdict = F.when(F.col("is_honeypot") & (F.col("worker_id") % 7 == 0), "honeypot_fail").when(F.col("is_honeypot"), "honeypot_pass").when(F.col("n").isNull(), "unchecked").when(F.col("winner").isNull(), "tiebreak_needed")
    return both.select("id", "supplier_id", verdict.when(F.col("worker_id") % 3 == F.col("winner"), "match").otherwise("mismatch").alias("verdict"))


@query(_VERDICT)
def al_verify_task(e: Exchange) -> DataFrame:
    return verdicts(e).select("id", "verdict")


_EFFECTS = f"SELECT x.id, f.ordinal, f.effect FROM ({_VERDICT}) x JOIN (VALUES ('match', 0, 'accept'), ('match', 1, 'reward'), ('honeypot_pass', 0, 'accept'), ('unchecked', 0, 'accept'), ('tiebreak_needed', 0, 'dispatch_tiebreak'), ('mismatch', 0, 'reject'), ('mismatch', 1, 'dock'), ('honeypot_fail', 0, 'reject'), ('honeypot_fail', 1, 'dock'), ('honeypot_fail', 2, 'clawback')) AS f(verdict, ordinal, effect) ON f.verdict = x.verdict"
EFFECTS = {"match": ("accept", "reward"), "honeypot_pass": ("accept",), "unchecked": ("accept",), "tiebreak_needed": ("dispatch_tiebreak",), "mismatch": ("reject", "dock"), "honeypot_fail": ("reject", "dock", "clawback")}


def effects(e: Exchange) -> DataFrame:
    """A verdict as a list of effects, in order: the decision is data, and applying it is another step."""
    lists = F.create_map(*[x for k, v in EFFECTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return verdicts(e).select("id", "supplier_id", F.posexplode(lists[F.col("verdict")]).alias("ordinal", "effect"))


@query(_EFFECTS)
def al_plan_effects(e: Exchange) -> DataFrame:
    return effects(e).select("id", "ordinal", "effect")


@query(f"""SELECT id, ordinal, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', CAST(concat('0x', substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS effect_id
    FROM (SELECT id, ordinal, sha1(unhex('{uuid.NAMESPACE_OID.hex}') || encode(concat(id, '/', ordinal, '/', effect))) AS h FROM ({_EFFECTS}) e) x""")
def fn_effect_id(e: Exchange) -> DataFrame:
    """A UUID (version 5) per effect, the same on every run."""

    @F.pandas_udf("string")
    def name(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda v: str(uuid.uuid5(uuid.NAMESPACE_OID, v)))

    return effects(e).select("id", "ordinal", name(F.concat_ws("/", "id", "ordinal", "effect")).alias("effect_id"))


@query(f"SELECT id, sha256(string_agg(effect, ',' ORDER BY ordinal)) AS digest FROM ({_EFFECTS}) y GROUP BY id")
def fn_decision_digest(e: Exchange) -> DataFrame:
    """One digest per decision, over its effects in order."""
    lists = effects(e).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "effect"))).alias("l"))
    return lists.select("id", F.sha2(F.array_join(F.transform("l", lambda x: x["effect"]), ",").cast("binary"), 256).alias("digest"))


@query("SELECT id, sha256(concat(lower(trim(concat(' ', upper(kind), ' '))), '|', amount_micros)) AS digest FROM ledger")
def fn_intent_digest(e: Exchange) -> DataFrame:
    kind = F.lower(F.trim(F.concat(F.lit(" "), F.upper("kind"), F.lit(" "))))
    return e.ledger.select("id", F.sha2(F.concat_ws("|", kind, "amount_micros").cast("binary"), 256).alias("digest"))


# Quotes


@query(f"""SELECT j.id, CAST(greatest(floor((q.queued + j.id % 20 + greatest(w.workers, 1) - 1) / greatest(w.workers, 1)) * p.secs, p.secs) AS BIGINT) AS eta_secs, w.workers, w.warm, CASE WHEN w.workers = 0 THEN 'high' WHEN w.workers < 3 THEN 'medium' ELSE 'low' END AS oom FROM jobs j,
    (SELECT count(*) AS queued FROM tasks WHERE status IN ('queued', 'retrying')) q, (SELECT count(*) AS workers, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM model_state m WHERE m.worker_id = w.id AND m.model_ref = '{EMBED}' AND m.last_warm_at > TS({AS_OF - 60}))) AS warm FROM workers w JOIN suppliers s ON w.supplier_id = s.id
      WHERE s.status = 'active' AND NOT w.throttled AND w.last_seen_at > TS({AS_OF - 60}) AND w.effective_gb >= 4 AND EXISTS (SELECT 1 FROM benchmarks b WHERE b.worker_id = w.id AND b.job_type = 'embed')) w,
    (SELECT CASE WHEN count(*) >= 5 THEN CAST(floor((quantile_disc(duration_ms, 0.9) + 999) / 1000) AS BIGINT) ELSE 45 END AS secs FROM durations WHERE job_type = 'embed' AND model_ref = '{EMBED}' AND created_at > TS({AS_OF - 86400})) p WHERE j.job_type = 'embed' AND j.status = 'queued'""")
def al_quote(e: Exchange) -> DataFrame:
    """Queue, fleet and history in three rows of figures, laid beside every job that asks for a quote."""
    one = lambda df: F.broadcast(df)  # noqa: E731  one row each
    queued = e.tasks.where("status IN ('queued', 'retrying')").agg(F.count("*").alias("queued"))
    workers, warm = ag_eligible_count(e), ag_warm_count(e).withColumnRenamed("workers", "warm")
    secs = ag_hist_p90(e).select(money.per_task_secs(F.col("p90_ms")).alias("secs"))
    jobs = e.jobs.where("job_type = 'embed' AND status = 'queued'").select("id")
    for row in (queued, workers, warm, secs):
        jobs = jobs.join(one(row), F.lit(True))
    return jobs.select("id", money.eta_waves(F.col("queued"), F.col("id") % 20, F.col("workers"), F.col("secs")).alias("eta_secs"), "workers", "warm", risk.oom_risk(F.col("workers")).alias("oom"))


@query("SELECT j.id, round((j.id % 5000) / 1000.0::DOUBLE * m.price_per_1k * CASE j.tier WHEN 'priority' THEN 1.5::DOUBLE WHEN 'trusted' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END, 9) AS usd FROM jobs j JOIN models m ON m.id = j.model_ref")
def sc_price_estimate(e: Exchange) -> DataFrame:
    price = F.broadcast(e.models.select(F.col("id").alias("model_ref"), "price_per_1k"))  # one row per advertised model
    return e.jobs.join(price, "model_ref").select("id", F.round((F.col("id") % 5000) / 1000.0 * F.col("price_per_1k") * money.tier_factor(F.col("tier")), 9).alias("usd"))


@query("SELECT id, CAST(greatest(1, least(4096, floor(((SELECT median(c.eps) FROM benchmarks c WHERE c.job_type = 'embed') * 45)))) AS BIGINT) AS split_size FROM jobs WHERE job_type = 'embed'")
def sc_split_size_live(e: Exchange) -> DataFrame:
    """The split from the fleet's median rate instead of the static one."""
    rate = e.benchmarks.where("job_type = 'embed'").agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY eps)").alias("rate"))
    size = F.greatest(F.lit(1), F.least(F.lit(money.MOST_SPLIT), F.floor(F.col("rate") * money.TARGET_SECS)))
    return e.jobs.where("job_type = 'embed'").select("id").join(F.broadcast(rate), F.lit(True)).select("id", size.cast("long").alias("split_size"))  # one row


@query("SELECT id, greatest(0.01::DOUBLE, least(0.05::DOUBLE, CASE WHEN id % 5 = 0 THEN 0.03::DOUBLE ELSE (id % 9) / 100.0::DOUBLE END)) AS take_rate FROM jobs")
def sc_take_rate(e: Exchange) -> DataFrame:
    asked = F.when(F.col("id") % 5 == 0, F.lit(0.03)).otherwise((F.col("id") % 9) / F.lit(100.0))
    return e.jobs.select("id", risk.clamp(asked, 0.01, 0.05).alias("take_rate"))


# Audits


@query("SELECT id, CASE WHEN percent >= 1 OR percent < 0 THEN 'percent' WHEN margin >= 1 OR margin < 0 THEN 'margin' WHEN percent + margin >= 1 THEN 'sum' ELSE '' END AS error FROM (SELECT id, (id % 13) / 10.0::DOUBLE - 0.1::DOUBLE AS percent, (id % 7) / 10.0::DOUBLE AS margin FROM jobs) x")
def va_econ_schedule(e: Exchange) -> DataFrame:
    own = e.jobs.select("id", ((F.col("id") % 13) / F.lit(10.0) - 0.1).alias("percent"), ((F.col("id") % 7) / F.lit(10.0)).alias("margin"))
    bad = lambda c: (F.col(c) >= 1) | (F.col(c) < 0)
    return own.select("id", F.when(bad("percent"), "percent").when(bad("margin"), "margin").when(F.col("percent") + F.col("margin") >= 1, "sum").otherwise("").alias("error"))


@query("SELECT w.id, m.model_ref FROM workers w JOIN model_state m ON m.worker_id = w.id WHERE NOT EXISTS (SELECT 1 FROM benchmarks b WHERE b.worker_id = w.id AND b.model_ref = m.model_ref)")
def va_worker_caps(e: Exchange) -> DataFrame:
    """Models that a worker reports without a benchmark behind them."""
    proven = e.benchmarks.select("worker_id", "model_ref")
    return e.model_state.select("worker_id", "model_ref").join(proven, ["worker_id", "model_ref"], "left_anti").join(e.workers.select(F.col("id").alias("worker_id")), "worker_id", "left_semi").select(F.col("worker_id").alias("id"), "model_ref")


@query("SELECT coalesce(a.model_ref, m.id) AS model_ref, CASE WHEN m.id IS NULL THEN 'not_in_catalogue' ELSE 'not_reported' END AS drift FROM (SELECT DISTINCT model_ref FROM benchmarks WHERE job_type = 'embed') a FULL JOIN models m ON m.id = a.model_ref WHERE a.model_ref IS NULL OR m.id IS NULL")
def va_catalog_drift(e: Exchange) -> DataFrame:
    reported = e.benchmarks.where("job_type = 'embed'").select("model_ref").distinct().withColumn("r", F.lit(True))
    both = reported.join(e.models.select(F.col("id").alias("model_ref"), F.lit(True).alias("m")), "model_ref", "full")
    return both.where("r IS NULL OR m IS NULL").select("model_ref", F.when(F.col("m").isNull(), "not_in_catalogue").otherwise("not_reported").alias("drift"))


@query("SELECT a.id FROM ledger a WHERE a.kind = 'buyer_charge' AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.id = a.task_id AND t.charge_micros = -a.amount_micros)")
def va_append_only(e: Exchange) -> DataFrame:
    """Charges that differ from the snapshot that they were written from; none while the log is only appended to."""
    then = e.tasks.select(F.col("id").alias("task_id"), (-F.col("charge_micros")).alias("amount_micros"))
    return e.ledger.where("kind = 'buyer_charge'").join(then, ["task_id", "amount_micros"], "left_anti").select("id")


@query("SELECT label, 'size' AS error FROM embeddings WHERE label % 2 = 0 GROUP BY label UNION ALL SELECT label, '' FROM embeddings WHERE label % 2 = 1 GROUP BY label")
def va_artifact(e: Exchange) -> DataFrame:
    """Packed artifacts checked as they are read; those of even labels are cut short by a byte here."""
    files = packed.pack(e.embeddings, "label", "vec_id", "embedding")
    cut = files.withColumn("data", F.when(F.col("label") % 2 == 0, F.substring("data", 1, F.octet_length("data") - 1)).otherwise(F.col("data")))
    return packed.unpack(cut, ["label"]).select("label", "error").distinct()


@query("SELECT CAST(floor(place / 65536) AS INTEGER) AS part, count(*) AS count, CAST(16 + 256 * count(*) AS BIGINT) AS bytes FROM (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS place FROM embeddings) x GROUP BY 1")
def snk_packed_merge(e: Exchange) -> DataFrame:
    """Chunk artifacts unpacked and packed again as one sequence, in chunk order."""
    rows = packed.unpack(packed.pack(e.embeddings, "label", "vec_id", "embedding"), ["label", "part"]).where("error = ''")
    before = Window.orderBy("label", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("label", "part").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))  # one row per chunk
    whole = rows.join(counts, ["label", "part"]).select(F.lit(0).alias("file"), (F.col("base") + F.col("index")).alias("at"), "vector")
    return packed.pack(whole, "file", "at", "vector").select(F.col("part").cast("int").alias("part"), "count", F.octet_length("data").cast("long").alias("bytes"))


# Guards and transitions


@query("SELECT task_id, engine, build_hash FROM (SELECT v.task_id, w.engine, w.build_hash, row_number() OVER (PARTITION BY v.task_id ORDER BY v.created_at DESC, v.id DESC) AS r FROM verifications v JOIN tasks t ON v.task_id = t.id JOIN workers w ON t.worker_id = w.id) x WHERE r = 1")
def lk_frozen_class(e: Exchange) -> DataFrame:
    kinds = e.tasks.select(F.col("id").alias("task_id"), "worker_id").join(e.workers.select(F.col("id").alias("worker_id"), "engine", "build_hash"), "worker_id").drop("worker_id")
    return first(e.verifications.select("task_id", "created_at", "id"), ["task_id"], [F.desc("created_at"), F.desc("id")]).join(kinds, "task_id").select("task_id", "engine", "build_hash")


@query(f"SELECT w.id FROM workers w JOIN suppliers s ON w.supplier_id = s.id WHERE s.status = 'active' AND NOT w.throttled AND w.last_seen_at > TS({AS_OF - 60}) AND w.effective_gb >= 4 AND NOT w.thermal_degraded AND s.reputation >= 0.5 AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.worker_id = w.id AND t.status = 'running')")
def lk_peer_eligible(e: Exchange) -> DataFrame:
    busy = e.tasks.where("status = 'running'").select(F.col("worker_id").alias("id"))
    return live_workers(e).where("effective_gb >= 4 AND NOT thermal_degraded AND reputation >= 0.5").join(busy, "id", "left_anti").select("id")


@query("SELECT a.id FROM tasks a JOIN (SELECT id, worker_id, retry_count FROM tasks WHERE status = 'complete') b ON a.id = b.id AND a.worker_id IS NOT DISTINCT FROM b.worker_id AND a.retry_count IS NOT DISTINCT FROM b.retry_count")
def lk_commit_replay(e: Exchange) -> DataFrame:
    """Commits that repeat a settled one in every field, nulls included."""
    settled = e.tasks.where("status = 'complete'").select(F.col("id").alias("i"), F.col("worker_id").alias("w"), F.col("retry_count").alias("r"))
    same = (F.col("id") == F.col("i")) & F.col("worker_id").eqNullSafe(F.col("w")) & F.col("retry_count").eqNullSafe(F.col("r"))
    return e.tasks.join(settled, same).select("id")


@query("SELECT b.item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.is_honeypot AND t.worker_id % 40 = b.item_id AND t.status = 'failed')")
def lk_honeypot_insert(e: Exchange) -> DataFrame:
    there = e.tasks.where("is_honeypot AND status = 'failed'").select((F.col("worker_id") % 40).alias("item_id"))
    return e.benchmark.join(there, "item_id", "left_anti").select("item_id")


@query("SELECT item_id, concat('jobs/', substr(sha256(concat('alias', item_id)), 1, 16)) AS alias FROM benchmark")
def lk_honeypot_alias(e: Exchange) -> DataFrame:
    return e.benchmark.select("item_id", F.concat(F.lit("jobs/"), F.substring(F.sha2(F.concat(F.lit("alias"), F.col("item_id").cast("string")).cast("binary"), 256), 1, 16)).alias("alias"))


@query("SELECT j.id AS job_id, count(t.id) AS tasks, CAST(coalesce(sum(t.charge_micros), 0) AS BIGINT) AS reserved_micros, 'queued' AS status FROM jobs j LEFT JOIN tasks t ON t.job_id = j.id WHERE j.status = 'queued' GROUP BY j.id")
def tr_submit(e: Exchange) -> DataFrame:
    per = e.tasks.groupBy("job_id").agg(F.count("*").alias("tasks"), F.sum("charge_micros").alias("m"))
    new = e.jobs.where("status = 'queued'").select(F.col("id").alias("job_id")).join(per, "job_id", "left")
    return new.select("job_id", F.coalesce("tasks", F.lit(0)).alias("tasks"), F.coalesce("m", F.lit(0)).alias("reserved_micros"), F.lit("queued").alias("status"))


@query("SELECT DISTINCT v.job_id, v.chunk_index AS chunk, v.task_id FROM verifications v WHERE v.kind = 'tiebreak_win' AND NOT EXISTS (SELECT 1 FROM verifications p WHERE p.job_id = v.job_id AND p.chunk_index = v.chunk_index AND p.kind = 'redundancy_match')")
def tr_promote(e: Exchange) -> DataFrame:
    """Provisional winners that become results: decided, and not recorded before."""
    known = e.verifications.where("kind = 'redundancy_match'").select("job_id", "chunk_index")
    return e.verifications.where("kind = 'tiebreak_win'").join(known, ["job_id", "chunk_index"], "left_anti").select("job_id", F.col("chunk_index").alias("chunk"), "task_id").distinct()


@query("SELECT id, 'retrying' AS status, 60 AS wait_secs FROM tasks t WHERE status = 'running' AND NOT EXISTS (SELECT 1 FROM workers w WHERE w.id = t.worker_id AND NOT w.throttled)")
def tr_rescue_task(e: Exchange) -> DataFrame:
    able = e.workers.where("NOT throttled").select(F.col("id").alias("worker_id"))
    return e.tasks.where("status = 'running'").join(able, "worker_id", "left_anti").select("id", F.lit("retrying").alias("status"), F.lit(60).alias("wait_secs"))


@query("SELECT t.id, CASE WHEN t.status = 'complete' THEN 'complete' ELSE 'cancelled' END AS status FROM tasks t JOIN jobs j ON t.job_id = j.id WHERE j.status = 'running' AND j.charge_attempts = 5")
def tr_cancel_stuck(e: Exchange) -> DataFrame:
    stuck = e.jobs.where("status = 'running' AND charge_attempts = 5").select(F.col("id").alias("job_id"))
    return e.tasks.join(stuck, "job_id", "left_semi").select("id", F.when(F.col("status") == "complete", "complete").otherwise("cancelled").alias("status"))


@query("SELECT id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, reputation - 0.02::DOUBLE)) AS reputation, status FROM suppliers")
def tr_reputation_mild(e: Exchange) -> DataFrame:
    return e.suppliers.select("id", risk.clamp(F.col("reputation") - 0.02).alias("reputation"), "status")


@query(f"SELECT DISTINCT t.supplier_id, t.id AS task_id, -t.payout_micros AS amount_micros FROM ({_EFFECTS}) y JOIN tasks t ON t.id = y.id WHERE y.effect = 'clawback'")
def tr_clawback_verdict(e: Exchange) -> DataFrame:
    hit = effects(e).where("effect = 'clawback'").select("id").distinct()
    return e.tasks.join(hit, "id", "left_semi").select("supplier_id", F.col("id").alias("task_id"), (-F.col("payout_micros")).alias("amount_micros"))


@query(f"SELECT y.id AS hedged_from, t.job_id, t.input_ref FROM ({_EFFECTS}) y JOIN tasks t ON t.id = y.id WHERE y.effect = 'dispatch_tiebreak'")
def tr_tiebreak_planned(e: Exchange) -> DataFrame:
    planned = effects(e).where("effect = 'dispatch_tiebreak'").select("id")
    return e.tasks.join(planned, "id", "left_semi").select(F.col("id").alias("hedged_from"), "job_id", "input_ref")


@query("SELECT id, 'outcome_unknown' AS payout_status FROM ledger WHERE payout_status = 'sending' AND id % 5 = 0")
def tr_payout_unknown(e: Exchange) -> DataFrame:
    return e.ledger.where("payout_status = 'sending' AND id % 5 = 0").select("id", F.lit("outcome_unknown").alias("payout_status"))


@query("SELECT id, 'ready' AS payout_status FROM ledger WHERE payout_status = 'sending' AND id % 11 = 0 AND id % 5 <> 0")
def tr_payout_defer(e: Exchange) -> DataFrame:
    return e.ledger.where("payout_status = 'sending' AND id % 11 = 0 AND id % 5 <> 0").select("id", F.lit("ready").alias("payout_status"))


@query("SELECT b.id AS batch_id, b.fee_micros, true AS conserved FROM batches b WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.buyer_id = b.buyer_id AND j.actual_micros > 0)")
def tr_fee_alloc(e: Exchange) -> DataFrame:
    """Batches with new shares, and whether these add up to the fee."""
    return fee_shares(e).groupBy("batch_id", "fee_micros").agg((F.sum("share_micros") == F.max("fee_micros")).alias("conserved"))


@query("SELECT event_type, bucket, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM (SELECT event_type, least(CAST(floor(value / 50) AS BIGINT), 8) AS bucket, count(*) AS n FROM events GROUP BY 1, 2) x")
def ag_labeled_hist(e: Exchange) -> DataFrame:
    per = e.events.groupBy("event_type", F.least(F.floor(F.col("value") / 50), F.lit(8)).alias("bucket")).agg(F.count("*").alias("n"))
    return per.select("event_type", "bucket", F.sum("n").over(Window.partitionBy("event_type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


@query("SELECT id, job_type = CASE model_ref WHEN 'all-minilm-l6-v2' THEN 'embed' WHEN 'llama-3.2-1b-instruct-q4' THEN 'batch_infer' END AS exact, lower(trim(model_ref)) AS model FROM jobs")
def fn_model_norm(e: Exchange) -> DataFrame:
    kinds = F.broadcast(e.models.select(F.col("id").alias("model_ref"), F.col("job_type").alias("kind")))  # one row per advertised model
    return e.jobs.join(kinds, "model_ref", "left").select("id", (F.col("job_type") == F.col("kind")).alias("exact"), F.lower(F.trim("model_ref")).alias("model"))


@query("SELECT j.id AS job_id, count(w.id) AS able FROM jobs j JOIN workers w ON w.id % 50 = j.id % 50 WHERE w.tps > 95 GROUP BY j.id")
def al_able_part(e: Exchange) -> DataFrame:
    """How many fast workers each job's part of the fleet has: counted per part, then looked up."""
    per = e.workers.where("tps > 95").groupBy((F.col("id") % 50).alias("part")).agg(F.count("*").alias("able"))
    return e.jobs.select(F.col("id").alias("job_id"), (F.col("id") % 50).alias("part")).join(per, "part").select("job_id", "able")


@query("SELECT doc_id, len(list_filter(l, lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) AS code, len(list_filter(l, lambda x: trim(x) = '')) AS blank, len(list_filter(l, lambda x: starts_with(trim(x), '#'))) AS comment, len(l) AS total FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x")
def fn_count_loc(e: Exchange) -> DataFrame:
    l = F.split("text", "\n", -1)  # noqa: E741
    blank, comment = lambda x: F.trim(x) == "", lambda x: F.trim(x).startswith("#")
    count = lambda f: F.size(F.filter(l, f)).cast("long")
    return e.documents.select("doc_id", count(lambda x: ~blank(x) & ~comment(x)).alias("code"), count(blank).alias("blank"), count(comment).alias("comment"), F.size(l).cast("long").alias("total"))


@query(f"SELECT c.id, c.rate, c.warm FROM (SELECT w.id, b.eps AS rate, m.worker_id IS NOT NULL AS warm FROM workers w JOIN suppliers s ON w.supplier_id = s.id AND s.status = 'active' JOIN (SELECT worker_id, eps FROM benchmarks WHERE job_type = 'embed') b ON b.worker_id = w.id LEFT JOIN (SELECT DISTINCT worker_id FROM model_state WHERE model_ref = '{EMBED}' AND last_warm_at > TS({AS_OF - 60})) m ON m.worker_id = w.id WHERE NOT w.throttled AND w.last_seen_at > TS({AS_OF - 60})) c WHERE c.warm ORDER BY c.rate DESC, c.id LIMIT 5")
def tk_warm_peers(e: Exchange, most: int = 5) -> DataFrame:
    return candidates(e).where("warm").orderBy(F.desc("rate"), "id").limit(most).select("id", "rate", "warm")
