"""Scheduling, verification and settlement decisions: state in, decision rows out, nothing is mutated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money
from ..plans.entities import AS_OF, Exchange
from ..plans.registry import query
from .frozen import JOBS_SQL, PLAN_SQL
from .aggregates import DAY, LIVE, claimable, firm_charges, live_workers
from .relations import EMBED, SCORE, first, match_score

CHUNK = "coalesce(t.chunk_index, 0)"


# Votes


def chunk_votes(e: Exchange) -> DataFrame:
    """One vote per supplier and chunk: the finished result of its smallest task; `answer` stands for the artifact's digest."""
    votes = e.tasks.where("status = 'complete' AND NOT is_honeypot").select("job_id", "input_ref", "supplier_id", "id", (F.col("worker_id") % 3).alias("answer"))
    return first(votes, ["job_id", "input_ref", "supplier_id"], [F.asc("id")])


VOTES = "(SELECT job_id, input_ref, supplier_id, id, worker_id % 3 AS answer FROM (SELECT *, row_number() OVER (PARTITION BY job_id, input_ref, supplier_id ORDER BY id) AS r FROM tasks WHERE status = 'complete' AND NOT is_honeypot) x WHERE r = 1)"
MAJORITY = f"(SELECT job_id, input_ref, arg_max(answer, n) AS winner, max(n) AS votes, sum(n) AS total FROM (SELECT job_id, input_ref, answer, count(*) AS n FROM {VOTES} v GROUP BY ALL) c GROUP BY job_id, input_ref HAVING max(n) * 2 > sum(n))"


@query(f"SELECT job_id, input_ref, supplier_id, id, answer FROM {VOTES} v")
def al_independent_votes(e: Exchange) -> DataFrame:
    return chunk_votes(e)


def majorities(e: Exchange) -> DataFrame:
    """Chunks with an answer that more than half of the votes share."""
    counts = chunk_votes(e).groupBy("job_id", "input_ref", "answer").agg(F.count("*").alias("n"))
    per = counts.groupBy("job_id", "input_ref").agg(F.max_by("answer", "n").alias("winner"), F.max("n").alias("votes"), F.sum("n").alias("total"))
    return per.where(F.col("votes") * 2 > F.col("total"))


@query(f"SELECT job_id, input_ref, winner, votes, CAST(total AS BIGINT) AS total FROM {MAJORITY} m")
def al_majority(e: Exchange) -> DataFrame:
    return majorities(e)


@query(f"SELECT v.id, CASE WHEN m.winner IS NULL THEN 'no_majority' WHEN v.answer = m.winner THEN 'tiebreak_win' WHEN w.engine = 'metal' THEN 'cross_class_skip' ELSE 'tiebreak_loss' END AS event, coalesce(v.answer <> m.winner AND w.engine <> 'metal', false) AS clawback FROM {VOTES} v JOIN workers w ON w.id = (SELECT worker_id FROM tasks t WHERE t.id = v.id) LEFT JOIN {MAJORITY} m ON v.job_id = m.job_id AND v.input_ref = m.input_ref")
def al_tiebreak(e: Exchange) -> DataFrame:
    """What each vote earns once a chunk has a majority; a loser of another class is skipped and not clawed back."""
    engines = e.tasks.select("id", "worker_id").join(e.workers.select(F.col("id").alias("worker_id"), "engine"), "worker_id").select("id", "engine")
    both = chunk_votes(e).join(engines, "id").join(majorities(e), ["job_id", "input_ref"], "left")
    event = F.when(F.col("winner").isNull(), "no_majority").when(F.col("answer") == F.col("winner"), "tiebreak_win").when(F.col("engine") == "metal", "cross_class_skip").otherwise("tiebreak_loss")
    return both.select("id", event.alias("event"), (event == "tiebreak_loss").alias("clawback"))


@query("SELECT a.id, b.id AS peer_id, a.worker_id % 3 = b.worker_id % 3 AS agree FROM tasks a JOIN tasks b ON a.job_id = b.job_id AND a.input_ref = b.input_ref AND a.id < b.id WHERE a.status = 'complete' AND b.status = 'complete'")
def al_agree(e: Exchange) -> DataFrame:
    """Byte equality of generated results, pair by pair in their chunk; a chunk has a handful of tasks."""
    own = e.tasks.where("status = 'complete'").select("job_id", "input_ref", "id", (F.col("worker_id") % 3).alias("answer"))
    peers = own.select("job_id", "input_ref", F.col("id").alias("peer_id"), F.col("answer").alias("peer"))
    return own.join(peers, ["job_id", "input_ref"]).where("id < peer_id").select("id", "peer_id", (F.col("answer") == F.col("peer")).alias("agree"))


@query("SELECT job_id, chunk, id FROM (SELECT job_id, coalesce(chunk_index, 0) AS chunk, id, row_number() OVER (PARTITION BY job_id, coalesce(chunk_index, 0) ORDER BY is_redundancy, completed_at, id) AS r FROM tasks WHERE status = 'complete') x WHERE r = 1")
def al_chunk_winner(e: Exchange) -> DataFrame:
    own = e.tasks.where("status = 'complete'").withColumn("chunk", F.coalesce("chunk_index", F.lit(0)))
    return first(own, ["job_id", "chunk"], [F.asc("is_redundancy"), F.asc("completed_at"), F.asc("id")]).select("job_id", "chunk", "id")


@query("SELECT t.id, e.kind, e.ordinal FROM tasks t JOIN (VALUES (0, 'reject'), (1, 'requeue'), (2, 'dock')) AS e(ordinal, kind) ON true WHERE t.status = 'failed'")
def al_invalid_effects(e: Exchange) -> DataFrame:
    """The three effects of an invalid artifact, in order."""
    return e.tasks.where("status = 'failed'").select("id", F.posexplode(F.array(F.lit("reject"), F.lit("requeue"), F.lit("dock"))).alias("ordinal", "kind"))


# Settlement


_ALLOC = "SELECT b.id AS batch_id, j.id AS job_id, b.fee_micros, j.actual_micros AS weight, sum(j.actual_micros) OVER (PARTITION BY b.id) AS total, row_number() OVER (PARTITION BY b.id ORDER BY j.id) AS r, count(*) OVER (PARTITION BY b.id) AS n FROM batches b JOIN jobs j ON j.buyer_id = b.buyer_id WHERE j.actual_micros > 0"


def fee_shares(e: Exchange) -> DataFrame:
    """Each job's whole share of its batch's fee: the floor in proportion to its weight, the last one takes what is left."""
    both = e.batches.select(F.col("id").alias("batch_id"), "buyer_id", "fee_micros").join(e.jobs.where("actual_micros > 0").select(F.col("id").alias("job_id"), "buyer_id", F.col("actual_micros").alias("weight")), "buyer_id")
    own = Window.partitionBy("batch_id")
    share = F.floor(F.col("fee_micros").cast("decimal(18,0)") * F.col("weight").cast("decimal(18,0)") / F.sum("weight").over(own)).cast("long")
    ranked = both.select("*", share.alias("share"), F.row_number().over(own.orderBy(F.desc("job_id"))).alias("from_last"))
    others = F.sum(F.when(F.col("from_last") > 1, F.col("share")).otherwise(0)).over(own)
    return ranked.select("batch_id", "job_id", "fee_micros", F.when(F.col("from_last") == 1, F.col("fee_micros") - others).otherwise(F.col("share")).alias("share_micros"))


@query(f"WITH a AS ({_ALLOC}), f AS (SELECT *, CAST(fee_micros::HUGEINT * weight // total AS BIGINT) AS floored FROM a) SELECT batch_id, job_id, fee_micros, CAST(CASE WHEN r = n THEN fee_micros - coalesce(sum(floored) OVER (PARTITION BY batch_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE floored END AS BIGINT) AS share_micros FROM f")
def al_fee_alloc(e: Exchange) -> DataFrame:
    return fee_shares(e)


@query("SELECT id AS task_id, v.kind, CAST(CASE v.n WHEN 0 THEN -charge_micros WHEN 1 THEN payout_micros ELSE charge_micros - payout_micros END AS BIGINT) AS amount_micros FROM tasks CROSS JOIN (VALUES (0, 'buyer_charge'), (1, 'supplier_credit'), (2, 'platform_take')) AS v(n, kind) WHERE status = 'complete'")
def al_ledger_split(e: Exchange) -> DataFrame:
    """Three rows that cancel out for each settled task."""
    row = lambda kind, amount: F.struct(F.lit(kind).alias("kind"), amount.alias("amount_micros"))
    rows = F.array(row("buyer_charge", -F.col("charge_micros")), row("supplier_credit", F.col("payout_micros")), row("platform_take", F.col("charge_micros") - F.col("payout_micros")))
    return e.tasks.where("status = 'complete'").select(F.col("id").alias("task_id"), F.explode(rows).alias("r")).select("task_id", "r.*")


@query("SELECT t.id AS task_id, -l.amount_micros AS amount_micros, CASE WHEN l.payout_status IN ('released', 'sending') THEN 'debt' ELSE 'cancelled' END AS effect FROM ledger l JOIN tasks t ON l.task_id = t.id WHERE l.kind = 'supplier_credit' AND t.worker_id % 40 = 3")
def al_clawback(e: Exchange) -> DataFrame:
    bad = e.tasks.where("worker_id % 40 = 3").select(F.col("id").alias("task_id"))
    effect = F.when(F.col("payout_status").isin("released", "sending"), "debt").otherwise("cancelled")
    return e.ledger.where("kind = 'supplier_credit'").join(bad, "task_id", "left_semi").select("task_id", (-F.col("amount_micros")).alias("amount_micros"), effect.alias("effect"))


@query("SELECT id, CASE WHEN EPOCH(merged_at) - EPOCH(created_at) > sla_secs THEN 'missed' ELSE 'met' END AS outcome, CAST(CASE WHEN EPOCH(merged_at) - EPOCH(created_at) > sla_secs THEN greatest(0, least(sla_premium_micros, coalesce(actual_micros, 0))) ELSE 0 END AS BIGINT) AS refund_micros FROM jobs WHERE status = 'complete' AND sla_secs IS NOT NULL AND merged_at IS NOT NULL")
def al_sla_settle(e: Exchange) -> DataFrame:
    missed = (F.unix_micros(F.col("merged_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) > F.col("sla_secs") * 1_000_000
    refund = money.sla_refund(F.col("sla_premium_micros"), F.coalesce("actual_micros", F.lit(0)))
    return e.jobs.where("status = 'complete' AND sla_secs IS NOT NULL AND merged_at IS NOT NULL").select("id", F.when(missed, "missed").otherwise("met").alias("outcome"), F.when(missed, refund).otherwise(0).cast("long").alias("refund_micros"))


@query("SELECT f.id, sum(f.amount_cents) OVER (PARTITION BY f.payment_intent ORDER BY f.created_at, f.id ROWS UNBOUNDED PRECEDING) <= c.received_cents - least(c.received_cents, c.refunded_cents) AS funded FROM fundings f JOIN collections c ON c.payment_intent = f.payment_intent")
def al_payout_funding(e: Exchange) -> DataFrame:
    """Reservations in order of age, admitted while their running sum stays within the collected and not refunded cash."""
    cash = e.collections.select("payment_intent", (F.col("received_cents") - F.least("received_cents", "refunded_cents")).alias("cash"))
    upto = Window.partitionBy("payment_intent").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    return e.fundings.join(cash, "payment_intent").select("id", (F.sum("amount_cents").over(upto) <= F.col("cash")).alias("funded"))


@query("""SELECT id, exposed_cents, CASE WHEN exposed_cents = 0 THEN 'sound' WHEN exposed_cents < amount_cents THEN 'partial' ELSE 'compromised' END AS state FROM (SELECT f.id, f.amount_cents, CAST(greatest(0, least(f.amount_cents, sum(f.amount_cents) OVER (PARTITION BY f.payment_intent ORDER BY f.created_at, f.id ROWS UNBOUNDED PRECEDING) - c.received_cents)) AS BIGINT) AS exposed_cents
    FROM fundings f JOIN collections c ON c.payment_intent = f.payment_intent) x""")
def al_funding_impact(e: Exchange) -> DataFrame:
    upto = Window.partitionBy("payment_intent").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    exposed = F.greatest(F.lit(0), F.least("amount_cents", F.sum("amount_cents").over(upto) - F.col("received_cents")))
    both = e.fundings.join(e.collections.select("payment_intent", "received_cents"), "payment_intent").select("id", "amount_cents", exposed.alias("exposed_cents"))
    return both.select("id", "exposed_cents", F.when(F.col("exposed_cents") == 0, "sound").when(F.col("exposed_cents") < F.col("amount_cents"), "partial").otherwise("compromised").alias("state"))


@query("SELECT payment_intent, effect FROM (SELECT payment_intent, CASE status WHEN 'lost' THEN 'unavailable' WHEN 'won' THEN 'none' ELSE 'unavailable' END AS effect, row_number() OVER (PARTITION BY payment_intent ORDER BY event_created DESC, CASE status WHEN 'lost' THEN 30 WHEN 'won' THEN 0 ELSE 10 END DESC, id) AS r FROM disputes) x WHERE r = 1")
def al_dispute_effect(e: Exchange) -> DataFrame:
    """The latest dispute event of a payment decides; of equal times, the one of the higher rank."""
    rank = F.when(F.col("status") == "lost", 30).when(F.col("status") == "won", 0).otherwise(10)
    latest = first(e.disputes, ["payment_intent"], [F.desc("event_created"), rank.desc(), F.asc("id")])
    return latest.select("payment_intent", F.when(F.col("status") == "won", "none").otherwise("unavailable").alias("effect"))


# Planning and scheduling


def economics(e: Exchange, percent: float = 0.029, fixed: float = 0.3, per_task: float = 0.0001, margin: float = 0.1, share: float = 0.97) -> DataFrame:
    """Per job: buyer charge and payout per task, and four scenarios with the margin left above what is required."""
    n, extra = (F.col("id") % 9 + 1).cast("double"), (F.col("id") % 3).cast("double")
    base = e.jobs.select("id", "id", n.alias("n"), extra.alias("extra"), (F.col("estimated_micros") / 1e6).alias("usd"), (F.col("sla_premium_micros") / 1e6).alias("premium")).toDF("id", "_", "n", "extra", "usd", "premium").drop("_")
    compute = F.col("usd") / F.col("n")
    per = base.select("*", compute.alias("compute"), money.round_usd(compute * share).alias("payout"))
    per = per.withColumn("charge", money.ceil_usd(F.greatest("compute", (F.col("payout") + fixed + per_task) / (1 - percent - margin))))
    all_ = F.col("n") + F.col("extra")
    cases = F.array(*[F.struct(F.lit(k).alias("scenario"), t.alias("tasks"), F.lit(miss).alias("miss")) for k, t, miss in (("one_task", F.lit(1.0), True), ("all_met", F.col("n"), False), ("all_missed", F.col("n"), True), ("extra_missed", all_, True))])
    s = per.select("*", F.explode(cases).alias("s")).select("*", "s.*").drop("s")
    s = s.withColumn("gross", money.round_usd(F.col("charge") * F.col("tasks") + F.col("premium")))
    s = s.withColumn("net", money.round_usd(F.col("gross") - F.when(F.col("miss"), money.round_usd(F.least("premium", "gross"))).otherwise(0.0)))
    cost = money.round_usd(F.col("payout") * F.col("tasks")) + F.when(F.col("net") > 0, money.ceil_usd(F.col("net") * percent + fixed)).otherwise(0.0) + money.round_usd(per_task * F.col("tasks"))
    return s.withColumn("headroom", money.round_usd(money.round_usd(F.col("net") - cost) - money.round_usd(F.col("net") * margin)))


@query(f"WITH i AS (SELECT id, 0 AS v, {JOBS_SQL}), {PLAN_SQL} SELECT id, max(charge) / 1e6 AS charge_usd, max(payout) / 1e6 AS payout_usd, min(headroom) / 1e6 AS headroom_usd, arg_min(scenario, {{'a': headroom, 'b': scenario}}) AS tightest, min(headroom) >= -1 AS executable FROM w GROUP BY id")
def al_econ_plan(e: Exchange) -> DataFrame:
    """Charge, payout, the tightest scenario and whether the plan may run."""
    tight = F.min_by("scenario", F.struct("headroom", "scenario"))
    return economics(e).groupBy("id").agg(F.max("charge").alias("charge_usd"), F.max("payout").alias("payout_usd"), F.min("headroom").alias("headroom_usd"), tight.alias("tightest")).withColumn("executable", F.col("headroom_usd") >= -1e-6)


def fanout(fleet: DataFrame, items: DataFrame) -> DataFrame:
    """job_id, worker_id, items, secs: how a job's items spread so that all workers finish together.

    fleet has job_id, worker_id, rate (items a second) and start (seconds until it can begin). With workers in order of
    start, the finish T that the first k of them reach is (items + sum rate * start) / sum rate; the least T over k that is
    no earlier than the k-th start is the plan's. Shares are floors, and the largest remainders take what is left.
    """
    own = Window.partitionBy("job_id").orderBy("start", F.desc("rate"), "worker_id").rowsBetween(Window.unboundedPreceding, 0)
    both = fleet.where("rate > 0").join(items, "job_id").where("n > 0")
    t = (F.col("n") + F.sum(F.col("rate") * F.col("start")).over(own)) / F.sum("rate").over(own)
    timed = both.withColumn("t", F.when(t >= F.col("start"), t))
    finish = timed.withColumn("finish", F.min("t").over(Window.partitionBy("job_id")))
    shared = finish.withColumn("exact", F.greatest(F.lit(0.0), F.col("finish") - F.col("start")) * F.col("rate")).withColumn("whole", F.floor(F.col("exact") + 1e-9))
    job = Window.partitionBy("job_id")
    ranked = shared.withColumn("left", F.col("n") - F.sum("whole").over(job)).withColumn("rank", F.row_number().over(job.orderBy((F.col("exact") > 0).desc(), F.desc(F.col("exact") - F.col("whole")), "start", F.desc("rate"), "worker_id")))
    given = ranked.withColumn("items", (F.col("whole") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("long")).where("items > 0")
    return given.select("job_id", "worker_id", "items", (F.col("start") + F.col("items") / F.col("rate")).alias("secs"))


@query(f"""WITH b AS (SELECT j.id AS job_id, w.id AS worker_id, w.tps / 10 AS rate, CASE WHEN w.id % 2 = 0 THEN 0.0 ELSE 20.0 END::DOUBLE AS start, (j.id % 900 + 1)::DOUBLE AS n FROM jobs j JOIN {LIVE} w ON w.id % 50 = j.id % 50 WHERE j.status = 'running' AND w.tps > 0),
    t AS (SELECT *, (n + sum(rate * start) OVER o) / sum(rate) OVER o AS t FROM b WINDOW o AS (PARTITION BY job_id ORDER BY start, rate DESC, worker_id ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, min(CASE WHEN t >= start THEN t END) OVER (PARTITION BY job_id) AS finish FROM t),
    s AS (SELECT *, greatest(0.0::DOUBLE, finish - start) * rate AS exact FROM f), h AS (SELECT *, floor(exact + 1e-9) AS whole FROM s),
    r AS (SELECT *, n - sum(whole) OVER (PARTITION BY job_id) AS rest, row_number() OVER (PARTITION BY job_id ORDER BY exact > 0 DESC, exact - whole DESC, start, rate DESC, worker_id) AS rank FROM h), g AS (SELECT *, CAST(whole + CASE WHEN rank <= rest THEN 1 ELSE 0 END AS BIGINT) AS items FROM r)
    SELECT job_id, worker_id, items, start + items / rate AS secs FROM g WHERE items > 0""")
def al_fanout(e: Exchange) -> DataFrame:
    """Plans for the running jobs over the part of the fleet whose number is that of the job modulo 50.

    Jobs of one part and size have one plan, so each (part, n) is planned once: the fleet is laid beside at most 900 of
    them, whatever the number of jobs, and only workers with items meet the jobs.
    """
    fleet = live_workers(e).select(F.col("id").alias("worker_id"), (F.col("id") % 50).alias("part"), (F.col("tps") / 10).alias("rate"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.lit(20.0)).alias("start"))
    jobs = e.jobs.where("status = 'running'").select(F.col("id").alias("job_id"), (F.col("id") % 50).alias("part"), (F.col("id") % 900 + 1).alias("n"))
    kinds = jobs.select("part", "n").distinct().select(F.struct("part", "n").alias("job_id"), "part", "n")
    plans = fanout(kinds.select("job_id", "part").join(fleet, "part").drop("part"), kinds.select("job_id", "n"))
    lines = F.broadcast(plans.select("job_id.*", "worker_id", "items", "secs"))  # n from 1 to 900 and a worker an item at most: 405,450 rows whatever the fleet
    return jobs.join(lines, ["part", "n"]).select("job_id", "worker_id", "items", "secs")


CAPACITY = f"SELECT w.hw_class, sum(greatest(0.0::DOUBLE, 60.0::DOUBLE - CASE WHEN w.id % 2 = 0 THEN 0.0 ELSE 20.0 END) * w.tps) AS items FROM {LIVE} w GROUP BY w.hw_class"


@query(CAPACITY)
def al_plan_capacity(e: Exchange, secs: float = 60.0) -> DataFrame:
    start = F.when(F.col("id") % 2 == 0, 0.0).otherwise(20.0)
    return live_workers(e).groupBy("hw_class").agg(F.sum(F.greatest(F.lit(0.0), F.lit(secs) - start) * F.col("tps")).alias("items"))


_CANDIDATES = f"SELECT w.id, CASE WHEN b.job_type = 'embed' THEN b.eps ELSE b.tps END AS rate, m.worker_id IS NOT NULL AS warm, b.load_ms / 1000.0::DOUBLE AS load_secs FROM {LIVE} w JOIN (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY created_at DESC, id) AS r FROM benchmarks WHERE job_type = 'embed') b ON b.worker_id = w.id AND b.r = 1 LEFT JOIN (SELECT DISTINCT worker_id FROM model_state WHERE model_ref = '{EMBED}' AND last_warm_at > TS({AS_OF - 60})) m ON m.worker_id = w.id"


def candidates(e: Exchange) -> DataFrame:
    """Live workers with the rate of their newest benchmark, warm or not: items a second for embedding, where tps is 0."""
    newest = first(e.benchmarks.where("job_type = 'embed'"), ["worker_id"], [F.desc("created_at"), F.asc("id")]).select(F.col("worker_id").alias("id"), F.col("eps").alias("rate"), (F.col("load_ms") / 1000.0).alias("load_secs"))
    warm = e.model_state.where((F.col("model_ref") == EMBED) & (F.col("last_warm_at") > e.ago(60))).select(F.col("worker_id").alias("id"), F.lit(True).alias("w")).distinct()
    return live_workers(e).select("id", "supplier_id", "reputation", "hw_class").join(newest, "id").join(warm, "id", "left").withColumn("warm", F.coalesce("w", F.lit(False))).drop("w")


@query(_CANDIDATES)
def al_candidates(e: Exchange) -> DataFrame:
    return candidates(e).select("id", "rate", "warm", "load_secs")


@query(f"SELECT id, rate, CASE WHEN warm THEN 0.0 ELSE load_secs END AS start_secs FROM ({_CANDIDATES}) c WHERE rate > 0")
def al_fleet_snapshot(e: Exchange) -> DataFrame:
    return candidates(e).where("rate > 0").select("id", "rate", F.when(F.col("warm"), 0.0).otherwise(F.col("load_secs")).alias("start_secs"))


@query("SELECT w.id FROM workers w WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.worker_id = w.id AND t.status = 'failed') AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.supplier_id = w.supplier_id AND t.hedged_from IS NOT NULL AND t.status = 'failed')")
def al_prune_peers(e: Exchange) -> DataFrame:
    workers = e.tasks.where("status = 'failed'").select(F.col("worker_id").alias("id"))
    suppliers = e.tasks.where("hedged_from IS NOT NULL AND status = 'failed'").select("supplier_id")
    return e.workers.join(workers, "id", "left_anti").join(suppliers, "supplier_id", "left_anti").select("id")


_PEER = f"SELECT a.id AS anchor, p.id AS peer, row_number() OVER (PARTITION BY a.id ORDER BY p.warm DESC, p.rate DESC, p.id) AS r FROM (SELECT w.id, w.supplier_id, w.hw_class FROM {LIVE} w WHERE w.id % 10 = 1) a JOIN (SELECT c.*, w.supplier_id, w.hw_class FROM ({_CANDIDATES}) c JOIN workers w ON c.id = w.id) p ON p.hw_class = a.hw_class AND p.id <> a.id AND p.supplier_id <> a.supplier_id"


def peers(e: Exchange, pool: DataFrame) -> DataFrame:
    """The first independent peer of the anchor's class: another supplier, warm before cold, fast before slow.

    Of each class the best two per supplier are enough to answer any anchor that is not among them; so the join meets a
    short list per class and not all pairs.
    """
    order = [F.desc("warm"), F.desc("rate"), F.asc("id")]
    one = first(pool, ["hw_class", "supplier_id"], order)
    two = one.withColumn("k", F.row_number().over(Window.partitionBy("hw_class").orderBy(*order))).where("k <= 2")
    anchors = live_workers(e).where("id % 10 = 1").select(F.col("id").alias("anchor"), F.col("supplier_id").alias("s"), "hw_class")
    met = anchors.join(two.select("hw_class", F.col("id").alias("peer"), "supplier_id", "warm", "rate"), "hw_class").where("supplier_id <> s AND peer <> anchor")
    return first(met, ["anchor"], [F.desc("warm"), F.desc("rate"), F.asc("peer")]).select("anchor", "peer")


@query(f"SELECT anchor, peer FROM ({_PEER}) x WHERE r = 1")
def al_select_peer(e: Exchange) -> DataFrame:
    return peers(e, candidates(e))


@query(f"SELECT anchor, peer FROM (SELECT anchor, peer, row_number() OVER (PARTITION BY anchor ORDER BY r) AS q FROM ({_PEER}) x JOIN ({_CANDIDATES}) c ON c.id = x.peer WHERE c.warm AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.worker_id = x.peer AND t.status = 'running')) y WHERE q = 1")
def al_endgame_peer(e: Exchange) -> DataFrame:
    busy = e.tasks.where("status = 'running'").select(F.col("worker_id").alias("id"))
    return peers(e, candidates(e).where("warm").join(busy, "id", "left_anti"))


_CLAIM = f"SELECT t.id, t.job_id, row_number() OVER (ORDER BY (t.hedged_from IS NOT NULL) DESC, CASE j.tier WHEN 'priority' THEN 0 WHEN 'express' THEN 1 ELSE 2 END, t.created_at, t.id) AS r FROM tasks t JOIN jobs j ON t.job_id = j.id WHERE t.status IN ('queued', 'retrying') AND coalesce(t.visible_at, t.created_at) <= TS({AS_OF}) AND j.status IN ('queued', 'running', 'verifying') AND j.min_memory_gb <= 6 AND NOT EXISTS (SELECT 1 FROM tasks d WHERE d.job_id = t.job_id AND d.input_ref = t.input_ref AND d.status = 'complete' AND d.supplier_id = 7)"


@query(f"SELECT id, job_id, r AS position FROM ({_CLAIM}) c WHERE r <= 10")
def al_claim(e: Exchange, memory_gb: float = 6, supplier: int = 7, most: int = 10) -> DataFrame:
    """The next tasks that one worker may take, in claim order: visible, open job, enough memory, chunk new to its supplier."""
    lane = F.when(F.col("tier") == "priority", 0).when(F.col("tier") == "express", 1).otherwise(2)
    jobs = e.jobs.where(F.col("status").isin("queued", "running", "verifying") & (F.col("min_memory_gb") <= memory_gb)).select(F.col("id").alias("job_id"), "tier")
    done = e.tasks.where((F.col("status") == "complete") & (F.col("supplier_id") == supplier)).select("job_id", "input_ref")
    open_ = claimable(e).join(jobs, "job_id").join(done, ["job_id", "input_ref"], "left_anti").select("id", "job_id", F.col("hedged_from").isNotNull().alias("pin"), lane.alias("lane"), "created_at")
    order = [F.desc("pin"), F.asc("lane"), F.asc("created_at"), F.asc("id")]
    return open_.orderBy(*order).limit(most).select("id", "job_id", F.row_number().over(Window.orderBy(*order)).alias("position"))


_BUDGET = "SELECT j.id, j.budget_micros, CAST(coalesce(c.charged, 0) + coalesce(f.flight, 0) + coalesce(f.next, 0) + j.sla_premium_micros AS BIGINT) AS projected_micros, coalesce(f.waiting, 0) AS waiting FROM jobs j LEFT JOIN (SELECT job_id, -sum(amount_micros) AS charged FROM ledger WHERE kind = 'buyer_charge' GROUP BY job_id) c ON c.job_id = j.id LEFT JOIN (SELECT job_id, sum(charge_micros) FILTER (WHERE status IN ('running', 'verifying')) AS flight, max(charge_micros) FILTER (WHERE status IN ('queued', 'retrying')) AS next, count(*) FILTER (WHERE status IN ('queued', 'retrying')) AS waiting FROM tasks GROUP BY job_id) f ON f.job_id = j.id WHERE j.budget_micros IS NOT NULL"


def budgets(e: Exchange) -> DataFrame:
    """What a job will have cost once its running work and one more task are charged."""
    charged = e.ledger.where("kind = 'buyer_charge'").groupBy(F.col("job_id").alias("id")).agg((-F.sum("amount_micros")).alias("charged"))
    amount = lambda f, *status: f(F.when(F.col("status").isin(*status), F.col("charge_micros")))
    work = e.tasks.groupBy(F.col("job_id").alias("id")).agg(amount(F.sum, "running", "verifying").alias("flight"), amount(F.max, "queued", "retrying").alias("next"), F.count_if(F.col("status").isin("queued", "retrying")).alias("waiting"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = e.jobs.where("budget_micros IS NOT NULL").join(charged, "id", "left").join(work, "id", "left")
    return both.select("id", "budget_micros", (zero("charged") + zero("flight") + zero("next") + F.col("sla_premium_micros")).cast("long").alias("projected_micros"), zero("waiting").alias("waiting"))


@query(_BUDGET)
def al_budget_projection(e: Exchange) -> DataFrame:
    return budgets(e)


@query(f"SELECT id FROM ({_BUDGET}) b WHERE projected_micros > budget_micros AND waiting > 0")
def al_budget_pause(e: Exchange) -> DataFrame:
    return budgets(e).where("projected_micros > budget_micros AND waiting > 0").select("id")


@query(f"SELECT id FROM ({_BUDGET}) b WHERE projected_micros >= budget_micros * 0.8::DOUBLE AND projected_micros <= budget_micros")
def al_budget_warn(e: Exchange) -> DataFrame:
    return budgets(e).where("projected_micros >= budget_micros * 0.8D AND projected_micros <= budget_micros").select("id")


@query("""SELECT j.id AS job_id, count(t.id) AS tasks, count(t.id) FILTER (WHERE t.status = 'complete') AS done, CAST(coalesce(sum(t.charge_micros) FILTER (WHERE t.status = 'complete'), 0) AS BIGINT) AS charged_micros, array_to_string(list_sort(list_distinct(list(w.engine) FILTER (WHERE t.status = 'complete'))), ',') AS classes
    FROM jobs j JOIN tasks t ON t.job_id = j.id JOIN workers w ON t.worker_id = w.id WHERE j.status = 'complete' GROUP BY j.id""")
def al_receipt(e: Exchange) -> DataFrame:
    """One row per finished job: its tasks, what they cost, the classes of machine that did them."""
    done = F.col("status") == "complete"
    own = e.tasks.join(e.jobs.where("status = 'complete'").select(F.col("id").alias("job_id")), "job_id", "left_semi").join(e.workers.select(F.col("id").alias("worker_id"), "engine"), "worker_id")
    per = own.groupBy("job_id").agg(F.count("*").alias("tasks"), F.count_if(done).alias("done"), F.coalesce(F.sum(F.when(done, F.col("charge_micros"))), F.lit(0)).alias("charged_micros"), F.sort_array(F.collect_set(F.when(done, F.col("engine")))).alias("classes"))
    return per.withColumn("classes", F.when(F.size("classes") > 0, F.array_join("classes", ",")))


@query("SELECT job_id, id AS source_id, 'clone' AS kind FROM (SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY sha256(concat(CAST(job_id AS VARCHAR), '/', CAST(id AS VARCHAR)))) AS r, count(*) OVER (PARTITION BY job_id) AS n FROM tasks WHERE NOT is_redundancy AND NOT is_honeypot) x WHERE r <= floor(n * 0.25::DOUBLE + 0.5) UNION ALL SELECT job_id, id, 'primary' FROM tasks WHERE NOT is_redundancy AND NOT is_honeypot")
def al_redundancy_expand(e: Exchange, frac: float = 0.25) -> DataFrame:
    own = e.tasks.where("NOT is_redundancy AND NOT is_honeypot").select("job_id", F.col("id").alias("source_id"))
    mark = F.sha2(F.concat_ws("/", "job_id", "source_id").cast("binary"), 256)
    w = Window.partitionBy("job_id")
    picked = own.select("*", F.row_number().over(w.orderBy(mark)).alias("r"), F.count("*").over(w).alias("n")).where(F.col("r") <= money.frac_count(F.col("n"), F.lit(frac)))
    return picked.select("job_id", "source_id", F.lit("clone").alias("kind")).unionByName(own.withColumn("kind", F.lit("primary")))


@query(f"SELECT id, net_micros, net_micros >= 500000 AS due FROM (SELECT j.id, CAST(greatest(0, CASE WHEN j.firm_max_micros IS NOT NULL THEN least(j.actual_micros, j.firm_max_micros) ELSE j.actual_micros END - coalesce(r.refund_micros, 0)) AS BIGINT) AS net_micros FROM jobs j LEFT JOIN refunds r ON r.job_id = j.id WHERE j.status = 'complete' AND j.merged_at < TS({AS_OF - DAY}) AND j.actual_micros IS NOT NULL) x")
def al_charge_due(e: Exchange) -> DataFrame:
    done = firm_charges(e).where((F.col("status") == "complete") & (F.col("merged_at") < e.ago(DAY)) & F.col("actual_micros").isNotNull())
    return done.select("id", "net_micros", (F.col("net_micros") >= 500_000).alias("due"))


@query("SELECT s.id, sum(w.score) AS pool_score FROM suppliers s JOIN (SELECT w.supplier_id, " + SCORE + f" AS score FROM {LIVE} w) w ON w.supplier_id = s.id GROUP BY s.id")
def al_match_pool(e: Exchange) -> DataFrame:
    scored = live_workers(e).select("supplier_id", match_score(F.col("id") % 2 == 0).alias("score"))
    return scored.groupBy(F.col("supplier_id").alias("id")).agg(F.sum("score").alias("pool_score"))
