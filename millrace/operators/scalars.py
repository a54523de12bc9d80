"""Queries that apply the column functions over whole entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money, risk, text
from ..plans.entities import AS_OF, Exchange
from ..plans.registry import query
from .aggregates import VERIFIED, seconds, verification_counts
from .relations import RANK, SCORE, hw_rank, match_score

ROUND = lambda x: f"(sign({x}) * floor(abs({x}) * 1e6 + 0.5) / 1e6)"
TIER = "CASE tier WHEN 'priority' THEN 1.5 WHEN 'trusted' THEN 2.0 ELSE 1.0 END::DOUBLE"
USD = "(estimated_micros / 7.0::DOUBLE / 1e5)"
LINE = "(id % 700)::DOUBLE"


@query(f"SELECT id, {ROUND(USD)} AS rounded, {ROUND('-' + USD)} AS negative, ceil(({USD} - 1e-12) * 1e6) / 1e6 AS ceiled FROM jobs")
def sc_round_usd(e: Exchange) -> DataFrame:
    v = F.col("estimated_micros") / F.lit(7.0) / F.lit(1e5)
    return e.jobs.select("id", money.round_usd(v).alias("rounded"), money.round_usd(-v).alias("negative"), money.ceil_usd(v).alias("ceiled"))


@query("SELECT id, CASE WHEN (id % 11 - 2) / 10.0::DOUBLE <= 0 THEN 0 ELSE CAST(least(id % 40, floor((id % 40) * ((id % 11 - 2) / 10.0::DOUBLE) + 0.5)) AS BIGINT) END AS n FROM jobs")
def sc_frac_count(e: Exchange) -> DataFrame:
    return e.jobs.select("id", money.frac_count(F.col("id") % 40, (F.col("id") % 11 - 2) / F.lit(10.0)).alias("n"))


@query(f"SELECT j.id, {ROUND(f'(greatest((j.id % 90)::DOUBLE, (j.id % 9000) / 4.0::DOUBLE) + CASE WHEN j.job_type = $$batch_infer$$ AND j.id % 90 > 0 THEN (j.id % 90) * (CASE WHEN j.max_tokens = 0 THEN 256 ELSE j.max_tokens END) ELSE 0 END) / 1000.0::DOUBLE * m.price_per_1k * {TIER}')} AS usd, {TIER} AS factor FROM jobs j JOIN models m ON m.id = j.model_ref")
def sc_estimate_usd(e: Exchange) -> DataFrame:
    price = F.broadcast(e.models.select(F.col("id").alias("model_ref"), "price_per_1k"))  # one row per advertised model
    usd = money.estimate_usd(F.col("job_type"), F.col("id") % 9000, F.col("id") % 90, F.col("max_tokens"), F.col("tier"), F.col("price_per_1k"))
    return e.jobs.join(price, "model_ref").select("id", usd.alias("usd"), money.tier_factor(F.col("tier")).alias("factor"))


_RATE = f"greatest(CASE job_type WHEN 'embed' THEN 200.0::DOUBLE WHEN 'batch_infer' THEN 4.0::DOUBLE ELSE 10.0::DOUBLE END * CASE WHEN job_type = 'batch_infer' AND {LINE} > 140 THEN 140.0::DOUBLE / {LINE} ELSE 1.0::DOUBLE END, 0.2::DOUBLE)"


@query(f"SELECT id, {_RATE} AS rate, CAST(least(greatest(floor({_RATE} * 45), 1), 4096) AS BIGINT) AS split_size, greatest(CASE WHEN max_tokens <= 0 THEN 256 ELSE max_tokens END + {LINE} / 4.0::DOUBLE, 1.0::DOUBLE) AS tokens_per_item FROM jobs")
def sc_throughput(e: Exchange) -> DataFrame:
    line = (F.col("id") % 700).cast("double")
    return e.jobs.select("id", money.throughput(F.col("job_type"), line).alias("rate"), money.split_size(F.col("job_type"), line).alias("split_size"), money.tokens_per_item(F.col("max_tokens"), line).alias("tokens_per_item"))


@query("""SELECT id, CAST(CASE WHEN coalesce(eta_secs, 0) <= 0 THEN 45 ELSE floor((eta_secs * 77 + 999) / 1000) END AS BIGINT) AS per_task_secs, CAST(greatest(floor((id % 500 + id % 20 + greatest(id % 6, 1) - 1) / greatest(id % 6, 1)) * 45, 45) AS BIGINT) AS waves_secs,
    CAST(CASE WHEN tier <> 'batch' OR id % 4 = 0 OR coalesce(eta_secs, 0) < 120 THEN coalesce(eta_secs, 0) ELSE ceil(eta_secs * (1.0::DOUBLE / (1.0::DOUBLE - 0.366::DOUBLE))) END AS BIGINT) AS sustained_secs, CAST(CASE WHEN coalesce(eta_secs, 0) <= 0 THEN 0 ELSE ceil(eta_secs * 1.25::DOUBLE) + 60 END AS BIGINT) AS sla_secs FROM jobs""")
def sc_eta(e: Exchange) -> DataFrame:
    eta = F.coalesce("eta_secs", F.lit(0))
    return e.jobs.select("id", money.per_task_secs(eta * 77).alias("per_task_secs"), money.eta_waves(F.col("id") % 500, F.col("id") % 20, F.col("id") % 6, F.lit(45)).alias("waves_secs"), money.sustained_eta(eta, F.col("tier"), F.col("id") % 4 == 0).alias("sustained_secs"), money.sla_secs(eta).alias("sla_secs"))


@query(f"SELECT id, CASE WHEN id % 2 = 0 AND id % 3 <> 0 AND coalesce(eta_secs, 0) > 0 AND {ROUND(f'{USD} * 0.15::DOUBLE')} > 0 THEN {ROUND(f'{USD} * 0.15::DOUBLE')} END AS premium_usd, CAST(greatest(0, least(sla_premium_micros, coalesce(actual_micros, 0) - 20000)) AS BIGINT) AS refund_micros, coalesce(EPOCH(merged_at) - EPOCH(created_at) > sla_secs, false) AS missed FROM jobs")
def sc_sla(e: Exchange) -> DataFrame:
    usd = F.col("estimated_micros") / F.lit(7.0) / F.lit(1e5)
    premium = money.sla_premium(F.col("id") % 2 == 0, F.col("id") % 3 != 0, F.coalesce("eta_secs", F.lit(0)), usd)
    refund = money.sla_refund(F.col("sla_premium_micros"), F.coalesce("actual_micros", F.lit(0)) - 20_000)
    return e.jobs.select("id", premium.alias("premium_usd"), refund.cast("long").alias("refund_micros"), F.coalesce(seconds("merged_at") - seconds("created_at") > F.col("sla_secs"), F.lit(False)).alias("missed"))


_WATTS = "CASE w.hw_class WHEN 'base' THEN 20 WHEN 'pro' THEN 30 WHEN 'max' THEN 60 ELSE 0 END"


@query(f"SELECT b.id, CASE WHEN greatest(b.tps, b.eps) * 3600.0 / 1000.0 * 0.97 > 0 THEN (2.0 + CASE WHEN {_WATTS} > 0 THEN {_WATTS} ELSE 30.0 END / 1000.0::DOUBLE * 0.10::DOUBLE) / (greatest(b.tps, b.eps) * 3600.0::DOUBLE / 1000.0::DOUBLE * 0.97::DOUBLE) ELSE 0.0 END AS price_per_1k FROM benchmarks b JOIN workers w ON b.worker_id = w.id")
def sc_reprice(e: Exchange) -> DataFrame:
    watts = F.when(F.col("hw_class") == "base", 20).when(F.col("hw_class") == "pro", 30).when(F.col("hw_class") == "max", 60).otherwise(0)
    own = e.benchmarks.select("id", "worker_id", F.greatest("tps", "eps").alias("rate")).join(e.workers.select(F.col("id").alias("worker_id"), "hw_class"), "worker_id")
    return own.select("id", money.reprice(F.col("rate"), watts, 0.97, 0.10).alias("price_per_1k"))


@query("SELECT b.worker_id, greatest(0.0::DOUBLE, max(CASE WHEN b.tps > 0 THEN b.tps ELSE b.eps END * 3600.0::DOUBLE / 1000.0::DOUBLE * m.price_per_1k * 0.97::DOUBLE - 0.0045::DOUBLE) * 24) AS daily_usd FROM benchmarks b JOIN models m ON m.id = b.model_ref GROUP BY b.worker_id")
def sc_projected_daily(e: Exchange) -> DataFrame:
    price = F.broadcast(e.models.select(F.col("id").alias("model_ref"), "price_per_1k"))  # one row per advertised model
    rate = F.when(F.col("tps") > 0, F.col("tps")).otherwise(F.col("eps"))
    net = rate * 3600.0 / 1000.0 * F.col("price_per_1k") * 0.97 - 0.0045
    return e.benchmarks.join(price, "model_ref").groupBy("worker_id").agg(F.greatest(F.lit(0.0), F.max(net) * 24).alias("daily_usd"))


@query("SELECT j.id, CASE j.job_type WHEN 'embed' THEN 200.0::DOUBLE ELSE 4.0::DOUBLE END * 3600.0::DOUBLE / 1000.0::DOUBLE * m.price_per_1k AS usd_hour FROM jobs j JOIN models m ON m.id = j.model_ref")
def sc_offered_rate(e: Exchange) -> DataFrame:
    price = F.broadcast(e.models.select(F.col("id").alias("model_ref"), "price_per_1k"))  # one row per advertised model
    return e.jobs.join(price, "model_ref").select("id", (money.static_rate(F.col("job_type")) * 3600.0 / 1000.0 * F.col("price_per_1k")).alias("usd_hour"))


_DELTA = "CASE kind WHEN 'redundancy_match' THEN 0.001 WHEN 'honeypot_pass' THEN 0.002 WHEN 'honeypot_fail' THEN -0.15 WHEN 'timeout' THEN -0.02 WHEN 'spoofing_detected' THEN -1.0 ELSE 0.0 END::DOUBLE"


@query(f"SELECT v.id, {_DELTA} AS delta, greatest(0.0::DOUBLE, least(1.0::DOUBLE, s.reputation + {_DELTA})) AS after, CASE WHEN s.reputation >= 0.9 AND s.completed_tasks >= 5000 THEN 3 WHEN s.reputation >= 0.8 AND s.completed_tasks >= 500 THEN 2 WHEN s.reputation >= 0.6 AND s.completed_tasks >= 100 THEN 1 ELSE 0 END AS tier FROM verifications v JOIN suppliers s ON v.supplier_id = s.id")
def sc_reputation(e: Exchange) -> DataFrame:
    delta = risk.reputation_delta(F.col("kind"))
    both = e.verifications.select("id", "kind", "supplier_id").join(e.suppliers.select(F.col("id").alias("supplier_id"), "reputation", "completed_tasks"), "supplier_id")
    return both.select("id", delta.alias("delta"), risk.clamp(F.col("reputation") + delta).alias("after"), risk.reputation_tier(F.col("reputation"), F.col("completed_tasks")).alias("tier"))


@query(f"SELECT w.id, {SCORE} AS score, {RANK.format('w.hw_class')} AS rank, CASE WHEN s.reputation <= 0.9 THEN 1.0 ELSE greatest(0.25::DOUBLE, 1.0::DOUBLE - (least(s.reputation, 1.0::DOUBLE) - 0.9::DOUBLE) / (1.0::DOUBLE - 0.9::DOUBLE) * (1.0::DOUBLE - 0.25::DOUBLE)) END AS check_probability FROM (SELECT w.*, s.reputation FROM workers w JOIN suppliers s ON w.supplier_id = s.id) w JOIN suppliers s ON w.supplier_id = s.id")
def sc_worker_scores(e: Exchange) -> DataFrame:
    both = e.workers.join(e.suppliers.select(F.col("id").alias("supplier_id"), "reputation"), "supplier_id")
    return both.select("id", match_score(F.col("id") % 2 == 0).alias("score"), hw_rank(F.col("hw_class")).alias("rank"), risk.check_probability(F.col("reputation")).alias("check_probability"))


@query("SELECT id, CAST(floor(amount_micros / 10000) AS BIGINT) AS cents, CAST(amount_micros - floor(amount_micros / 10000) * 10000 AS BIGINT) AS rest_micros FROM ledger WHERE kind = 'supplier_credit'")
def sc_split_cents(e: Exchange) -> DataFrame:
    cents, rest = money.split_cents(F.col("amount_micros"))
    return e.ledger.where("kind = 'supplier_credit'").select("id", cents.alias("cents"), rest.alias("rest_micros"))


@query("SELECT id, CAST(least(600.0, 30 * pow(2, least(retry_count, 20))) AS BIGINT) AS requeue_secs, CAST(least(greatest(retry_count, 1) * 1800, 21600) AS BIGINT) AS charge_retry_secs, completed_at + to_seconds(greatest(86400, id % 200000)) AS release_at FROM tasks")
def sc_backoffs(e: Exchange) -> DataFrame:
    release = F.col("completed_at") + F.make_dt_interval(secs=F.greatest(F.lit(86_400), F.col("id") % 200_000).cast("decimal(18,6)"))
    return e.tasks.select("id", money.requeue_secs(F.col("retry_count")).alias("requeue_secs"), money.charge_retry_secs(F.col("retry_count")).alias("charge_retry_secs"), release.alias("release_at"))


@query("""SELECT id, CASE WHEN id % 5 = 0 THEN 'high' WHEN id % 5 < 3 THEN 'medium' ELSE 'low' END AS oom, round(greatest(0.05::DOUBLE, least(0.95::DOUBLE, 0.8::DOUBLE - CASE WHEN id % 5 = 0 THEN 0.3 WHEN id % 5 < 3 THEN 0.1 ELSE 0.0 END - CASE WHEN min_memory_gb > 1 THEN 0.0 ELSE 0.1 END + CASE WHEN id % 2 > 0 THEN 0.1 ELSE 0.0 END - CASE WHEN id % 7 = 0 THEN 0.4 ELSE 0.0 END - CASE WHEN id % 9 > 6 THEN 0.2 ELSE 0.0 END)), 6) AS confidence FROM jobs""")
def sc_assess_risk(e: Exchange) -> DataFrame:
    i = F.col("id")
    score = risk.confidence(i % 5, i % 2, F.col("min_memory_gb") - 1, i % 7, F.when(i % 9 > 6, 1).otherwise(0))
    return e.jobs.select("id", risk.oom_risk(i % 5).alias("oom"), score.alias("confidence"))


@query("SELECT id, CAST(least(1048576 + CASE job_type WHEN 'embed' THEN (CASE WHEN id % 300 > 0 THEN id % 300 ELSE 256 END)::HUGEINT * 16384 ELSE (CASE WHEN id % 300 > 0 THEN id % 300 ELSE 256 END)::HUGEINT * (least(CASE WHEN max_tokens > 0 THEN max_tokens ELSE 256 END, 8192) * 128 + 2048) END, 1073741824) AS BIGINT) AS most_bytes FROM jobs")
def sc_artifact_cap(e: Exchange) -> DataFrame:
    return e.jobs.select("id", risk.artifact_cap(F.col("job_type"), F.col("id") % 300, F.lit(0), F.col("max_tokens")).alias("most_bytes"))


@query("""SELECT id, CASE WHEN (memory_gb - effective_gb) / memory_gb * 100 >= 80 THEN 'pressure' WHEN id % 4 > 0 AND effective_gb <= id % 4 THEN 'headroom' WHEN 6.0 > greatest(effective_gb - id % 4, 0.0) THEN 'next_task' END AS reason,
    CAST(greatest(floor(effective_gb * 0.5 * 1e9 / (131072 * least(id % 3000 + 256, 4096))), 1) AS BIGINT) AS width FROM workers""")
def sc_throttle(e: Exchange) -> DataFrame:
    reason = risk.throttle_reason(F.col("memory_gb"), F.col("effective_gb"), (F.col("id") % 4).cast("double"), F.lit(80.0), F.lit(6.0))
    return e.workers.select("id", reason.alias("reason"), risk.batch_width(F.lit(131_072), F.col("id") % 3000, F.lit(256), F.col("effective_gb")).alias("width"))


@query("SELECT id, eta_secs AS predicted, CAST(greatest(0, round(EPOCH(merged_at) - EPOCH(created_at))) AS BIGINT) AS realised FROM jobs WHERE merged_at IS NOT NULL AND eta_secs IS NOT NULL")
def sc_eta_calibration(e: Exchange) -> DataFrame:
    done = e.jobs.where("merged_at IS NOT NULL AND eta_secs IS NOT NULL")
    return done.select("id", F.col("eta_secs").alias("predicted"), F.greatest(F.lit(0), F.round(seconds("merged_at") - seconds("created_at"))).cast("long").alias("realised"))


@query(f"SELECT count(*) FILTER (WHERE created_at > TS({AS_OF - 60})) AS minute, count(*) FILTER (WHERE created_at > TS({AS_OF - 3600})) AS hour, count(*) FILTER (WHERE created_at > TS({AS_OF - 86400})) AS day FROM jobs")
def sc_interval_windows(e: Exchange) -> DataFrame:
    return e.jobs.agg(*[F.count_if(F.col("created_at") > e.ago(s)).alias(n) for n, s in (("minute", 60), ("hour", 3600), ("day", 86_400))])


# Text, hash, vectors


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 WHEN length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))::DOUBLE / octet_length(encode(text)) < 0.5 THEN CAST(ceil(length(text) * 0.9::DOUBLE) AS BIGINT) ELSE CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT) END AS tokens FROM documents")
def fn_tokens(e: Exchange) -> DataFrame:
    return e.documents.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT event_id, json_type(props, '$.k') AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json_get(e: Exchange) -> DataFrame:
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json("props"), "$.k", "variant"))
    return e.events.select("event_id", F.when(kind == "BIGINT", "UBIGINT").otherwise(kind).alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def fn_sha256(e: Exchange) -> DataFrame:
    return e.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


_PAD = lambda x: "unhex('" + bytes(b ^ x for b in b"secret".ljust(64, b"\0")).hex() + "')"
_PROBABILITY = "CASE WHEN s.reputation <= 0.9 THEN 1.0 ELSE greatest(0.25::DOUBLE, 1.0::DOUBLE - (least(s.reputation, 1.0::DOUBLE) - 0.9::DOUBLE) / (1.0::DOUBLE - 0.9::DOUBLE) * (1.0::DOUBLE - 0.25::DOUBLE)) END"


@query(f"""SELECT id, unit, p <= 0 OR p >= 1 OR unit < p AS checked FROM (SELECT t.id, {_PROBABILITY} AS p, CAST(concat('0x', substr(sha256({_PAD(0x5C)} || unhex(sha256({_PAD(0x36)} || encode(concat('sample|', CAST(t.id AS VARCHAR)))))), 1, 16)) AS UBIGINT)::DOUBLE / {2.0**64!r} AS unit
    FROM tasks t JOIN suppliers s ON t.supplier_id = s.id WHERE t.status = 'complete') x""")
def fn_hmac_sample(e: Exchange) -> DataFrame:
    """Which finished tasks are checked: HMAC of the task under the secret against the supplier's check probability."""
    prob = e.suppliers.select(F.col("id").alias("supplier_id"), risk.check_probability(F.col("reputation")).alias("p"))
    unit = text.hmac_unit("secret", F.concat(F.lit("sample|"), F.col("id").cast("string")))
    return e.tasks.where("status = 'complete'").join(prob, "supplier_id").select("id", unit.alias("unit"), text.sampled(unit, F.col("p")).alias("checked"))


@query("SELECT id, CAST(concat('0x', substr(sha256(concat(CAST(job_id AS VARCHAR), '|', CAST(id AS VARCHAR))), 1, 12)) AS BIGINT) AS mark FROM tasks")
def fn_selection_hash(e: Exchange) -> DataFrame:
    data = F.concat_ws("|", "job_id", "id").cast("binary")
    return e.tasks.select("id", F.conv(F.substring(F.sha2(data, 256), 1, 12), 16, 10).cast("long").alias("mark"))


@query("SELECT id, CASE WHEN trim(CASE WHEN build_hash = 'b0' THEN ' ' ELSE build_hash END) = '' THEN '' ELSE concat(engine, '|', build_hash) END AS class FROM workers")
def fn_class_key(e: Exchange) -> DataFrame:
    build = F.when(F.col("build_hash") == "b0", " ").otherwise(F.col("build_hash"))
    return e.workers.select("id", text.class_key(F.col("engine"), build).alias("class"))


@query("SELECT doc_id, regexp_full_match(source, 'src[0-9]{1,2}') AS shaped, starts_with(source, 'src1') AS prefixed, list_contains(['en', 'de'], lang) AS listed FROM documents")
def fn_shapes(e: Exchange) -> DataFrame:
    return e.documents.select("doc_id", F.col("source").rlike("^src[0-9]{1,2}$").alias("shaped"), F.col("source").startswith("src1").alias("prefixed"), F.array_contains(F.array(F.lit("en"), F.lit("de")), F.col("lang")).alias("listed"))


@query("SELECT id, class, class NOT IN ('bad_input', 'bad_jsonl', 'unsupported_model', 'unsupported_job_type', 'cancelled', 'verification_failed') AS retryable, class IN ('unsupported_model', 'unsupported_job_type', 'bad_input', 'bad_jsonl') AS buyer_fault, CASE WHEN contains(lower(class), 'presigned') THEN 'object_store_error' WHEN contains(lower(class), 'oom') THEN 'oom' ELSE 'internal_error' END AS derived FROM failures")
def fn_failure_policy(e: Exchange) -> DataFrame:
    retry, fault = risk.failure_policy(F.col("class"))
    return e.failures.select("id", "class", retry.alias("retryable"), fault.alias("buyer_fault"), risk.failure_class(F.col("class"), F.lit(False)).alias("derived"))


_PAIRS = "(SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS a, list_transform(b.embedding, lambda x: x::DOUBLE) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(f"SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 9) AS similarity FROM {_PAIRS} p")
def fn_cosine(e: Exchange) -> DataFrame:
    after = e.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.embeddings.join(after, "vec_id").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("next")), 9).alias("similarity"))


@query(f"SELECT vec_id % 10 AS part, round(avg(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))), 9) AS mean_similarity FROM {_PAIRS} p GROUP BY vec_id % 10")
def fn_mean_cosine(e: Exchange) -> DataFrame:
    after = e.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    both = e.embeddings.join(after, "vec_id").select((F.col("vec_id") % 10).alias("part"), text.cosine(F.col("embedding"), F.col("next")).alias("s"))
    return both.groupBy("part").agg(F.round(F.avg("s"), 9).alias("mean_similarity"))


@query(f"SELECT job_id, CASE WHEN delivered > 0 AND verified >= delivered THEN 'fully-verified' WHEN delivered > 0 AND verified > 0 THEN 'sampled-verified' WHEN delivered = 0 AND (redundancy_match > 0 OR tiebreak_win > 0) THEN 'verified' WHEN honeypot_pass + honeypot_fail > 0 THEN 'honeypot-checked' ELSE 'unverified' END AS label FROM ({VERIFIED}) v")
def al_label(e: Exchange) -> DataFrame:
    c = {k: F.col(k) for k in ("delivered", "verified", "redundancy_match", "tiebreak_win")}
    label = risk.verification_label(c["delivered"], c["verified"], c["redundancy_match"], c["tiebreak_win"], F.col("honeypot_pass") + F.col("honeypot_fail"), F.lit(0), F.lit(0))
    return verification_counts(e).select("job_id", label.alias("label"))
