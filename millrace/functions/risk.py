"""Risk, reputation and policy expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the exchange.
REPUTATION = {
    "task_success": 0.001, "honeypot_pass": 0.002, "redundancy_match": 0.001, "mismatch": -0.1, "honeypot_fail": -0.15, "timeout": -0.02,
    "thermal_throttle": -0.005, "result_corrupt": -0.2, "artifact_oversize": -0.2, "spoofing_detected": -1.0,
}
RETRYABLE = ("oom", "model_load_failed", "thermal_throttle", "timeout", "worker_shutdown", "transient_io", "object_store_error", "internal_error")
BUYER_FAULT = ("unsupported_model", "unsupported_job_type", "bad_input", "bad_jsonl")
FINAL = (*BUYER_FAULT, "cancelled", "verification_failed")
TRUST_FLOOR, LEAST_PROBABILITY = 0.90, 0.25
FLOOR_BYTES, MOST_BYTES, MOST_TOKENS = 1 << 20, 1 << 30, 8_192


def reputation_delta(event: Column) -> Column:
    out = F.lit(0.0)
    for name, delta in REPUTATION.items():
        out = F.when(event == name, delta).otherwise(out)
    return out


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def reputation_tier(reputation: Column, done: Column) -> Column:
    at = lambda r, n: (reputation >= r) & (done >= n)
    return F.when(at(0.90, 5000), 3).when(at(0.80, 500), 2).when(at(0.60, 100), 1).otherwise(0)


def check_probability(reputation: Column) -> Column:
    """1 up to the trust floor or for no reputation, falling in a line to LEAST_PROBABILITY at 1."""
    fall = (F.least(reputation, F.lit(1.0)) - TRUST_FLOOR) / (1.0 - TRUST_FLOOR) * (1.0 - LEAST_PROBABILITY)
    return F.when(reputation.isNull() | (reputation <= TRUST_FLOOR), 1.0).otherwise(F.greatest(F.lit(LEAST_PROBABILITY), 1.0 - fall))


def oom_risk(eligible: Column) -> Column:
    return F.when(eligible == 0, "high").when(eligible < 3, "medium").otherwise("low")


def confidence(eligible: Column, warm: Column, floor_gb: Column, records: Column, malformed: Column) -> Column:
    """0.8 and what supply, catalogue, warmth and input add or take, within 0.05 and 0.95."""
    score = F.lit(0.8) - F.when(eligible == 0, 0.3).when(eligible < 3, 0.1).otherwise(0.0) - F.when(floor_gb > 0, 0.0).otherwise(0.1)
    score = score + F.when(warm > 0, 0.1).otherwise(0.0) - F.when(records == 0, 0.4).otherwise(0.0) - F.when(malformed > 0, 0.2).otherwise(0.0)
    return F.round(clamp(score, 0.05, 0.95), 6)


def artifact_cap(job_type: Column, records: Column, split: Column, max_tokens: Column) -> Column:
    """Most bytes that a result may have, in decimal arithmetic that cannot wrap."""
    rows = F.when(records > 0, records).when(split > 0, split).otherwise(256).cast("decimal(20,0)")
    tokens = F.least(F.when(max_tokens > 0, max_tokens).otherwise(256), F.lit(MOST_TOKENS))
    more = F.when(job_type == "embed", rows * 16_384).when(job_type == "batch_infer", rows * (tokens * 128 + 2_048)).otherwise(F.lit(0))
    return F.least(F.lit(FLOOR_BYTES) + more, F.lit(MOST_BYTES)).cast("long")


def throttle_reason(total: Column, available: Column, headroom: Column, most_pct: Column, need: Column) -> Column:
    """Which memory rule holds a worker back; null for none."""
    room = F.greatest(headroom, F.lit(0.0))
    used = (total - available) / total * 100
    return F.when((most_pct > 0) & (used >= most_pct), "pressure").when((room > 0) & (available <= room), "headroom").when(need > F.greatest(available - room, F.lit(0.0)), "next_task")


def batch_width(kv_bytes: Column, prompt: Column, max_tokens: Column, available_gb: Column, most_len: int = 4_096) -> Column:
    row = kv_bytes * F.least(prompt + max_tokens, F.lit(most_len))
    return F.when((row > 0) & (available_gb > 0), F.greatest(F.floor(available_gb * 0.5 * 1e9 / row), F.lit(1))).cast("long")


def failure_policy(name: Column) -> tuple[Column, Column]:
    """(retryable, buyer's fault); an unknown class is retried."""
    return ~name.isin(*FINAL), name.isin(*BUYER_FAULT)


def failure_class(message: Column, low_memory: Column) -> Column:
    m = F.lower(message)
    store = m.contains("input_url") | m.contains("output_url") | m.contains("presigned")
    return F.when(store, "object_store_error").when(low_memory | m.contains("out of memory") | m.contains("oom"), "oom").otherwise("internal_error")


def verification_label(delivered: Column, verified: Column, matched: Column, tiebreaks: Column, checked: Column, same: Column, skipped: Column) -> Column:
    """The first of seven labels that the counts allow."""
    out = F.when((delivered > 0) & (verified >= delivered), "fully-verified").when((delivered > 0) & (verified > 0), "sampled-verified").when((delivered == 0) & ((matched > 0) | (tiebreaks > 0)), "verified")
    return out.when(checked > 0, "honeypot-checked").when(same > 0, "no-independent-peer").when(skipped > 0, "cross-class-skip").otherwise("unverified")
