"""Money, price and estimate expressions: Columns in, Columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the exchange.
TIER_FACTORS = {"priority": 1.5, "trusted": 2.0}
RATES = {"embed": 200.0, "batch_infer": 4.0}
DEFAULT_TOKENS, TARGET_SECS, MOST_SPLIT = 256, 45, 4096
SLA_MARGIN, SLA_MERGE_SECS, SLA_PREMIUM = 1.25, 60, 0.15
SUSTAINED_GAP, SUSTAINED_FROM = 0.366, 120
TARGET_USD_HOUR, DEFAULT_WATTS = 2.0, 30.0


def round_usd(v: Column) -> Column:
    """To six decimals, halves away from zero."""
    return F.signum(v) * F.floor(F.abs(v) * 1e6 + 0.5) / 1e6


def ceil_usd(v: Column) -> Column:
    """Up to six decimals, but for a rounding error of 1e-12."""
    return F.ceil((v - 1e-12) * 1e6) / 1e6


def frac_count(n: Column, frac: Column) -> Column:
    return F.when(frac <= 0, F.lit(0)).otherwise(F.least(n, F.floor(n * frac + 0.5))).cast("long")


def tier_factor(tier: Column) -> Column:
    return F.when(tier == "priority", 1.5).when(tier == "trusted", 2.0).otherwise(1.0)


def estimate_usd(job_type: Column, size: Column, lines: Column, max_tokens: Column, tier: Column, price: Column) -> Column:
    """Units are lines or a quarter of the bytes, whichever is more, and the tokens a generating job may write."""
    units = F.greatest(lines.cast("double"), size / 4.0)
    tokens = F.when(max_tokens == 0, DEFAULT_TOKENS).otherwise(max_tokens)
    units = units + F.when((job_type == "batch_infer") & (lines > 0), lines * tokens).otherwise(0)
    return round_usd(units / 1000.0 * price * tier_factor(tier))


def static_rate(job_type: Column) -> Column:
    return F.when(job_type == "embed", 200.0).when(job_type == "batch_infer", 4.0).otherwise(10.0)


def throughput(job_type: Column, line_bytes: Column) -> Column:
    """Records a second; generating slows down with lines over 140 bytes, to no less than 0.2."""
    slowed = static_rate(job_type) * F.when((job_type == "batch_infer") & (line_bytes > 140), 140.0 / line_bytes).otherwise(1.0)
    return F.greatest(slowed, F.lit(0.2))


def split_size(job_type: Column, line_bytes: Column) -> Column:
    return F.least(F.greatest(F.floor(throughput(job_type, line_bytes) * TARGET_SECS), F.lit(1)), F.lit(MOST_SPLIT)).cast("long")


def tokens_per_item(max_tokens: Column, line_bytes: Column) -> Column:
    out = F.when(max_tokens <= 0, DEFAULT_TOKENS).otherwise(max_tokens)
    return F.greatest(out + F.greatest(line_bytes, F.lit(0)) / 4.0, F.lit(1.0))


def per_task_secs(p90_ms: Column) -> Column:
    return F.when(F.coalesce(p90_ms, F.lit(0)) <= 0, TARGET_SECS).otherwise(F.floor((p90_ms + 999) / 1000)).cast("long")


def eta_waves(queued: Column, tasks: Column, workers: Column, per_task: Column) -> Column:
    able = F.greatest(workers, F.lit(1))
    return F.greatest(F.floor((queued + tasks + able - 1) / able) * per_task, per_task).cast("long")


def sustained_eta(p50: Column, tier: Column, observed: Column) -> Column:
    """Long batch jobs without history of their own take longer than a peak rate promises."""
    longer = F.ceil(p50 * (1.0 / (1.0 - SUSTAINED_GAP)))
    return F.when((tier != "batch") | observed | (p50 < SUSTAINED_FROM), p50).otherwise(longer).cast("long")


def sla_secs(conservative: Column) -> Column:
    return F.when(conservative <= 0, 0).otherwise(F.ceil(conservative * SLA_MARGIN) + SLA_MERGE_SECS).cast("long")


def sla_premium(able: Column, planned: Column, conservative: Column, expected_usd: Column) -> Column:
    """The premium of an offered guarantee; null where none is offered."""
    premium = round_usd(expected_usd * SLA_PREMIUM)
    return F.when(able & planned & (conservative > 0) & (premium > 0), premium)


def sla_refund(premium: Column, chargeable: Column) -> Column:
    return F.greatest(F.lit(0), F.least(premium, chargeable))


def reprice(units_per_sec: Column, watts: Column, share: float, usd_per_kwh: float) -> Column:
    """Price per 1000 units at which a supplier earns the target and the electricity."""
    power = F.when(watts > 0, watts).otherwise(DEFAULT_WATTS) / 1000.0 * usd_per_kwh
    sold = units_per_sec * 3600.0 / 1000.0 * share
    return F.when(sold > 0, (TARGET_USD_HOUR + power) / sold).otherwise(0.0)


def split_cents(micros: Column) -> tuple[Column, Column]:
    """(whole cents, the rest in micro-USD that stays owed)."""
    return F.floor(micros / 10_000).cast("long"), F.pmod(micros, F.lit(10_000))


def requeue_secs(retries: Column) -> Column:
    return F.least(F.lit(600.0), 30 * F.pow(F.lit(2.0), F.least(retries, F.lit(20)))).cast("long")


def charge_retry_secs(attempts: Column) -> Column:
    return F.least(F.greatest(attempts, F.lit(1)) * 1800, F.lit(21_600)).cast("long")
