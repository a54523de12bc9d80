"""Literal cases of the column functions, readers and codecs."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from millrace.functions import money, risk, text
from millrace.operators.decisions import fanout
from millrace.sources import jsonl, packed


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_money(spark):
    lit = F.lit
    assert one(spark, money.round_usd(lit(0.0000005)), money.round_usd(lit(-0.0000005)), money.ceil_usd(lit(0.1000001))) == (0.000001, -0.000001, 0.100001)
    assert one(spark, money.sla_secs(lit(100)), money.sla_secs(lit(0))) == (185, 0)
    assert one(spark, *[money.requeue_secs(lit(n)) for n in (0, 1, 4, 5)]) == (30, 60, 480, 600)
    assert one(spark, *money.split_cents(lit(1_234_567))) == (123, 4_567)
    assert one(spark, money.reprice(lit(1000.0), lit(30), 0.97, 0.10))[0] == pytest.approx((2 + 0.003) / (3600 * 0.97))
    assert one(spark, money.sustained_eta(lit(119), lit("batch"), lit(False)), money.sustained_eta(lit(120), lit("batch"), lit(False))) == (119, 190)
    assert one(spark, money.per_task_secs(lit(0)), money.per_task_secs(lit(1001)), money.frac_count(lit(10), lit(0.25))) == (45, 2, 3)


def test_risk(spark):
    lit = F.lit
    got = one(spark, *[risk.check_probability(lit(r)) for r in (0.90, 0.95, 1.0)])
    assert got == pytest.approx((1.0, 0.625, 0.25))
    assert one(spark, risk.reputation_tier(lit(0.9), lit(5000)), risk.reputation_tier(lit(0.9), lit(4999)), risk.reputation_tier(lit(0.1), lit(9))) == (3, 2, 0)
    n = [lit(0)] * 5
    label = risk.verification_label
    assert one(spark, label(lit(3), lit(3), *n), label(lit(3), lit(1), *n), label(lit(0), lit(0), lit(1), *n[1:]), label(*n, lit(0), lit(0))) == ("fully-verified", "sampled-verified", "verified", "unverified")
    assert one(spark, *risk.failure_policy(lit("bad_input"))) == (False, True)
    assert one(spark, *risk.failure_policy(lit("never seen"))) == (True, False)


def test_tokens(spark):
    assert one(spark, text.token_estimate(F.lit("the quick brown fox jumps over the lazy dog")), text.token_estimate(F.lit("あ" * 20)), text.token_estimate(F.lit(""))) == (11, 18, 0)


def test_hmac(spark):
    want = int.from_bytes(hmac.new(b"secret", b"task-1", hashlib.sha256).digest()[:8], "big") / 2**64
    assert one(spark, text.hmac_unit("secret", F.lit("task-1")))[0] == pytest.approx(want, rel=1e-15)


def test_scan(spark):
    def scan(*lines):
        df = spark.createDataFrame([(i + 1, v) for i, v in enumerate(lines)], "line_no long, value string")
        r = jsonl.scan(df).first()
        return r.records, r.malformed_records, r.blank_records, r.skipped_records, r.first_bad_line

    assert scan('{"text":"a"}', "", '{"text":"b"}', "not json") == (3, 1, 1, 2, 4)
    assert scan('{"ok":1}', "", "{not json}", '{"ok":2}') == (3, 1, 1, 2, 3)
    assert scan("", "  ", "", "") == (0, 0, 4, 4, 0)


def test_split_has_no_blank_lines_and_keeps_order(spark):
    df = spark.createDataFrame([(i, "" if i % 3 == 0 else f'{{"i":{i}}}\r') for i in range(1, 400)], "line_no long, value string")
    rows = sorted(jsonl.split(df, 10, block=64).collect())
    assert [r.ordinal for r in rows] == list(range(len(rows))) and all(r.value.startswith("{") and not r.value.endswith("\r") for r in rows)
    assert all(r.chunk_index == r.ordinal // 10 for r in rows)


@pytest.mark.parametrize(("text_", "error"), [('{"a":1}', ""), ('{"a":{"b":1,"b":2}}', "duplicate_key"), ('{"a":1} x', "trailing_data"), ("[1]", "not_an_object"), ("{", "malformed"), ("", "malformed"), (None, "malformed")])
def test_strict(text_, error):
    assert jsonl._strict(text_) == error


def test_packed():
    data = packed.encode([[0.25, -0.5]])
    assert packed.decode(data)[0].tolist() == [[0.25, -0.5]]
    assert packed.decode(data + b"x") == (None, "size") and packed.decode(b"short") == (None, "header") and packed.decode(None) == (None, "header")
    assert packed.decode(packed.encode([[float("nan"), 1.0]])) == (None, "not_finite")
    with pytest.raises(ValueError, match="dimension"):
        packed.encode([[1.0], [1.0, 2.0]])


def test_fanout_by_hand(spark):
    fleet = spark.createDataFrame([(1, 1, 10.0, 0.0), (1, 2, 10.0, 5.0), (1, 3, 1.0, 500.0)], "job_id long, worker_id long, rate double, start double")
    items = spark.createDataFrame([(1, 150)], "job_id long, n long")
    rows = {r.worker_id: (r["items"], r.secs) for r in fanout(fleet, items).collect()}
    assert rows == {1: (100, 10.0), 2: (50, 10.0)}
