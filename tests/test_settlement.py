"""Entries that add up to nothing, hold times, sealed peers, identities that hang on their input alone, languages of paths."""

import datetime as dt
import hashlib
import hmac
import random
import uuid

import pytest
from pyspark.sql import functions as F

from millrace.operators import census, settlement
from millrace.plans.catalogue import QUERIES
from millrace.plans.entities import Exchange

SF = "/root/testdata/sf0.001"


def test_three_entries_per_task_add_up(spark):
    at = dt.datetime(2024, 1, 2, 3)
    rows = [(1, 7, 8, 100, 97, at, 60), (2, 7, 8, 100, 100, at, 200_000), (3, 7, 8, 0, 0, at, 0), (4, 7, 8, 10, 11, at, 0), (5, 7, 8, 10, -1, at, 0), (6, 7, None, 10, 0, at, None), (7, 7, 8, None, 1, at, 0)]
    df = spark.createDataFrame(rows, "task_id long, buyer_id long, supplier_id long, charge_micros long, payout_micros long, at timestamp_ntz, hold_secs long")
    out = settlement.settled(df).collect()
    good: dict = {}
    for r in out:
        if not r.error:
            good.setdefault(r.task_id, []).append(r)
    assert set(good) == {1, 2, 6} and all(len(v) == 3 and sum(x.amount_micros for x in v) == 0 for v in good.values())
    assert {r.task_id for r in out if r.error} == {3, 4, 5, 7} and len(out) == 13
    release = {r.task_id: r.release_at for r in out if r.kind == "supplier_credit"}
    assert release == {1: at + dt.timedelta(days=1), 2: at + dt.timedelta(seconds=200_000), 6: at + dt.timedelta(days=1)}


def test_sealed_peers_against_pairs(spark):
    r = random.Random(5)
    tasks = [(i, r.randrange(3), f"in/{r.randrange(3)}", r.choice(["complete", "complete", "failed"]), r.randrange(2), r.randrange(4), f"ref/{i}", f"sha{i}") for i in range(60)] + [(100, 9, None, "complete", 0, 1, "ref/100", "s"), (101, 9, None, "complete", 0, 1, "ref/101", "s")]
    work = [(t[0], r.randrange(2), r.choice(["terminal", "terminal", "claimed"]), t[6] if r.random() < 0.8 else "elsewhere", t[7] if r.random() < 0.8 else "other", t[0] % 4, "cuda", "b") for t in tasks for _ in range(2)]
    t = spark.createDataFrame(tasks, "id long, job_id long, input_ref string, status string, retry_count int, completed_at long, result_ref string, result_sha256 string")
    w = spark.createDataFrame(work, "task_id long, attempt int, status string, artifact_key string, artifact_sha256 string, supplier_id long, engine string, build_hash string").distinct()
    want = {}
    for a in tasks:
        found = sorted((p[5], p[0], v[3]) for p in tasks for v in set(work) if p[1] == a[1] and p[2] is not None and p[2] == a[2] and p[0] != a[0] and p[3] == "complete" and v[0] == p[0] and v[1] == p[4] and v[2] == "terminal" and p[6] == v[3] and p[7] == v[4])
        if found:
            want[a[0]] = found[0][2]
    got = {r.task_id: r.artifact for r in settlement.sealed_peers(t, w).collect()}
    assert got == want and len(got) > 20


def test_effect_ids_are_version_5(spark):
    for r in QUERIES["fn_effect_id"](spark, SF).limit(300).collect():
        assert uuid.UUID(r.effect_id).version == 5
    from millrace.operators.lifecycle import effects

    want = {(r.id, r.ordinal): str(uuid.uuid5(uuid.NAMESPACE_OID, f"{r.id}/{r.ordinal}/{r.effect}")) for r in effects(Exchange(spark, SF)).collect()}
    assert {(r.id, r.ordinal): r.effect_id for r in QUERIES["fn_effect_id"](spark, SF).collect()} == want


def test_samples_are_hmacs(spark):
    rows = QUERIES["fn_hmac_sample"](spark, SF).collect()
    for r in rows:
        want = int.from_bytes(hmac.new(b"secret", f"sample|{r.id}".encode(), hashlib.sha256).digest()[:8], "big") / 2**64
        assert r.unit == pytest.approx(want, abs=1e-15)
    assert rows and {r.checked for r in rows} == {True, False}


@pytest.mark.parametrize(("path", "language", "kind"), [("a/b.GO", "go", "maintained"), ("a/Makefile", "config", "maintained"), ("a/x.tar.GZ", "binary", "binary"), ("vendor/a.png", "vendored", "vendored"), ("a.b/cx", "shell", "maintained"), ("a.go/b", "other", "maintained"), ("x/tests/r.md", "documentation", "test"), ("r.md", "documentation", "documentation"), ("go.mod", "config", "maintained"), (".gitignore", "config", "maintained"), ("", "other", "maintained"), ("a.", "other", "maintained")])
def test_languages(spark, path, language, kind):
    r = spark.createDataFrame([(path,)], "p string").select(census.language_of(F.col("p")).alias("l"), census.kind_of(F.col("p")).alias("k")).first()
    assert (r.l if kind != "vendored" else "vendored", r.k) == (language, kind)
