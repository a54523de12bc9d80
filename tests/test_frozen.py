"""Plans that were touched, stores that grow once, payout lines written once per key."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import frozen
from millrace.plans.storage import new_path
from millrace.sources import batches


def made(spark, n=40):
    r = random.Random(1)
    rows = [(i, r.randrange(1, 9), r.randrange(3), r.randrange(1, 5_000_000), r.choice([0, 400_000])) for i in range(n)]
    return frozen.built(spark.createDataFrame(rows, "id long, n long, extra long, base long, premium long"))


def test_a_plan_adds_up(spark):
    for r in made(spark).collect():
        for s in r.scenarios:
            assert s.gross >= s.net >= 0 and (s.fee > 0) == (s.net > 0) and s.headroom <= s.net - r.payout * s.tasks - s.fee + 1
        assert [s.tasks for s in r.scenarios] == [1, r.n, r.n, r.n + r.extra] and r.executable == (min(s.headroom for s in r.scenarios) >= -1)


def test_every_touched_scenario_field_is_named(spark):
    cases = [(k, f) for k in range(4) for f in frozen.FIELDS]
    touched = made(spark, len(cases) + 1)
    some = lambda f: F.lit("other") if f == "scenario" else F.lit(77_777_777).cast("long")
    touch = lambda k, f: F.transform("scenarios", lambda s, i: F.when(i == k, s.withField(f, some(f))).otherwise(s))
    each = [touch(k, f) for k, f in cases]
    which = F.col("scenarios")
    for n, changed in enumerate(each):
        which = F.when(F.col("id") == n, changed).otherwise(which)
    got = {r.id: r.changed for r in frozen.changed(touched.withColumn("scenarios", which)).collect()}
    assert got == {n: f"scenarios[{k}].{f}" for n, (k, f) in enumerate(cases)} | {len(cases): ""}


def test_nulls_and_shapes_are_changes(spark):
    plans = made(spark, 6)
    on = lambda i, v, c: F.when(F.col("id") == i, v).otherwise(F.col(c))
    touched = plans.withColumns({"payout": on(1, F.lit(None), "payout"), "executable": on(2, ~F.col("executable"), "executable"), "scenarios": on(3, F.concat("scenarios", F.slice("scenarios", 1, 1)), "scenarios")}).withColumn("scenarios", on(4, F.lit(None), "scenarios"))
    assert {r.id: r.changed for r in frozen.changed(touched).collect()} == {0: "", 1: "payout", 2: "executable", 3: "scenarios", 4: "scenarios", 5: ""}


def held(spark, path):
    return sorted((r.key, r.digest) for r in batches.published(spark, path, frozen.STORED).collect())


def told(df):
    return {(r.key, r.digest): r.status for r in df.collect()}


def test_a_store_grows_once(spark):
    path, doc = new_path(spark), lambda *rows: spark.createDataFrame([(k, d, f"{k}{d}") for k, d in rows], "key string, digest string, document string")
    assert told(frozen.persisted(doc(("a", "1"), ("b", "1"), ("b", "1"), (None, "9")), path, "1")) == {("a", "1"): "inserted", ("b", "1"): "inserted", (None, "9"): "conflict"}
    assert told(frozen.persisted(doc(("a", "1"), ("b", "2"), ("c", "5"), ("c", "4")), path, "2")) == {("a", "1"): "same", ("b", "2"): "conflict", ("c", "4"): "inserted", ("c", "5"): "conflict"}
    want = [("a", "1"), ("b", "1"), ("c", "4")]
    assert held(spark, path) == want
    assert told(frozen.persisted(doc(("c", "4"), ("c", "5")), path, "2")) == {("c", "4"): "inserted", ("c", "5"): "conflict"}  # the second run again, cut short before
    assert set(told(frozen.persisted(doc(*want), path, "3")).values()) == {"same"} and held(spark, path) == want


def lines(spark, path):
    return sorted((r.key, r.supplier, r.amount) for r in frozen.lines_of(spark, path).collect())


def rows(spark, *some):
    df = spark.createDataFrame([(s, c, cur, at, k) for s, c, cur, at, k in some], "supplier long, cents long, currency string, at string, key string")
    return df.withColumn("at", F.col("at").cast("timestamp_ntz"))


def test_each_key_is_written_once(spark):
    path, day = new_path(spark), "2024-01-02 03:04:05"
    one = rows(spark, (1, 150, "usd", day, "k1"), (1, 150, "usd", day, "k1"), (2, 5, "usd", day, "k2"), (2, 6, "usd", "2024-01-01 00:00:00", "k2"), (3, 0, "usd", day, "k3"), (3, 9, "eur", day, "k4"), (3, 9, "usd", day, " "), (3, 9, "usd", day, None), (None, 7, "usd", day, "k5"), (3, None, "usd", day, "k6"))
    got = {(r.key, r.cents): r.status for r in frozen.exported(one, path, "a").collect()}
    assert got == {("k1", 150): "written", ("k2", 5): "conflict", ("k2", 6): "written", ("k3", 0): "refused", ("k4", 9): "refused", (" ", 9): "refused", (None, 9): "refused", ("k5", 7): "written", ("k6", None): "refused"}
    want = [("k1", "1", "1.500000"), ("k2", "2", "0.060000"), ("k5", None, "0.070000")]
    assert lines(spark, path) == want
    again = rows(spark, (1, 150, "usd", "2025-01-01 00:00:00", "k1"), (9, 150, "usd", day, "k2"), (4, 12_345, "usd", day, "k9"), (None, 7, "usd", day, "k5"))
    assert {r.key: r.status for r in frozen.exported(again, path, "b").collect()} == {"k1": "replayed", "k2": "conflict", "k9": "written", "k5": "replayed"}
    frozen.exported(again, path, "b")
    frozen.exported(one, path, "a")
    assert lines(spark, path) == sorted([*want, ("k9", "4", "123.450000")], key=str)
    assert frozen.lines_of(spark, path).where("key = 'k9'").first()["at"] == "2024-01-02T03:04:05Z"


def test_a_run_that_is_cut_off_writes_nothing(spark):
    path = new_path(spark)
    bad = rows(spark, (1, 150, "usd", "2024-01-02 03:04:05", "k1")).withColumn("supplier", F.raise_error("executor lost").cast("long"))
    with pytest.raises(Exception, match="executor lost"):
        frozen.exported(bad, path, "a")
    assert lines(spark, path) == []


def test_export_puts_the_ledger_together_once(spark, monkeypatch):
    """Both runs read instructions that are a table already: no shuffle of tasks, jobs or the ledger stands before them."""
    import __spark_entry__

    plans, real = [], frozen.exported

    def seen(instructions, *how):
        plans.append(instructions._jdf.queryExecution().executedPlan().toString())
        return real(instructions, *how)

    monkeypatch.setattr(frozen, "exported", seen)
    __spark_entry__.queries()["snk_csv_export"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)


def test_documents_are_made_where_they_are_written(spark, monkeypatch):
    """What runs decide on is shuffled and kept without documents, which the store alone has."""
    import __spark_entry__

    tables, real = [], frozen.written
    monkeypatch.setattr(frozen, "written", lambda df: tables.append(df.columns) or real(df))
    out = __spark_entry__.queries()["tr_plan_persist"](spark, "/root/testdata/sf0.001")
    assert len(tables) == 3 and not any({"document", "digest"} & set(columns) for columns in tables) and out.count() > 0


def test_a_store_of_made_documents(spark):
    """Rows of which digests and documents are made are told the same as rows that have them, null and repeated keys included."""
    made = lambda df: df.select("*", F.sha2(F.concat_ws("/", "key", "v"), 256).alias("digest"), F.concat_ws("/", "key", "v").alias("document"))
    paths = [new_path(spark), new_path(spark)]
    for batch, some in (("1", [("a", 1), ("b", 1), ("b", 1), (None, 9), (None, 9)]), ("2", [("a", 1), ("b", 2), ("c", 5), ("c", 4), (None, 9)]), ("2", [("c", 4), ("c", 5), ("d", None)]), ("3", [("a", 1), ("a", 2), ("c", 5), ("c", 4)])):
        rows = spark.createDataFrame(some, "key string, v int")
        plain, lean = frozen.persisted(made(rows).drop("v"), paths[0], batch), frozen.persisted(rows, paths[1], batch, made)
        assert sorted(map(str, lean.collect())) == sorted(map(str, plain.collect()))
        assert lean.count() == len(set(some)) and held(spark, paths[0]) == held(spark, paths[1])
