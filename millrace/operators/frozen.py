"""Frozen plans: built from their inputs alone, kept once under a digest, and rebuilt to see whether anybody touched them. Payout lines, written once per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import money
from ..plans.entities import Exchange
from ..plans.registry import query
from ..plans.storage import new_path, written
from ..sources import batches

#: The schedule of fees that plans are built by.
PERCENT, FIXED, PER_TASK, MARGIN, SHARE = 0.029, 0.3, 0.0001, 0.1, 0.97
#: A plan's scenarios: name, tasks done, whether the promised time was missed.
SCENARIOS = (("one_task", "1", True), ("all_met", "n", False), ("all_missed", "n", True), ("extra_missed", "n + extra", True))
INPUT = ("n", "extra", "base", "premium")
FIELDS = ("scenario", "tasks", "gross", "net", "fee", "headroom")


def built(df: DataFrame) -> DataFrame:
    """df with charge, payout, executable and scenarios from its n, extra, base and premium; money in whole micro-USD, no shuffle.

    The charge covers payout, a processor's fee and the margin wanted even for a single task; a plan may run where each
    scenario leaves what is required. A null input gives a plan of nulls.
    """
    usd = lambda c: F.col(c) / 1e6
    micros = lambda v: F.round(v * 1e6).cast("long")
    compute = usd("base") / F.col("n").cast("double")
    df = df.withColumn("payout", money.round_usd(compute * SHARE))
    df = df.withColumn("charge", money.ceil_usd(F.greatest(compute, (F.col("payout") + FIXED + PER_TASK) / (1 - PERCENT - MARGIN))))

    def scenario(name: str, tasks: str, miss: bool) -> Column:
        tasks = F.expr(tasks).cast("double")
        gross = money.round_usd(F.col("charge") * tasks + usd("premium"))
        net = money.round_usd(gross - money.round_usd(F.least(usd("premium"), gross))) if miss else money.round_usd(gross - F.lit(0.0))
        fee = F.when(net > 0, money.ceil_usd(net * PERCENT + FIXED)).otherwise(0.0)
        cost = money.round_usd(F.col("payout") * tasks) + fee + money.round_usd(PER_TASK * tasks)
        headroom = money.round_usd(money.round_usd(net - cost) - money.round_usd(net * MARGIN))
        return F.struct(F.lit(name).alias("scenario"), tasks.cast("long").alias("tasks"), micros(gross).alias("gross"), micros(net).alias("net"), micros(fee).alias("fee"), micros(headroom).alias("headroom"))

    df = df.withColumn("scenarios", F.array(*[scenario(*s) for s in SCENARIOS]))
    least = F.array_min(F.transform("scenarios", lambda s: s["headroom"]))
    return df.withColumns({"charge": micros(F.col("charge")), "payout": micros(F.col("payout")), "executable": least >= -1})


def inputs(e: Exchange) -> DataFrame:
    """id, and what a plan is built from, of every job."""
    return e.jobs.select("id", (F.col("id") % 9 + 1).alias("n"), (F.col("id") % 3).alias("extra"), F.col("estimated_micros").alias("base"), F.col("sla_premium_micros").alias("premium"))


def plans(e: Exchange) -> DataFrame:
    return built(inputs(e))


def _canonical() -> tuple[Column, Column]:
    """digest, document of a plan: JSON of whole numbers in a fixed order of fields, and its SHA-256."""
    text = F.to_json(F.struct("id", *INPUT, "charge", "payout", "executable", "scenarios"))
    return F.sha2(text, 256), text


STORED = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "digest", "document")])


def persisted(incoming: DataFrame, path: str, batch: str, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """key, digest, status of every distinct (key, digest) of incoming, after what is new was added to the store: inserted, same, or conflict (the key is bound to another digest).

    incoming has key, digest and document; or key and columns from which `made` gives a SHA-256 in hex as digest, and the
    document, to each row by itself. Then only those columns are shuffled and kept, documents are made where they are written,
    and digests where they are compared.

    Nothing in the store ever changes. A batch that is run again decides as it did, for it does not see itself. Of several
    digests of a new key the least is kept and the others are conflicts. Null keys are conflicts always.
    """
    spark = incoming.sparkSession
    short = F.unhex if made else F.col
    there = batches.published(spark, path, STORED).where(F.col("batch") != batch).select("key", short("digest").alias("bound"))
    made = made or (lambda df: df)
    rows = made(incoming.repartition("key")).select("digest", *[c for c in incoming.columns if c != "digest"]).dropDuplicates(["key", "digest"])
    rows = rows.withColumn("least", F.min("digest").over(Window.partitionBy("key")))
    status = F.when(F.col("key").isNull(), "conflict").when(F.col("bound").isNotNull(), F.when(F.col("bound") == short("digest"), "same").otherwise("conflict")).when(F.col("digest") == F.col("least"), "inserted").otherwise("conflict")
    judged = written(rows.join(there, "key", "left").withColumn("status", status).select(*incoming.columns, "status"))
    batches.publish(made(judged.where("status = 'inserted'")).select("key", "digest", "document"), path, batch, codec="zstd")
    return made(judged).select("key", "digest", "status")


def changed(snapshot: DataFrame) -> DataFrame:
    """id, changed, executable: the fields of each snapshot that are not what its own inputs give, null-safe; empty for a sound one.

    Scenarios are compared field by field where there are as many as there should be.
    """
    fresh = built(snapshot.select("id", *INPUT, F.struct("charge", "payout", "executable", "scenarios").alias("was")))
    names = [F.when(~F.col(c).eqNullSafe(F.col("was")[c]), c) for c in ("charge", "payout", "executable")]
    all_there = F.size("was.scenarios").eqNullSafe(F.lit(len(SCENARIOS)))
    names.append(F.when(~all_there, "scenarios"))
    for k in range(len(SCENARIOS)):
        own, was = F.get("scenarios", F.lit(k)), F.get("was.scenarios", F.lit(k))
        names += [F.when(all_there & ~own[f].eqNullSafe(was[f]), f"scenarios[{k}].{f}") for f in FIELDS]
    return fresh.select("id", F.array_join(F.array_compact(F.array(*names)), ",").alias("changed"), "executable")


_R = lambda x: f"(sign({x}) * floor(abs({x}) * 1e6 + 0.5) / 1e6)"
_C = lambda x: f"(ceil(({x} - 1e-12) * 1e6) / 1e6)"
_M = lambda x: f"CAST(round({x} * 1e6) AS BIGINT)"
#: One row per plan and scenario (k from 0), from rows i of id, v, n, extra, base, premium.
PLAN_SQL = f"""p AS (SELECT *, {_R(f'(base / 1e6 / n::DOUBLE * {SHARE}::DOUBLE)')} AS payout FROM i), c AS (SELECT *, {_C(f'greatest(base / 1e6 / n::DOUBLE, (payout + {FIXED}::DOUBLE + {PER_TASK}::DOUBLE) / {1 - PERCENT - MARGIN!r}::DOUBLE)')} AS charge FROM p),
    s AS (SELECT c.*, x.k, x.scenario, CASE x.k WHEN 0 THEN 1 WHEN 3 THEN n + extra ELSE n END::DOUBLE AS tasks, x.k <> 1 AS miss FROM c CROSS JOIN (VALUES (0, 'one_task'), (1, 'all_met'), (2, 'all_missed'), (3, 'extra_missed')) AS x(k, scenario)),
    g AS (SELECT *, {_R('(charge * tasks + premium / 1e6)')} AS gross FROM s), n AS (SELECT *, {_R(f"(gross - CASE WHEN miss THEN {_R('least(premium / 1e6, gross)')} ELSE 0.0::DOUBLE END)")} AS net FROM g), f AS (SELECT *, CASE WHEN net > 0 THEN {_C(f'(net * {PERCENT}::DOUBLE + {FIXED}::DOUBLE)')} ELSE 0.0::DOUBLE END AS fee FROM n),
    h AS (SELECT *, {_R(f"({_R(f'(net - ({_R("(payout * tasks)")} + fee + {_R(f"({PER_TASK}::DOUBLE * tasks)")}))')} - {_R(f'(net * {MARGIN}::DOUBLE)')})")} AS headroom FROM f),
    w AS (SELECT id, v, n, extra, base, premium, {_M('charge')} AS charge, {_M('payout')} AS payout, min({_M('headroom')}) OVER (PARTITION BY id, v) >= -1 AS executable, k, scenario, CAST(tasks AS BIGINT) AS tasks, {_M('gross')} AS gross, {_M('net')} AS net, {_M('fee')} AS fee, {_M('headroom')} AS headroom FROM h)"""
JOBS_SQL = "id % 9 + 1 AS n, id % 3 AS extra, estimated_micros AS base, sla_premium_micros AS premium FROM jobs"
_DIGESTS = """d AS (SELECT id, sha256(concat('{"id":', id, ',"n":', n, ',"extra":', extra, ',"base":', base, ',"premium":', premium, ',"charge":', charge, ',"payout":', payout, ',"executable":', executable, ',"scenarios":[',
    string_agg(concat('{"scenario":"', scenario, '","tasks":', tasks, ',"gross":', gross, ',"net":', net, ',"fee":', fee, ',"headroom":', headroom, '}'), ',' ORDER BY k), ']}')) AS digest FROM w GROUP BY id, n, extra, base, premium, charge, payout, executable)"""


@query(f"""WITH i AS (SELECT id, 0 AS v, {JOBS_SQL}), {PLAN_SQL}, {_DIGESTS} SELECT CAST(id AS VARCHAR) AS key, digest, CASE WHEN id % 2 = 0 THEN 'inserted' END AS first, CASE WHEN id % 10 = 4 THEN 'conflict' WHEN id % 2 = 0 THEN 'same' ELSE 'inserted' END AS second,
    CASE WHEN id % 10 = 4 THEN 'conflict' ELSE 'same' END AS third FROM d""")
def tr_plan_persist(e: Exchange) -> DataFrame:
    """The digest that the store has of every plan, and what three runs said: half of the plans, all of them (a tenth touched), and all again."""
    path, rows = new_path(e.spark), inputs(e).withColumn("key", F.col("id").cast("string"))
    good, touched = rows.withColumn("more", F.lit(0)), rows.withColumn("more", F.when(F.col("id") % 10 == 4, 1).otherwise(0))

    def made(df: DataFrame) -> DataFrame:
        plan = built(df).withColumn("payout", F.col("payout") + F.col("more"))
        return plan.select(*df.columns, *[c.alias(n) for n, c in zip(("digest", "document"), _canonical(), strict=True)])

    runs = [persisted(good.where("id % 2 = 0"), path, "0001", made), persisted(touched, path, "0002", made), persisted(touched, path, "0003", made)]
    store = batches.published(e.spark, path, STORED).select("key", "digest")
    for name, run in zip(("first", "second", "third"), runs, strict=True):
        store = store.join(run.select("key", F.col("status").alias(name)), "key", "left")
    return store


@query(f"""WITH i AS (SELECT id, 0 AS v, {JOBS_SQL} UNION ALL SELECT id, 1 AS v, id % 9 + 2, id % 3, estimated_micros, sla_premium_micros FROM jobs WHERE id % 7 = 5), {PLAN_SQL},
    a AS (SELECT w.*, r.n AS own, r.charge AS charge_r, r.payout AS payout_r, r.executable AS executable_r, r.scenario AS scenario_r, r.tasks AS tasks_r, r.gross AS gross_r, r.net AS net_r, r.fee AS fee_r, r.headroom AS headroom_r FROM w JOIN w r ON r.id = w.id AND r.k = w.k AND r.v = CASE WHEN w.id % 7 = 5 THEN 1 ELSE 0 END WHERE w.v = 0),
    b AS (SELECT id, executable_r, unnest([{{'o': 0, 'name': CASE WHEN k = 0 AND (id % 7 = 4 OR charge <> charge_r) THEN 'charge' END}}, {{'o': 1, 'name': CASE WHEN k = 0 AND (id % 7 = 1 OR payout <> payout_r) THEN 'payout' END}}, {{'o': 2, 'name': CASE WHEN k = 0 AND executable <> executable_r THEN 'executable' END}}, {{'o': 3, 'name': CASE WHEN k = 0 AND id % 7 = 3 THEN 'scenarios' END}},
        {', '.join(f"{{{{'o': 10 + 10 * k + {o}, 'name': CASE WHEN id % 7 <> 3 AND ({f} <> {f}_r{' OR k = 0 AND id % 7 = 2 AND fee_r <> 0' if f == 'fee' else ''}) THEN concat('scenarios[', k, '].{f}') END}}}}".replace('{{', '{').replace('}}', '}') for o, f in enumerate(FIELDS))}]) AS x FROM a)
    SELECT id, coalesce(string_agg(x.name, ',' ORDER BY x.o), '') AS changed, executable_r AS executable FROM b GROUP BY id, executable_r""")
def va_plan_snapshot(e: Exchange) -> DataFrame:
    """What was changed in each snapshot of a plan, some of which are touched here: payout, a fee, a scenario taken out, the charge, or an input."""
    on, k = lambda m: F.col("id") % 7 == m, F.col("scenarios")
    fee = F.transform(k, lambda s, i: F.when(i == 0, s.withField("fee", F.lit(0).cast("long"))).otherwise(s))
    return changed(
        plans(e).withColumns(
            {
                "payout": F.when(on(1), F.col("payout") + 10_000).otherwise(F.col("payout")),
                "scenarios": F.when(on(2), fee).when(on(3), F.slice(k, 1, 3)).otherwise(k),
                "charge": F.when(~on(4), F.col("charge")),
                "n": F.when(on(5), F.col("n") + 1).otherwise(F.col("n")),
            }
        )
    )


# Payout lines


LINE = T.StructType([T.StructField("supplier", T.StringType()), T.StructField("amount", T.StringType()), T.StructField("at", T.StringType()), T.StructField("key", T.StringType()), T.StructField("bucket", T.IntegerType())])
#: Folders per batch, by key: what a run reads of earlier batches is the folders of its own keys.
BUCKETS = 16


def exported(instructions: DataFrame, path: str, batch: str) -> DataFrame:
    """supplier, cents, currency, at, key, status of payout instructions, after those not written before are written as CSV lines `supplier,amount,at,key`.

    refused: no cents, another currency than usd, or a blank key. replayed: the key's line is there, with this supplier and
    amount. conflict: it is there with others. written: it was new; of several instructions with a new key the first by
    time, supplier and cents is the one that is written, and the others are held against it. Batches as in `batches`: a
    run that is cut off writes nothing, and one that comes again writes the same lines in the same place.
    """
    spark = instructions.sparkSession
    amount = F.format_string("%d.%02d0000", F.floor(F.col("cents") / 100), F.col("cents") % 100)
    rows = instructions.select("supplier", "cents", "currency", "at", "key").distinct().withColumn("amount", amount)
    refused = ~F.coalesce((F.col("cents") > 0) & (F.col("currency") == "usd") & F.col("key").rlike(r"\S"), F.lit(False))
    rows = rows.withColumn("refused", refused).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
    there = batches.published(spark, path, LINE, "csv").where(F.col("batch") != batch).select("key", F.col("supplier").alias("s"), F.col("amount").alias("a"))
    first = rows.where("NOT refused").groupBy("key").agg(F.min(F.struct("at", "supplier", "cents")).alias("first"), F.min_by("amount", F.struct("at", "supplier", "cents")).alias("first_amount"))
    judged = rows.join(there, "key", "left").join(first, "key", "left")
    same = lambda s, a: F.col("supplier").cast("string").eqNullSafe(s.cast("string")) & (F.col("amount") == a)
    new = F.struct("at", "supplier", "cents").eqNullSafe(F.col("first"))
    status = F.when(F.col("refused"), "refused").when(F.col("a").isNotNull(), F.when(same(F.col("s"), F.col("a")), "replayed").otherwise("conflict")).when(new, "written").when(same(F.col("first.supplier"), F.col("first_amount")), "replayed").otherwise("conflict")
    judged = written(judged.withColumn("status", status).select("supplier", "cents", "currency", "at", "key", "amount", "bucket", "status"))
    lines = judged.where("status = 'written'").select(F.col("supplier").cast("string").alias("supplier"), "amount", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "key", "bucket")
    batches.publish(lines.repartition("bucket"), path, batch, "csv", ("bucket",))
    return judged.drop("amount", "bucket")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all batches, with the batch of each."""
    return batches.published(spark, path, LINE, "csv").drop("bucket")


_READY = "FROM ledger WHERE payout_status = 'ready' AND amount_micros >= 0"


@query(f"""WITH r AS (SELECT supplier_id, job_id, task_id, CAST(floor(amount_micros / 10000) AS BIGINT) AS cents, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS stamp {_READY}),
    j AS (SELECT *, cents = 0 OR job_id % 11 = 0 OR job_id % 13 = 0 AS refused, job_id % 3 <> 0 AS early FROM r)
    SELECT concat('payout/', task_id) AS key, 'first' AS status, 1 AS n, concat(supplier_id, ',', cents // 100, '.', lpad(CAST(cents % 100 AS VARCHAR), 2, '0'), '0000,', stamp, ',payout/', task_id) AS line FROM j WHERE early AND NOT refused
    UNION ALL SELECT concat('payout/', task_id), 'second', 1, concat(supplier_id, ',', c // 100, '.', lpad(CAST(c % 100 AS VARCHAR), 2, '0'), '0000,', stamp, ',payout/', task_id) FROM (SELECT *, cents + CASE WHEN job_id % 5 = 0 THEN 1 ELSE 0 END AS c FROM j) k WHERE c > 0 AND job_id % 11 <> 0 AND job_id % 13 <> 0 AND (NOT early OR cents = 0)
    UNION ALL SELECT NULL, concat('of second: ', CASE WHEN c = 0 OR job_id % 11 = 0 OR job_id % 13 = 0 THEN 'refused' WHEN NOT early OR cents = 0 THEN 'written' WHEN job_id % 5 = 0 THEN 'conflict' ELSE 'replayed' END), count(*), NULL FROM (SELECT *, cents + CASE WHEN job_id % 5 = 0 THEN 1 ELSE 0 END AS c FROM j) k GROUP BY 2""")
def snk_csv_export(e: Exchange) -> DataFrame:
    """Payout lines that two runs over overlapping instructions wrote, each key once, and how many of the second run were written, replayed, refused or in conflict.

    The first run has two thirds of the jobs; the second has all, with a cent more for a fifth of them.
    """
    path = new_path(e.spark)
    ready = e.ledger.where("payout_status = 'ready' AND amount_micros >= 0")
    key = F.when(F.col("job_id") % 13 == 0, " ").otherwise(F.concat(F.lit("payout/"), F.col("task_id")))
    rows = ready.select(F.col("supplier_id").alias("supplier"), F.floor(F.col("amount_micros") / 10_000).cast("long").alias("cents"), F.when(F.col("job_id") % 11 == 0, "eur").otherwise("usd").alias("currency"), F.col("created_at").alias("at"), key.alias("key"), "job_id", "task_id")
    rows = written(rows)  # the few instructions of the ledger, which both runs read: it is put together once
    exported(rows.where("job_id % 3 <> 0"), path, "first")
    more = rows.withColumn("cents", F.col("cents") + F.when(F.col("job_id") % 5 == 0, 1).otherwise(0))
    told = exported(more, path, "second")
    lines = lines_of(e.spark, path).groupBy("key", "batch").agg(F.count("*").alias("n"), F.max(F.concat_ws(",", "supplier", "amount", "at", "key")).alias("line"))
    counts = told.groupBy("status").agg(F.count("*").alias("n"))
    return lines.select("key", F.col("batch").alias("status"), "n", "line").unionByName(counts.select(F.lit(None).cast("string").alias("key"), F.concat(F.lit("of second: "), "status").alias("status"), "n", F.lit(None).cast("string").alias("line")))
