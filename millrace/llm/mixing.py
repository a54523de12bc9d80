"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, sent_if_small, words

#: No document is taken more often than this.
MOST_COPIES = 3
#: Copy counts of documents (64 bytes) up to this many are sent to every executor; more are joined by shuffle.
MOST_SENT = 1_000_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST_COPIES) -> tuple[DataFrame, int]:
    """(one row per source with rank, source_size, weight, target; the total size). sizes has source and size.

    Sources in code point order, null last, weigh `weights`, repeating, and share the total; a target stops at `most` times
    its source's size and the excess is shared again by weight, until none is above. The share of one unit of weight
    only grows from round to round, so each round is one aggregate over the sources and two numbers for the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, not per document
    per = per.withColumn("rank", F.row_number().over(order))
    per = saved(per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)))
    cap = F.col("source_size") * most
    total = per.agg(F.sum("source_size")).first()[0] or 0
    unit, full = 0.0, -1
    while True:
        below = cap > F.col("weight") * unit
        row = per.agg(F.coalesce(F.sum(F.when(~below, cap)), F.lit(0)).alias("held"), F.sum(F.when(below, F.col("weight"))).alias("w"), F.count(F.when(~below, 1)).alias("n")).first()
        if row.n == full or not row.w:
            break
        full, unit = row.n, (total - row.held) / row.w
    return per.withColumn("target", F.least(cap.cast("double"), F.col("weight") * unit)), total


def running_total(rows: DataFrame, order: list[Column | str], size: str, by: list[str]) -> DataFrame:
    """rows with `total`, the sum of size up to and with each row of its `by` group in the given order, no group held in one task.

    Rows are range-sorted by (by, order) and written with their part; sums per (part, group), at most parts + groups
    rows, give each part its start; the running sum itself stays within a part.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = saved(rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part", *by).agg(F.sum(size).alias("s"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    within = Window.partitionBy("part", *by).orderBy(*keys[len(by) :]).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("inside", F.sum(size).over(within)).alias("d")
    same = F.col("d.part") == F.col("s.part")
    for c in by:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}"))
    return summed.join(starts.alias("s"), same).select("d.*", (F.col("s.start") + F.col("d.inside")).alias("total")).drop("part", "inside")


def mixture(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = MOST_COPIES) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, finish (virtual time), copies and taken for every row of docs.

    Documents of a source stand in the order of the MD5 of their doc_id; copy e of a document ends at virtual time
    (e * source size + cumulative size) / target. All copies are range-sorted by that time and cut where their sizes
    would pass the total, so each source comes within one document of its target. Rows of size 0 (null text, no word) are
    taken 0 times; a null source is one source; repeated rows queue one after the other.
    """
    sizes = saved(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", F.size(words(F.col("text"))).cast("long").alias("size")))
    targets, total = source_targets(sizes, weights, most)
    per = F.broadcast(targets) if targets.count() <= 10_000 else targets
    named = sizes.join(per.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    named = named.select("doc_id", "text_hash", "source", "size", "source_size", "target", "rank", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("shuffle"))
    queued = saved(running_total(named, ["shuffle", F.col("doc_id").asc_nulls_first(), "size", "text_hash"], "size", ["rank"]))
    epochs = F.sequence(F.lit(0), F.lit(most - 1))
    finish = lambda e: (e * F.col("source_size") + F.col("total")).cast("double") / F.col("target")
    start = lambda e: (e * F.col("source_size") + F.col("total") - F.col("size")).cast("double")
    copies = queued.where("size > 0").select("rank", "shuffle", "total", "size", F.explode(F.filter(epochs, lambda e: start(e) < F.col("target"))).alias("e"), "source_size", "target")
    copies = copies.select(finish(F.col("e")).alias("at"), "rank", "e", "total", "size")
    order = ["at", "rank", "e", "total"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(copies.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    left, at = total, None
    for part, s in sorted(dealt.groupBy("part").agg(F.sum("size")).collect()):  # one row per part
        if s > left:
            at = part
            break
        left -= s
    taken = F.lit(most)
    if at is not None:  # the first copy that no longer fits is in this part
        inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        first = dealt.where(F.col("part") == at).withColumn("sum", F.sum("size").over(inside)).where(F.col("sum") > left).orderBy(*order).limit(1).first()
        cut = F.struct(*[F.lit(first[c]).cast(dealt.schema[c].dataType).alias(c) for c in order])
        own = lambda e: F.struct(finish(e).alias("at"), F.col("rank").alias("rank"), e.alias("e"), F.col("total").alias("total"))
        taken = F.size(F.filter(epochs, lambda e: (start(e) < F.col("target")) & (own(e) < cut)))
    else:
        taken = F.size(F.filter(epochs, lambda e: start(e) < F.col("target")))
    times = F.when(F.col("size") > 0, taken).otherwise(0).cast("long")
    return queued.select("doc_id", "text_hash", "source", "size", "source_size", "target", "shuffle", times.alias("copies"), (times * F.col("size")).alias("taken"))


def mix_table(docs: DataFrame) -> DataFrame:
    """What mixture() decides, as a digest."""
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, numbered by `copy`; rows that it does not take are gone.

    A column of docs that is called `copy` already is replaced. Rows that agree in doc_id, source and text may differ in
    how often they are taken; the taken copies are then dealt to them in turn.
    """
    times = mixture(docs).where("copies > 0").groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    times = times.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source"), "_copies", "_rows")
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("text").alias("t"))
    some = rows.join(sent_if_small(saved(times), MOST_SENT), F.col("i").eqNullSafe(F.col("_id")) & (F.xxhash64("t") == F.col("_hash")) & F.col("s").eqNullSafe(F.col("_source")))
    each = lambda df: df.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c != "copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("copy"))
    return each(some.where("_rows = 1")).union(each(some.where("_rows > 1").dropDuplicates(["i", "s", "t"])))


MIX_SQL = """
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM p),
w AS (SELECT *, CAST(1 + (rank - 1) % 3 AS DOUBLE) AS weight, (SELECT CAST(sum(source_size) AS BIGINT) FROM p) AS total FROM r),
o AS (SELECT *, coalesce(sum(3 * source_size) OVER f, 0) AS held, sum(weight) OVER t AS free FROM w
  WINDOW f AS (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         t AS (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
u AS (SELECT coalesce(arg_min((total - held) / free, 3 * source_size / weight) FILTER (WHERE 3 * source_size / weight > (total - held) / free), 1e300) AS unit FROM o),
g AS (SELECT rank, source, source_size, total, least(CAST(3 * source_size AS DOUBLE), weight * unit) AS target FROM w, u),
q AS (SELECT s.doc_id, s.size, g.*, sum(s.size) OVER (PARTITION BY g.rank ORDER BY md5(coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size) AS cum
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
c AS (SELECT q.*, e, (e * source_size + cum)::DOUBLE / target AS fin FROM q, (VALUES (0), (1), (2)) AS v(e)
  WHERE size > 0 AND (e * source_size + cum - size)::DOUBLE < target),
t AS (SELECT doc_id, rank, cum, size, sum(size) OVER (ORDER BY fin, rank, e, cum ROWS UNBOUNDED PRECEDING) <= total AS fits FROM c),
n AS (SELECT rank, cum, size, CAST(count(*) FILTER (WHERE fits) AS BIGINT) AS copies FROM t GROUP BY rank, cum, size)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(n.copies, 0) * q.size AS BIGINT) AS taken, CAST(coalesce(n.copies, 0) AS BIGINT) AS copies
FROM q LEFT JOIN n ON q.rank = n.rank AND q.cum = n.cum AND q.size = n.size
"""
