"""What several operators share: words, tables cut from their lineage, components, hashes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import new_path

#: White space between words; a word is a longest run of other characters.
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, unchanged; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that no model may learn from: crc32(doc_id as text) mod folds is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def saved(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    at = new_path(spark)
    df.write.option("compression", codec).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.saved_at = at
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Within it, Python gets texts in Arrow batches of so many rows, which bounds what a batch of long texts takes; jobs must run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_saved(df: DataFrame) -> None:
    """Deletes what saved() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that is not its component's smallest node.

    Alternating large and small stars: each round links the larger neighbours of a node, then its smaller ones,
    to the smallest node in sight; a round is two shuffles of the edges, which never grow in number. The rounds
    are about the logarithm of the longest chain. Only a row count comes back to the driver. Null ends and loops are ignored.
    """
    now = saved(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("hi <> lo").distinct())
    while True:
        single = now.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi")
        inner = now.join(now.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").select("hi")
        if single.union(inner).isEmpty():
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        best = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(best, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        then = saved(best.select("hi", F.col("m").alias("lo")).union(small).distinct())
        drop_saved(now)
        now = then


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal(text: Column) -> Column:
    """Lower case, and one space for every run of what is neither letter nor digit; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


#: The lowest bit of each byte of a long, and of each but the top one.
_ONES, _SEVEN = 0x0101010101010101, 0x01010101010101


def lane_sums(h: Column) -> list[Column]:
    """Eight aggregates over rows of long hashes, each of which counts eight bits of them in the bytes of a long; null beyond 127 in the top byte."""
    return [F.try_sum(F.shiftright(h, s).bitwiseAND(F.lit(_ONES))) for s in range(8)]


def majority(lanes: list[Column], n: Column) -> Column:
    """The bits that are set in over half of n hashes, n <= 127, from their eight sums.

    A byte holds more than half of n once adding 127 - floor(n / 2) reaches its top bit; at most 254 in all, so nothing carries over.
    """
    out = F.lit(0).cast("long")
    for s, lane in enumerate(lanes):
        low = lane.bitwiseAND(F.lit(2**56 - 1)) + F.lit(_SEVEN) * (127 - F.floor(n / 2))
        top = F.shiftrightunsigned(lane, 56) > F.floor(n / 2)
        got = F.shiftrightunsigned(low.bitwiseAND(F.lit(0x80808080808080)), 7).bitwiseOR(F.when(top, F.lit(1 << 56)).otherwise(F.lit(0)))
        out = out.bitwiseOR(F.shiftleft(got, s))
    return out


def simhash(hashes: Column) -> Column:
    """The 64-bit SimHash of an array of long hashes: a bit is 1 if it is set in over half of them; 0 for none.

    Eight sums each count eight bits in the bytes of a long, for at most 127 hashes at once; longer arrays are counted
    in pieces whose bytes are then added up bit by bit.
    """
    most = 127
    adding = lambda s: lambda a, x: a + F.shiftright(x, s).bitwiseAND(F.lit(_ONES))
    sums = lambda h: F.array(*[F.aggregate(h, F.lit(0).cast("long"), adding(s)) for s in range(8)])
    short = lambda h: let(sums(h), lambda c: majority([F.get(c, F.lit(s)) for s in range(8)], F.size(h)))
    counting = lambda i: lambda a, c: a + F.shiftrightunsigned(F.get(c, F.lit(i % 8)), i // 8 * 8).bitwiseAND(F.lit(255))

    def long(h: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(h) - 1) / most).cast("int")), lambda i: sums(F.slice(h, i * most + 1, F.lit(most))))

        def bits(p: Column) -> Column:
            out = F.lit(0).cast("long")
            for i in range(64):
                total = F.aggregate(p, F.lit(0).cast("long"), counting(i))
                out = out.bitwiseOR(F.when(total * 2 > F.size(h), F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0)))
            return out

        return let(pieces, bits)

    return let(hashes, lambda h: F.when(F.size(h) == 0, F.lit(0).cast("long")).when(F.size(h) <= most, short(h)).otherwise(long(h)))


def sent_if_small(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows; callers pass rows of two or three numbers, 64 MB at the most."""
    return F.broadcast(df) if df.count() <= most else df


def sample_step(df: DataFrame, bound: int) -> int:
    """The m for which about `bound` rows of df have a key hash divisible by m."""
    return max(1, -(-df.count() // bound))


def first_rows(df: DataFrame, order: list[Column], k: int):
    """The k-th row of df in the given order, or None if df has no more than k rows: all is range-sorted, only one part is ranked."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    left = k
    for part, n in sorted(dealt.groupBy("_part").count().collect()):  # one row per part
        if n >= left > 0:
            at = Window.partitionBy("_part").orderBy(*order)
            return dealt.where(F.col("_part") == part).withColumn("_rank", F.row_number().over(at)).where(F.col("_rank") == left).drop("_part", "_rank").first()
        left -= n
    return None
