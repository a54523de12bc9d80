"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact shingle similarity."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, normal, saved, simhash

SHINGLE = 5
#: Fingerprints are compared within this radius: within RADIUS // BLOCKS bits in one of BLOCKS blocks.
RADIUS, BLOCKS = 17, 6
#: Benchmark shingles up to this number (16 bytes each) are sent to every executor; more are joined by shuffle.
MOST_SENT = 1_000_000


def shingles(parts: Column, k: int = SHINGLE) -> Column:
    """Hashes of k successive words, repeats included; of all words where there are fewer than k; none for no word."""
    some = lambda p: F.when(F.size(p) == 0, F.array().cast("array<long>")).when(F.size(p) < k, F.array(F.xxhash64(F.array_join(p, " ")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(p) - k), lambda i: F.xxhash64(*[F.get(p, i + j) for j in range(k)]))
    )
    return let(parts, some)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two shingle arrays in which a shingle weighs as often as it occurs."""
    count = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    inter = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return let(inter, lambda n: n / (F.size(a) + F.size(b) - n).cast("double"))


def _parts(text: Column) -> Column:
    return F.array_remove(F.split(normal(text), " ", -1), "")


def _print(parts: Column) -> Column:
    return simhash(F.transform(parts, lambda w: F.xxhash64(w)))


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, parts (normalised words), n, marks (shingles), fp of each item with a word."""
    some = benchmark.select("item_id", _parts(F.col("text")).alias("parts")).where(F.size("parts") > 0)
    return some.select("item_id", "parts", F.size("parts").alias("n"), shingles(F.col("parts")).alias("marks"), _print(F.col("parts")).alias("fp"))


def windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text_hash, start, n, part (the window's words): each window of an item's size that holds a shingle where an item has it.

    A window without a common shingle has similarity 0, so none that could pass is missing. A window that would
    pass an end of the text is moved inside; a text shorter than the item is one window.
    """
    own = F.posexplode("marks").alias("offset", "mark")
    anchors = saved(found.where(f"n >= {SHINGLE}").select("n", own).distinct())
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _parts(F.col("text")).alias("parts"))
    at = rows.select("doc_id", "text_hash", F.size("parts").alias("total"), F.posexplode(shingles(F.col("parts"))).alias("at", "mark"))
    sent = F.broadcast(anchors) if anchors.count() <= MOST_SENT else anchors
    inside = F.greatest(F.lit(0), F.least(F.col("at") - F.col("offset"), F.col("total") - F.col("n")))
    spots = at.join(sent, "mark").select("doc_id", "text_hash", inside.alias("start"), "n")
    for k in [r.n for r in found.where(f"n < {SHINGLE}").select("n").distinct().collect()]:  # SHINGLE - 1 numbers at most
        short = rows.select("doc_id", "text_hash", F.posexplode(F.when(F.size("parts") >= k, shingles(F.col("parts"), k))).alias("start", "mark"))
        whole = found.where(F.col("n") == k).select("n", shingles(F.col("parts"), k)[0].alias("mark")).distinct()
        spots = spots.union(short.join(whole, "mark").select("doc_id", "text_hash", "start", "n"))
    per = saved(spots.distinct().groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("spots")))
    again = rows.join(per.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    cut = F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), F.slice(F.col("parts"), s["start"] + 1, s["n"]).alias("part")))
    return again.select("doc_id", "text_hash", F.explode(cut).alias("w")).select("doc_id", "text_hash", "w.start", "w.n", "w.part").distinct()


def _widths() -> list[tuple[int, int]]:
    """(first bit, bits) of each block; together they are all 64 bits."""
    at = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    return [(at[b], at[b + 1] - at[b]) for b in range(BLOCKS)]


def _blocks(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in _widths()]


def index(found: DataFrame) -> DataFrame:
    """item_id, n, fp under each (block, bits) within RADIUS // BLOCKS bits of its own: any fingerprint within RADIUS has one of them."""
    flips = lambda width: F.array(*[F.lit(sum(1 << i for i in some)).cast("long") for r in range(RADIUS // BLOCKS + 1) for some in combinations(range(width), r)])
    near = F.array(*[F.struct(F.lit(b).alias("block"), bits.alias("bits"), flips(width).alias("flips")) for b, (bits, (_, width)) in enumerate(zip(_blocks(F.col("fp")), _widths(), strict=True))])
    wide = found.select("item_id", "n", "fp", F.explode(near).alias("k"))
    wide = wide.withColumn("flip", F.explode("k.flips"))
    return wide.select("item_id", "n", F.col("fp").alias("item_fp"), "k.block", F.col("k.bits").bitwiseXOR(F.col("flip")).alias("bits"))


def leaks(docs: DataFrame, benchmark: DataFrame, at_least: float = 0.8) -> DataFrame:
    """doc_id, text_hash, item_id, start (in normalised words), n_words, similarity: windows that repeat a benchmark item.

    Words are lower-cased runs of letters and digits. A window's fingerprint meets the items of its size within RADIUS bits;
    what remains has a similarity of at_least in 5-word shingles (all words as one for items of fewer). A fingerprint holds
    for most windows of that similarity, not for all: see README. Equal
    windows of many documents are compared once. Null texts, texts and items without a word match nothing; repeated rows
    count as one; null doc_ids are carried along; an empty table on either side gives no row.
    """
    found = saved(items(benchmark))
    cut = saved(windows(docs, found).select("doc_id", "text_hash", "start", F.col("n").alias("size"), "part", F.md5(F.array_join("part", " ").cast("binary")).alias("window")))
    distinct = cut.groupBy("window", "size").agg(F.first("part").alias("part")).select("window", "size", "part", _print(F.col("part")).alias("fp"))
    probes = saved(distinct)
    keyed = probes.select("window", "size", "fp", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), bits.alias("bits")) for b, bits in enumerate(_blocks(F.col("fp")))])).alias("k"))
    match = (F.col("k.block") == F.col("block")) & (F.col("k.bits") == F.col("bits")) & (F.col("size") == F.col("n")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = keyed.join(index(found), match).select("window", "size", "item_id").distinct()
    both = pairs.join(probes.select("window", "size", shingles(F.col("part")).alias("marks")), ["window", "size"]).join(found.select("item_id", F.col("marks").alias("item_marks")).distinct(), "item_id")
    exact = saved(both.select("window", "size", "item_id", similarity(F.col("marks"), F.col("item_marks")).alias("similarity")).where(F.col("similarity") >= at_least))
    return cut.join(exact, ["window", "size"]).select("doc_id", "text_hash", "item_id", "start", F.col("size").alias("n_words"), "similarity")


def leak_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, n_words, similarity of every leak."""
    return leaks(docs, benchmark).select("doc_id", "item_id", "start", "n_words", "similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; columns stay as they are."""
    bad = saved(leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    rows = docs.select(F.struct("*").alias("doc"))
    return rows.join(bad, F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("doc.text") == F.col("_hash")), "left_anti").select("doc.*")
