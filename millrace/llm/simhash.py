"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, saved, sent_if_small

#: Shingles that are counted at once, so that memory stays bounded on very long texts.
CHUNK = 65_536
#: Fingerprints of one block when a bucket is compared in blocks.
BLOCK = 1_024
#: Keys of kept documents (32 bytes) up to this many are sent to every executor; more are joined by shuffle.
MOST_SENT = 1_000_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over hashed word shingles, repeats counted; 0 without a word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space parts
    if not parts:
        return 0
    spans = [b" ".join(parts)] if len(parts) < shingle else None
    n = 1 if spans else len(parts) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        some = spans or map(b" ".join, zip(*(parts[at + k : min(at + CHUNK, n) + k] for k in range(shingle)), strict=True))
        hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in some], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def with_fingerprint(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash and fp (a long) of every row."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint(t, shingle) for t in part], dtype="int64")

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fp("text").alias("fp"))


def covering_masks(radius: int = 3, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks of which any `radius` bits are all left out by one.

    Bit i stands for a non-zero vector m(i) of GF(2)^(radius+1); mask v keeps the bits with <m(i), v> = 1. The vectors of
    `radius` bits span less than the whole space, so some v is orthogonal to them all and keeps none of these bits.
    """
    size = 2 ** (radius + 1) - 1
    masks = [sum(1 << i for i in range(bits) if bin((1 + i % size) & v).count("1") % 2) for v in range(1, size + 1)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in masks]


def _forest(lists: pd.Series, radius: int) -> pd.Series:
    """For each list of fingerprints, edges [a0, b0, a1, b1, ...] that connect what pairs within the radius connect."""
    out = []
    for one in lists:
        left, edges = np.unique(np.asarray(one, np.int64)), []
        while left.size:
            queue, left = [left[0]], left[1:]
            while queue and left.size:
                near = np.bitwise_count((left ^ queue[-1]).view(np.uint64)) <= radius
                at = queue.pop()
                found = left[near]
                edges += [x for b in found for x in (at, b)]
                queue += list(found)
                left = left[~near]
        out.append(np.array(edges, np.int64))
    return pd.Series(out)


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): edges between distinct fingerprints that connect exactly what pairs of at most `radius` differing bits connect.

    fps has distinct longs fp. Every such pair meets in the bucket of some table. A bucket of two is tested in place; the
    fingerprints of a larger one are compared in blocks of at most two times BLOCK, one pair of blocks in a row, which
    returns a spanning forest and not its pairs. A bucket of any size so spreads over many tasks; rows out stay linear.
    """
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(covering_masks(radius))])
    keyed = fps.select("fp", F.explode(tables).alias("t")).select("fp", "t.table", "t.key")
    buckets = saved(keyed.groupBy("table", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    twos = buckets.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    large = buckets.where("n > 2").select("table", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = keyed.join(large, ["table", "key"]).select("table", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    lists = dealt.groupBy("table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list("fp").alias("fps"))

    @F.pandas_udf("array<long>")
    def forest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield _forest(part, radius)

    flat = lists.select(forest("fps").alias("e")).where(F.size("e") > 0)
    pairs = flat.select(F.explode(F.expr("transform(sequence(0, size(e) div 2 - 1), i -> struct(e[2 * i] as a, e[2 * i + 1] as b))")).alias("p")).select("p.a", "p.b")
    return twos.union(pairs)


def simhash_components(docs: DataFrame, radius: int = 3, shingle: int = 3) -> tuple[DataFrame, DataFrame]:
    """(one row per document with doc_id, text_hash, fp; one row per fp with its component's smallest doc_id).

    Exact copies and texts without a word share a fingerprint and so a component. Null doc_ids get the component of their
    text; it is null if no document of it has a doc_id. Repeated rows stay repeated. An empty table gives empty tables.
    """
    rows = saved(with_fingerprint(docs, shingle))
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(fps.select("fp"), radius))
    of = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = of.where(F.col("root") != F.col("fp")).groupBy("root").agg(F.min("least").alias("best"))
    ids = of.join(best, "root", "left").select("fp", F.least("least", "best").alias("mine"), "root")
    top = ids.where(F.col("root") == F.col("fp")).select(F.col("fp").alias("root"), F.col("mine").alias("component_id"))
    return rows, saved(ids.select("fp", "root").join(top, "root").select("fp", "component_id"))


def simhash_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs; see simhash_components."""
    rows, of = simhash_components(docs)
    return rows.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """docs without all but one document of each group: the one of smallest doc_id, then of smallest text hash.

    Rows that repeat the kept one in doc_id and text go too. Columns stay as they are. A document without doc_id is kept
    only if no other of its group has one.
    """
    rows, of = simhash_components(docs, radius, shingle)
    of = of.withColumnRenamed("component_id", "_component")
    picked = rows.join(of, "fp").groupBy("_component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("p"), F.count("*").alias("n"))
    first = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    keys = picked.select(F.col("p.doc_id").alias("doc_id"), F.col("p.text_hash").alias("text_hash")).distinct()
    keys = saved(keys.join(first, keys.doc_id.eqNullSafe(first.doc_id) & (keys.text_hash == first.text_hash)).select(keys.doc_id.alias("_id"), keys.text_hash.alias("_hash"), F.col("n").alias("_n")))

    def pick(some: DataFrame) -> DataFrame:
        rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("i"), F.col("text").alias("t"))
        return rows.join(sent_if_small(some, MOST_SENT), F.col("i").eqNullSafe(F.col("_id")) & (F.xxhash64("t") == F.col("_hash")), "left_semi")

    once, more = keys.where("_n = 1"), keys.where("_n > 1")
    return pick(once).union(pick(more).dropDuplicates(["i", "t"])).select("doc.*")
