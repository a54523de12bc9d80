"""Substring dedup: windows of words that an earlier document has, found by backward search in an FM-index per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved, small_batches

#: Words of a window, and of the anchor that decides its shard.
WINDOW, ANCHOR = 13, 5
#: Words of a shard; its index and search then stay within a few tens of MB.
SHARD_WORDS = 100_000
#: A passage anchor met more often is dealt window by window, so that no shard depends on one anchor.
HOT = 20_000
#: Passages that a task holds before it hands them on.
PASSAGES = 20_000
#: Line numbers of removals up to this many are sent to every executor; more are joined by shuffle.
MOST_SENT = 4_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


#: Masks of the bits below each of 64.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A packed bit vector with the count of ones before each word: rank1(i) is the number of ones before i."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(bits.size // 64 * 8 + 8, np.uint8)
        packed[: (bits.size + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        return self.before[at] + np.bitwise_count(self.words[at] & _BELOW[i & 63])


class FMIndex:
    """The Burrows-Wheeler transform of a sequence of small numbers as a wavelet matrix, sorted to `depth` symbols.

    Number 0 separates texts. Suffixes are ordered by their first `depth` symbols only: for patterns of at most that length
    every interval and every rank is what a full sort gives.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n, rank, step = text.size, text.astype(np.int64), 1
        while step < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: max(n - step, 0)] = rank[step:] + 1
            rank = np.unique(rank * (n + int(text.max(initial=0)) + 2) + ahead, return_inverse=True)[1].ravel()
            step *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        symbols = text[self.suffixes - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max(initial=0)) + 1))]).astype(np.int32)
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(int(text.max(initial=0)).bit_length(), 1) - 1, -1, -1):
            ones = (symbols >> shift) & 1
            self.levels.append((shift, Bits(ones.astype(bool)), int(n - ones.sum())))
            symbols = symbols[np.argsort(ones, kind="stable")]
        self.first = np.arange(self.starts.size - 1, dtype=np.int32)
        self.first = self._down(self.first, np.zeros_like(self.first))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank1(at)
            at = np.where((symbol >> shift) & 1, np.int32(zeros) + ones, at - ones)
        return at

    def back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward step: where the suffixes before `at` stand once `symbol` is put in front."""
        return self.starts[symbol] + self._down(symbol, at) - self.first[symbol]

    def matches(self, patterns: np.ndarray, alone: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many of its last symbols occur together, of each row; first and end of the suffixes that start with them).

        A row is followed while more than `alone` suffixes match; with alone = 1, a pattern whose last symbols occur once is
        left at that interval, which is enough to know that nothing else has it.
        """
        n = len(patterns)
        low, high, length = self.starts[patterns[:, -1]], self.starts[patterns[:, -1] + 1], np.ones(n, np.int64)
        going = np.flatnonzero(high - low > alone)
        length[high <= low] = 0
        for j in range(patterns.shape[1] - 2, -1, -1):
            symbol = patterns[going, j]
            both = self.back(np.concatenate([symbol, symbol]), np.concatenate([low[going], high[going]]))
            lo, hi = both[: going.size], both[going.size :]
            there = hi > lo
            at = going[there]
            low[at], high[at] = lo[there], hi[there]
            length[at] += 1
            going = at[(hi - lo)[there] > alone]
            if not going.size:
                break
        return length, low, high


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least value of each non-empty interval, from minima over all powers of two."""
    table = [values]
    while 2 << (len(table) - 1) <= values.size:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    k = np.maximum(np.frexp((high - low).astype(float))[1] - 1, 0)
    out = np.empty(low.size, values.dtype)
    for level in np.unique(k):
        of = k == level
        out[of] = np.minimum(table[level][low[of]], table[level][high[of] - (1 << level)])
    return out


def owners(contents: list[list[bytes]], least: np.ndarray, window: int) -> list[np.ndarray]:
    """For each window of each content, the least `least` of the contents that have it: index all of them, then stream each through it."""
    ids: dict[bytes, int] = {}
    flat = [ids.setdefault(w, len(ids) + 1) if w is not None else 0 for words in contents for w in (*words, None)]
    text = np.array(flat, np.int64)
    index = FMIndex(text, window)
    sizes = np.array([len(c) + 1 for c in contents])
    of = np.repeat(np.arange(len(contents)), sizes)
    begins = np.arange(text.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    starts = np.flatnonzero(begins + window < sizes[of])
    length, low, high = index.matches(np.lib.stride_tricks.sliding_window_view(text.astype(np.int32), window)[starts], alone=1)
    best = np.where(length >= window, least_between(least[of][index.suffixes], low, high), least[of[starts]])  # what occurs once is its own
    return np.split(best, np.cumsum(sizes - window)[:-1])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class WordHashes(dict):
    """XXH3 of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def anchors(words: list[bytes], memo: WordHashes, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of the runs of windows with the same anchor: the word sequence of least hash in each."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(memo) > 500_000:
        memo.clear()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    mix = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        mix = (mix ^ h[j : j + mix.size]) * _A
        mix ^= mix >> np.uint64(29)
    mix *= _B
    mix ^= mix >> np.uint64(32)
    at = np.lib.stride_tricks.sliding_window_view(mix, window - size + 1).argmin(axis=1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [at.size - 1]])
    return mix[at[first]].view(np.int64), first, last


def repeats(docs: DataFrame, window: int = WINDOW, size: int = ANCHOR) -> DataFrame:
    """doc_id, text_hash, starts: the windows of each document that also start in one of smaller doc_id.

    Equal windows have equal anchors, so a window needs comparing only where its anchor is in two documents, and only with the
    passages around that anchor: these are dealt to shards by anchor, once for each distinct passage. A shard indexes its
    passages and streams them through the index, which gives the smallest doc_id that has each window. Work grows
    in proportion to the words; documents without doc_id are left out.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    some = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.hash("text").alias("text_hash"), "text")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for part in parts:
            found = [anchors(_words(t), memo, window, size) for t in part.text]
            spots = [(int(code) << 32) | (f[1] << 5) | (f[2] - f[1] + 1) for code, f in zip(part.text_hash, found, strict=True)]
            once = [np.zeros(f[0].size, bool) for f in found]
            for o, f in zip(once, found, strict=True):
                o[np.unique(f[0], return_index=True)[1]] = True
            yield pd.DataFrame({"doc_id": part.doc_id, "anchor": [f[0] for f in found], "spot": spots, "once": once})

    runs = some.mapInPandas(cut, f"doc_id {kind}, anchor array<long>, spot array<long>, once array<boolean>").where(F.size("anchor") > 0)
    runs = runs.select("doc_id", F.explode(F.arrays_zip("anchor", "spot", "once")).alias("r")).select("doc_id", "r.*")
    with small_batches(docs.sparkSession):
        runs = saved(runs)
    shared = saved(runs.where("once").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > HOT).alias("hot")))
    written = runs
    runs = runs.select("doc_id", "anchor", "spot").join(shared, "anchor")
    first, count = F.shiftright(F.col("spot"), 5).bitwiseAND(F.lit((1 << 27) - 1)).cast("int"), F.col("spot").bitwiseAND(F.lit(31)).cast("int")
    runs = runs.select("doc_id", F.shiftright("spot", 32).cast("int").alias("text_hash"), F.struct(first.alias("first"), (first + count - 1).alias("last"), "anchor", "hot").alias("run"))
    per = saved(runs.groupBy("doc_id", "text_hash").agg(F.collect_list("run").alias("runs")))
    drop_saved(written)
    listed, per = per, per.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    few = (per.agg(F.sum(F.size("runs") * 3 + 4)).first()[0] or 0) <= MOST_SENT
    again = some.join(F.broadcast(per) if few else per, (F.col("doc_id") == F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "text_hash", "text", *[F.col(f"runs.{c}").alias(c) for c in ("first", "last", "anchor", "hot")])

    def passages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "content", "doc_id", "text_hash", "at"]
        for part in parts:
            out: list[tuple] = []
            for doc, code, text, *runs_ in part.itertuples(index=False, name=None):
                words = _words(text)
                for first, last, anchor, hot in zip(*runs_, strict=True):
                    if hot:
                        for k in range(first, last + 1):
                            one = b" ".join(words[k : k + window])
                            out.append((xxhash.xxh3_64_intdigest(one) - (1 << 63), one, doc, code, k))
                    else:
                        out.append((anchor, b" ".join(words[first : last + window]), doc, code, first))
                if len(out) > PASSAGES:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    with small_batches(docs.sparkSession):
        met = saved(again.mapInPandas(passages, f"key long, content binary, doc_id {kind}, text_hash int, at int"), "zstd")
    drop_saved(listed)
    met = met.withColumn("code", F.xxhash64("content"))
    distinct = saved(met.groupBy("key", "code", "content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "zstd")
    total = distinct.agg(F.sum(F.size(F.split(F.col("content").cast("string"), " ")))).first()[0] or 0
    shards = max(1, -(-total // SHARD_WORDS))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        best = owners([c.split(b" ") for c in group.content], group.least.to_numpy(np.int64), window)
        keep = [bool((b < m).any()) for b, m in zip(best, group.most, strict=True)]
        return pd.DataFrame({"key": group.key[keep], "code": group.code[keep], "owners": [b for b, k in zip(best, keep, strict=True) if k]})

    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    found = saved(distinct.withColumn("shard", shard).groupBy("shard").applyInPandas(search, "key long, code long, owners array<long>"))
    hits = met.select("key", "code", "doc_id", "text_hash", "at").join(found, ["key", "code"])
    mine = F.filter(F.transform("owners", lambda o, k: F.when(o < F.col("doc_id"), F.col("at") + k)), lambda x: x.isNotNull())
    return hits.select("doc_id", "text_hash", mine.alias("s")).where(F.size("s") > 0).groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("starts"))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words that no repeated window covers, joined by one space) for every row of docs.

    Null and empty texts have no words; a document without doc_id keeps all; rows that repeat a doc_id do not remove each
    other's words. Windows are judged on the whole input, not on what is left.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = saved(repeats(docs, window)).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    few = (found.agg(F.sum(F.size("starts") + 4)).first()[0] or 0) <= MOST_SENT
    joined = docs.select("doc_id", "text").join(F.broadcast(found) if few else found, (F.col("doc_id") == F.col("_id")) & (F.hash("text") == F.col("_hash")), "left").select("doc_id", "text", "starts")

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes, removed, kept = [], [], []
            for text, starts in zip(part.text, part.starts, strict=True):
                words = _words(text)
                gone = np.zeros(len(words) + 1, np.int64)
                if starts is not None:
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, np.asarray(starts) + window, -1)
                covered = np.cumsum(gone)[:-1] > 0
                sizes.append(len(words))
                removed.append(int(covered.sum()))
                kept.append(b" ".join(w for w, c in zip(words, covered, strict=True) if not c) if covered.any() else b" ".join(words))
            yield pd.DataFrame({"doc_id": part.doc_id.astype("Int64"), "n_words": sizes, "n_removed": removed, "kept": kept})

    return joined.mapInPandas(keep, f"doc_id {kind}, n_words long, n_removed long, kept binary")


def substring_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of what is kept."""
    with small_batches(docs.sparkSession):
        return saved(substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS k, w FROM d),
x AS (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY w[k:k + 12]) AS least FROM i),
r AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS p FROM x WHERE least < doc_id),
g AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, p: NOT list_contains(gone, p)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
