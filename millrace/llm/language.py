"""Language identification by error-correcting output codes over character n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sample_step

#: Hashed n-grams of 1 to MOST characters.
MOST, BUCKETS = 3, 1 << 14
#: About so many labelled rows at most are learnt from, chosen by a hash of doc_id.
LEARN_FROM = 50_000
#: Best and second loss nearer than this: the text is flagged as ambiguous.
CLOSE = 0.05


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, lower-cased, with one space for each run of non-letters; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes] if codes.size else np.zeros(0, bool)
    if not letter.any():
        return None
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    counts = np.zeros(BUCKETS)
    h = np.zeros(codes.size, np.uint64)
    for n in range(1, MOST + 1):
        if codes.size < n:
            break
        h = (h[: codes.size - n + 1] * np.uint64(0x100000001B3)) ^ codes[n - 1 :]
        mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((mixed >> np.uint64(64 - 14)).astype(np.int64), minlength=BUCKETS)
    return counts


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1. Up to 7 languages get every split in two; more get 10 log2(n) random bits, the best of 200 draws."""
    if n <= 7:
        return np.array([[1 if i == 0 or (b >> (i - 1)) & 1 else -1 for b in range(2 ** max(n - 1, 0) - 1)] for i in range(n)], int).reshape(n, 2 ** max(n - 1, 0) - 1)
    draw = np.random.default_rng(0)
    tries = [draw.choice([-1, 1], (n, 10 * int(np.ceil(np.log2(n))))) for _ in range(200)]
    apart = lambda c: min(((c[i] != c[i + 1 :]).sum(axis=1).min() for i in range(n - 1)), default=0)
    return max((c for c in tries if (np.abs(c.sum(axis=0)) < n).all()), key=apart)


@dataclass
class Codes:
    """langs, their codewords, a weight per n-gram and bit, and how far each bit's classifier is trusted on each language."""

    langs: list[str]
    words: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, counts: np.ndarray) -> np.ndarray:
        """What the binary classifiers say: mean log odds of the text's n-grams, per bit."""
        return counts @ self.weights / counts.sum()

    def decode(self, counts: np.ndarray | None) -> tuple[str, float, bool]:
        """Language of the least trust-weighted loss, its share of exp(-loss), whether the second is close."""
        if counts is None or not self.langs:
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        loss = (self.trust * np.exp(-self.words * np.clip(4 * self.margins(counts), -8, 8))).sum(axis=1)
        near = np.sort(loss)[:2]
        share = np.exp(-(loss - loss.min()) * 4)
        return self.langs[int(loss.argmin())], float(share.max() / share.sum()), bool(near[1] - near[0] < CLOSE)


def learn(docs: DataFrame, bound: int = LEARN_FROM) -> Codes:
    """Codes from text and lang of docs, at most about `bound` rows of it. Counts come back per language, not per document."""
    some = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    m = sample_step(some, bound)
    some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(m)) == 0).select(F.col("lang").alias("lang"), "text")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for lang, text in zip(part.lang, part.text, strict=True):
                if (c := ngrams(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + c / c.sum()
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": c[at]})

    rows = some.mapInPandas(count, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(rows.lang))
    words = codewords(len(langs))
    per = np.zeros((len(langs), BUCKETS))
    for i, lang in enumerate(langs):
        own = rows[rows.lang == lang]
        per[i, own.bucket] = own.n / own.n.sum()
    smooth = 1e-5
    share = lambda bit: np.log((per[bit].mean(axis=0) if bit.any() else np.zeros(BUCKETS)) + smooth)
    weights = np.stack([share(words[:, b] > 0) - share(words[:, b] < 0) for b in range(words.shape[1])], axis=1) if words.size else np.zeros((BUCKETS, 0))
    model = Codes(langs, words, weights, np.ones(words.shape))
    if not words.size:
        return model

    def right(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, seen = np.zeros(words.shape), np.zeros(len(langs))
        for part in parts:
            for lang, text in zip(part.lang, part.text, strict=True):
                if (c := ngrams(text)) is not None:
                    i = langs.index(lang)
                    hits[i] += np.sign(model.margins(c)) == words[i]
                    seen[i] += 1
        i, b = np.indices(words.shape)
        yield pd.DataFrame({"i": i.ravel(), "b": b.ravel(), "hits": hits.ravel(), "seen": np.repeat(seen, words.shape[1])})

    found = some.mapInPandas(right, "i int, b int, hits double, seen double").groupBy("i", "b").agg((F.sum("hits") / F.greatest(F.sum("seen"), F.lit(1.0))).alias("rate")).toPandas()
    trust = np.zeros(words.shape)
    trust[found.i, found.b] = found.rate
    model.trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9)
    return model


def predict(docs: DataFrame, model: Codes) -> DataFrame:
    """docs' doc_id with lang_pred, score and ambiguous, from the text alone, for every row.

    Null texts and texts without a letter are `und` with score 0; so is every text where nothing could be learnt.
    """

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([model.decode(ngrams(t)) for t in part], columns=["lang_pred", "score", "ambiguous"]).astype({"lang_pred": "str", "score": "float64", "ambiguous": "bool"})

    return docs.select("doc_id", decode("text").alias("p")).select("doc_id", "p.*")


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learnt from the rows that are not held out."""
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
