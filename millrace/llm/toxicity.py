"""Toxicity: a logistic classifier whose score must not change when identity terms are swapped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sample_step, saved, sent_if_small

#: About so many labelled rows at most are learnt from, chosen by a hash of doc_id; so many features are weighed.
LEARN_FROM, FEATURES = 20_000, 4_096
#: Weights of the squared score change under a swap, and of the squared weights.
SWAP, RIDGE = 1.0, 1e-4
WORD = re.compile(r"[^\W\d_]+")
#: Groups of terms that name people; a term is swapped for each other one of its group.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("she", "he"), ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"), ("immigrants", "refugees", "foreigners", "natives"), ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer"), ("juden", "christen", "muslime"), ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"), ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"),
)
PREFIXES = range(3, 8)


def word_features(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its beginnings, which carry what inflected and compound words share."""
    return [xxhash.xxh32_intdigest(f"w{word}")] + [xxhash.xxh32_intdigest(f"p{word[:k]}") for k in PREFIXES if k < len(word)]


def features(text: str | None) -> set[int]:
    """The distinct features of a whole text."""
    return {f for w in set(WORD.findall((text or "").lower())) for f in word_features(w)}


def swaps(text: str | None) -> list[tuple[set[int], set[int]]]:
    """(features of a sentence's identity term, those of another term of its group), for each term that the text has."""
    there = set(WORD.findall((text or "").lower()))
    return [(set(word_features(a)), set(word_features(b))) for group in IDENTITY for a in group if a in there for b in group if b != a]


@dataclass
class Scorer:
    """A weight per feature hash. Sums of weights of a text's distinct features, with the bias, go through the logistic function."""

    weights: dict[int, float]
    bias: float
    memo: dict[str, tuple[tuple[int, float], ...]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        found: dict[int, float] = {}
        if len(self.memo) > 500_000:
            self.memo.clear()
        for w in set(WORD.findall((text or "").lower())):
            if (own := self.memo.get(w)) is None:
                own = self.memo[w] = tuple((f, self.weights[f]) for f in word_features(w) if f in self.weights)
            if own:
                found.update(own)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(sorted(found.values())), -40, 40))))


def fit(x: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], n: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean log loss + SWAP * mean squared score change of the pairs + RIDGE * |w|^2, by Adam."""
    rows, cols = np.repeat(np.arange(len(x)), [len(i) for i in x]), np.concatenate([*x, np.zeros(0, int)]).astype(int)
    drows = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]).astype(int)
    dcols = np.concatenate([*(np.concatenate(p) for p in pairs), np.zeros(0, int)]).astype(int)
    dsign = np.concatenate([*(np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in pairs), np.zeros(0)])
    w, b = np.zeros(n), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        gap = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], len(x)), -40, 40))) - y
        g = np.bincount(cols, gap[rows], n) / len(x) + 2 * RIDGE * w
        if len(pairs):
            change = np.bincount(drows, w[dcols] * dsign, len(pairs))
            g += 2 * SWAP * np.bincount(dcols, change[drows] * dsign, n) / len(pairs)
        g = np.append(g, gap.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return w, b


def learn(docs: DataFrame, labels: DataFrame, bound: int = LEARN_FROM) -> Scorer:
    """A scorer from the labelled rows of docs, about `bound` of them at most.

    Features are counted per class in a shuffle; those that tell the classes apart best come to the driver, with the
    sample's rows cut to them. Without both classes among the labels, every score is their share of 1, or 0.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    m = sample_step(marks, bound)
    marks = saved(marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(m)) == 0))

    @F.pandas_udf("array<long>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([list(features(t)) for t in part])

    @F.pandas_udf("array<struct<a array<long>, b array<long>>>")
    def swapped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([[{"a": sorted(a), "b": sorted(b)} for a, b in swaps(t)] for t in part])

    some = saved(docs.select("doc_id", "text").join(sent_if_small(marks), "doc_id").select("toxic", F.monotonically_increasing_id().alias("row"), found("text").alias("f"), swapped("text").alias("s")))
    total = some.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("ones")).first()
    if total.ones in (0, total.n):
        return Scorer({}, 40.0 if total.ones else -40.0)
    per = some.select("toxic", F.explode("f").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("one"), F.count("*").alias("n")).where("n >= 4")
    rate = total.ones / total.n
    z = F.abs(F.col("one") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    best = saved(per.select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").limit(FEATURES).select("feature"))
    names = sorted({r.feature for r in best.collect()} | {f for group in IDENTITY for t in group for f in word_features(t)})  # bounded by FEATURES and IDENTITY
    at = {f: i for i, f in enumerate(names)}
    known = some.select("row", "toxic", F.explode("f").alias("feature")).join(F.broadcast(best), "feature").groupBy("row").agg(F.max("toxic").alias("toxic"), F.collect_list("feature").alias("f"))
    rows = known.toPandas().sort_values("row")
    blank = total.n - len(rows), total.ones - int(rows.toxic.sum())
    x = [np.array(sorted(at[f] for f in fs), int) for fs in rows.f] + [np.zeros(0, int)] * blank[0]
    y = np.concatenate([rows.toxic.to_numpy(float), np.ones(blank[1]), np.zeros(blank[0] - blank[1])])
    pairs = some.select(F.explode("s").alias("p")).groupBy("p").count().orderBy(F.desc("count"), "p").select("p.a", "p.b").collect()  # at most the pairs of IDENTITY
    index = lambda fs: np.array([at[f] for f in fs], int)
    w, b = fit(x, y, [(index(p.a), index(p.b)) for p in pairs], len(names))
    return Scorer({f: float(w[i]) for f, i in at.items() if w[i]}, b)


def score(docs: DataFrame, model: Scorer) -> DataFrame:
    """doc_id and score of every row, from the whole text alone; null and empty texts get the score of no feature."""
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(weights, bias)
        for part in parts:
            yield pd.Series([own.score(t) for t in part], dtype="float64")

    return docs.select("doc_id", of("text").alias("score"))


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from labels of rows that are not held out."""
    model = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
