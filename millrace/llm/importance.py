"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_rows, let, saved, sent_if_small, words

#: Hashed one- and two-word sequences.
BUCKETS = 10_000
SEED = 17


def buckets(text: Column) -> Column:
    """The bucket of each word and of each two successive words of a whole text."""
    at = lambda *w: F.pmod(F.xxhash64(*w), F.lit(BUCKETS)).cast("int")
    two = lambda w: F.when(F.size(w) < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: at(F.get(w, i), F.get(w, i + 1))))
    return let(words(F.lower(text)), lambda w: F.concat(F.transform(w, lambda x: at(x)), two(w)))


def ngram_models(docs: DataFrame, target_ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(log probabilities in target text, in all text) per bucket: counted over every document, add-one smoothed.

    target_ids has distinct doc_ids; rows that share one of them are target text. BUCKETS rows come to the driver.
    """
    marks = sent_if_small(target_ids.select(F.col("doc_id").alias("_id")))
    some = docs.select("doc_id", buckets(F.col("text")).alias("b")).join(marks, F.col("doc_id") == F.col("_id"), "left")
    rows = some.select(F.col("_id").isNotNull().alias("hit"), F.explode("b").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("hit").alias("target")).toPandas()
    logs = []
    for name in ("target", "raw"):
        n = np.ones(BUCKETS)
        n[rows.bucket] += rows[name]
        logs.append(np.log(n / n.sum()))
    return logs[0], logs[1]


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, sample_key, selected for every row of docs.

    log_weight is the log ratio of a text's n-grams under the target model (documents labelled quality 1) and under the
    raw one (all documents); sample_key adds Gumbel noise that hangs on doc_id alone, and the rows of the largest keys
    are selected: sampling without replacement, each draw in proportion to the weights. share of the rows are selected;
    by default the share of quality 1 among the labels. Null and empty texts weigh 1 (log 0). Rows that tie in key and doc_id
    at the cut are all selected. Without labels the models agree and half of the rows are selected, by noise alone.
    """
    marks = saved(labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")))
    if share is None:
        share = marks.agg(F.avg("quality")).first()[0]
        share = 0.5 if share is None else float(share)
    target, raw = ngram_models(docs, marks.where("quality = 1").select("doc_id"))
    ratio = target - raw

    def log_weight(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part.doc_id.astype("Int64"), "log_weight": [float(ratio[b].sum()) for b in part.b]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", buckets(F.col("text")).alias("b")).mapInPandas(log_weight, f"doc_id {kind}, log_weight double")
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    rows = saved(rows.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(unit))).alias("sample_key")))
    order = [F.col("sample_key").desc(), F.col("doc_id").asc_nulls_last()]
    last = first_rows(rows.select("sample_key", "doc_id"), order, round(share * rows.count()))
    if last is None:
        return rows.withColumn("selected", F.lit(False))
    tie = F.lit(True) if last.doc_id is None else F.coalesce(F.col("doc_id") <= last.doc_id, F.lit(False))
    return rows.withColumn("selected", (F.col("sample_key") > last.sample_key) | ((F.col("sample_key") == last.sample_key) & tie))
