"""Embedding by lookup and pooling: token rows of a weight table, a masked mean over each text's tokens, unit length."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.entities import Exchange
from ..plans.registry import query
from ..plans.storage import new_path
from ..sources import files

#: The stand-in model: so many tokens of so many numbers.
TOKENS, WIDTH = 997, 16
#: Token rows (padding included) that a task gathers at once, and texts of a batch.
GATHERED, TEXTS = 1 << 16, 32


def token_ids(text: Column) -> Column:
    """Ids of the words of a text: 31 times the first code point plus 7 times the length, modulo TOKENS. No ids for null or blank texts."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+", -1), "")
    return F.transform(words, lambda w: ((F.ascii(w) * 31 + F.length(w) * 7) % TOKENS).cast("int"))


def weights() -> np.ndarray:
    token, k = np.meshgrid(np.arange(TOKENS), np.arange(WIDTH), indexing="ij")
    return ((token * 31 + k * 17) % 101 - 50) / 50.0


def sent(spark: SparkSession, table: np.ndarray) -> str:
    """The name under which the executors find a weight table that goes with the job."""
    name, sink = f"weights-{uuid.uuid4().hex}.npy", io.BytesIO()
    np.save(sink, table)
    at = f"{new_path(spark)}/{name}"
    files.put(at, sink.getvalue())
    spark.sparkContext.addFile(at)
    return name


@cache
def table_of(name: str) -> np.ndarray:
    return np.load(SparkFiles.get(name), mmap_mode="r")


def sums(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """The masked sum of each text's token rows; texts are padded to the longest of them and taken in runs of columns, so memory is bounded by GATHERED rows."""
    longest = max(map(len, ids), default=0)
    padded, mask = np.zeros((len(ids), longest), np.int32), np.zeros((len(ids), longest))
    for i, own in enumerate(ids):
        padded[i, : len(own)], mask[i, : len(own)] = own, 1
    out, step = np.zeros((len(ids), table.shape[1])), max(1, GATHERED // max(len(ids), 1))
    for at in range(0, longest, step):
        out += np.einsum("bld,bl->bd", table[padded[:, at : at + step]], mask[:, at : at + step])
    return out


def pooled(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Means of unit length, in the order given; texts of like length are taken together. Zero for a text without tokens."""
    out = np.zeros((len(ids), table.shape[1]))
    order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
    for at in range(0, len(order), TEXTS):
        some = order[at : at + TEXTS]
        total = sums([ids[i] for i in some], table) / np.maximum([[len(ids[i])] for i in some], 1)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        out[some] = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
    return out


def embedded(df: DataFrame, key: str, ids: str, name: str) -> DataFrame:
    """key and vector of every row, from its token ids and the table sent as `name`."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(name)
        for part in parts:
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                out = pooled([np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32) for x in some.column(1)], table)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(out), pa.list_(pa.float64()))], ["k", "vector"])

    return df.select(F.col(key).alias("k"), F.col(ids)).mapInArrow(run, f"k {kind}, vector array<double>").withColumnRenamed("k", key)


def embed(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and vector of every text, by the stand-in model."""
    return embedded(df.select(key, token_ids(F.col(text)).alias("ids")), key, "ids", sent(df.sparkSession, weights()))


def _sql(table: str, key: str) -> str:
    return f"""WITH t AS (SELECT {key}, unnest([(ord(w) * 31 + length(w) * 7) % {TOKENS} FOR w IN regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+') IF w <> '']) AS id FROM {table}), k AS (SELECT unnest(range(0, {WIDTH})) AS k),
    c AS (SELECT {key}, id, count(*) AS n FROM t GROUP BY {key}, id), m AS (SELECT {key}, k, sum(n * (((id * 31 + k * 17) % 101 - 50) / 50.0::DOUBLE)) / sum(n) AS v FROM c CROSS JOIN k GROUP BY {key}, k), a AS (SELECT d.{key}, k.k, coalesce(m.v, 0.0::DOUBLE) AS v FROM {table} d CROSS JOIN k LEFT JOIN m ON m.{key} = d.{key} AND m.k = k.k)
    SELECT {key}, k, coalesce(round(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY {key})), 0), 6), 0) + 0.0::DOUBLE AS v FROM a"""


def numbered(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(key, F.posexplode("vector").alias("k", "v")).select(key, F.col("k").cast("long").alias("k"), (F.round("v", 6) + F.lit(0.0)).alias("v"))


@query(_sql("documents", "doc_id"))
def ml_embed(e: Exchange) -> DataFrame:
    """Whole documents embedded: texts of like length together, results by key."""
    return numbered(embed(e.documents, "doc_id", "text"), "doc_id")


@query(_sql("benchmark", "item_id"))
def fn_mean_pool_l2(e: Exchange) -> DataFrame:
    """The masked mean over tokens at unit length, for the benchmark's items."""
    return numbered(embed(e.benchmark, "item_id", "text"), "item_id")
