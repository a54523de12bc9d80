"""Packed vectors: a 16-byte header (magic, version, dimension, count) and little-endian float32 rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC, VERSION = b"CXEM", 1


def encode(vectors: list) -> bytes:
    """All rows of one dimension, or a ValueError."""
    sizes = {len(v) for v in vectors}
    if len(sizes) > 1:
        raise ValueError("rows differ in dimension")
    dim = sizes.pop() if sizes else 0
    return MAGIC + struct.pack("<III", VERSION, dim, len(vectors)) + np.asarray(vectors, "<f4").tobytes()


def decode(data: bytes) -> tuple[np.ndarray | None, str]:
    """(rows, "") or (None, what is wrong with data)."""
    if data is None or len(data) < 16 or data[:4] != MAGIC:
        return None, "header"
    version, dim, count = struct.unpack("<III", data[4:16])
    if version != VERSION or dim == 0 or count == 0:
        return None, "header"
    if len(data) != 16 + 4 * dim * count:
        return None, "size"
    rows = np.frombuffer(data, "<f4", offset=16).reshape(count, dim)
    if not np.isfinite(rows).all():
        return None, "not_finite"
    return rows, ""


def pack(df: DataFrame, by: str, order: str, vector: str, rows_of_a_file: int = 65_536) -> DataFrame:
    """One binary per `by` and run of rows_of_a_file values of `order`: groups stay bounded, parts follow one another."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("o")
        return pd.DataFrame({"k": [group.k.iloc[0]], "part": [group.part.iloc[0]], "count": [len(group)], "data": [encode(list(group.v))]})

    kind = df.schema[by].dataType.simpleString()
    cut = df.select(F.col(by).alias("k"), F.floor(F.col(order) / rows_of_a_file).cast("long").alias("part"), F.col(order).alias("o"), F.col(vector).alias("v"))
    return cut.groupBy("k", "part").applyInPandas(one, f"k {kind}, part long, count long, data binary").withColumnRenamed("k", by)


def unpack(df: DataFrame, keys: list[str], data: str = "data") -> DataFrame:
    """keys, index and vector of every row of every sound binary; error instead of rows for one that is not."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for values in part.itertuples(index=False, name=None):
                found, wrong = decode(values[-1])
                head = {k: values[i] for i, k in enumerate(keys)}
                yield pd.DataFrame(head | {"index": np.arange(len(found)), "vector": list(found), "error": ""}) if found is not None else pd.DataFrame([head | {"index": -1, "vector": None, "error": wrong}])

    return df.select(*keys, data).mapInPandas(rows, f"{kinds}, index long, vector array<float>, error string")


def size_of(dim: Column, count: Column) -> Column:
    return 16 + 4 * dim * count
