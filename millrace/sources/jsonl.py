"""JSON Lines: scan, split into chunks, typed records, strict objects, merged results."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate

#: Records of a chunk where none are asked for; valid records that fields are discovered in.
DEFAULT_SPLIT, FIELD_SAMPLE = 256, 512


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value of each line; files keep no order among one another, so order-dependent callers bring a line_no of their own."""
    return spark.read.text(path)


def clean(value: Column) -> Column:
    return F.regexp_replace(value, r"\r$", "")


def is_blank(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[\t\r\n]", " ")) == ""


def is_valid(value: Column) -> Column:
    """A JSON object in itself."""
    v = F.try_parse_json(value)
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def scan(lines: DataFrame) -> DataFrame:
    """One row over line_no (from 1) and value: records (malformed ones count), blank, malformed, skipped, first bad line, longest line, bytes, tokens."""
    blank, valid = is_blank(F.col("value")), is_valid(F.col("value"))
    bad = ~blank & ~valid
    size = F.octet_length("value")
    return lines.agg(
        F.count_if(~blank).alias("records"), F.count_if(blank).alias("blank_records"), F.count_if(bad).alias("malformed_records"), (F.count_if(blank) + F.count_if(bad)).alias("skipped_records"),
        F.coalesce(F.min(F.when(bad, F.col("line_no"))), F.lit(0)).alias("first_bad_line"), F.coalesce(F.max(size), F.lit(0)).cast("long").alias("max_line_bytes"), F.coalesce(F.sum(size + 1), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(~blank, token_estimate(F.col("value")))), F.lit(0)).alias("estimated_tokens"),
    )


def fields(lines: DataFrame, sample: int = FIELD_SAMPLE) -> DataFrame:
    """field, occurrences, avg_string_len over the first `sample` valid records, the longest strings first."""
    some = lines.where(is_valid(F.col("value"))).orderBy("line_no").limit(sample)
    maps = some.select(F.from_json("value", "map<string,string>").alias("m"), F.try_parse_json("value").alias("v"))
    each = maps.select("v", F.explode("m").alias("field", "text")).withColumn("string", F.schema_of_variant(F.try_variant_get("v", F.concat(F.lit("$."), F.col("field")), "variant")) == "STRING")
    return each.groupBy("field").agg(F.count("*").alias("occurrences"), F.coalesce(F.avg(F.when(F.col("string"), F.length("text"))), F.lit(0.0)).alias("avg_string_len")).orderBy(F.desc("avg_string_len"), "field")


def split(lines: DataFrame, size: int = DEFAULT_SPLIT, block: int = 1 << 16) -> DataFrame:
    """line_no, value, ordinal, chunk_index of the non-blank lines.

    The ordinal is the count of earlier lines in its block of line numbers and of all earlier blocks: a window per block,
    and one over the blocks' counts, so that no task holds all lines.
    """
    size = size if size > 0 else DEFAULT_SPLIT
    kept = lines.where(~is_blank(F.col("value"))).select("line_no", clean(F.col("value")).alias("value"), F.floor(F.col("line_no") / block).alias("block"))
    per = kept.groupBy("block").agg(F.count("*").alias("n"))
    before = per.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = kept.withColumn("in_block", F.row_number().over(Window.partitionBy("block").orderBy("line_no")) - 1).join(before, "block")
    ordinal = (F.col("before") + F.col("in_block")).cast("long")
    return ranked.select("line_no", "value", ordinal.alias("ordinal"), F.floor(ordinal / size).cast("long").alias("chunk_index"))


def typed(lines: DataFrame) -> DataFrame:
    """line_no, id and body (text, else prompt, else empty) of each record; error names what is wrong with a line."""
    r = F.from_json("value", "id string, text string, prompt string")
    parsed = lines.where(~is_blank(F.col("value"))).select("line_no", F.when(is_valid(F.col("value")), r).alias("r"))
    return parsed.select("line_no", "r.id", F.coalesce("r.text", "r.prompt", F.lit("")).alias("body"), F.when(F.col("r").isNull(), "malformed").alias("error"))


def _strict(text: str | None) -> str:
    def pairs(found: list) -> dict:
        if len({k for k, _ in found}) < len(found):
            raise KeyError
        return dict(found)

    try:
        value = json.loads(text or "", object_pairs_hook=pairs)
    except KeyError:
        return "duplicate_key"
    except ValueError as e:
        return "trailing_data" if "Extra data" in str(e) else "malformed"
    return "" if isinstance(value, dict) else "not_an_object"


def strict_error(value: Column) -> Column:
    """Empty for one JSON object without a repeated key at any depth, else what is wrong; Spark's own parsers accept more."""

    @F.pandas_udf("string")
    def error(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(_strict)

    return error(value)


def merge(chunks: DataFrame) -> DataFrame:
    """job_id, chunk_index, index, global_index, value: the results of a job in chunk order; chunks has job_id, chunk_index and values (an array)."""
    before = Window.partitionBy("job_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    based = chunks.withColumn("base", F.coalesce(F.sum(F.size("values")).over(before), F.lit(0)))
    return based.select("job_id", "chunk_index", "base", F.posexplode("values").alias("index", "value")).select("job_id", "chunk_index", "index", (F.col("base") + F.col("index")).alias("global_index"), "value")


def infer_error(envelope: Column) -> Column:
    """Empty for completions whose indexes are their positions and that are as many as counted."""
    c = envelope["completions"]
    return F.when(envelope.isNull(), "malformed").when(F.size(c) == 0, "empty").when(~F.forall(F.transform(c, lambda x, i: x["index"] == i), lambda b: b), "index").otherwise("")


def embed_error(dim: Column, count: Column, vectors: Column) -> Column:
    """Empty for `count` finite vectors of `dim` numbers, none of them zero."""
    finite = lambda v: F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(count <= 0, "count").when(F.size(vectors) != count, "count").when(F.exists(vectors, lambda v: F.size(v) != dim), "dimension").when(F.exists(vectors, lambda v: ~finite(v)), "not_finite").when(F.exists(vectors, lambda v: F.forall(v, lambda x: x == 0)), "zero").otherwise("")
