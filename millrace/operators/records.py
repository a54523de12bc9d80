"""Queries over JSON Lines, packed vectors and the workloads that read and write them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.entities import Exchange
from ..plans.registry import query
from ..plans.storage import new_path
from ..sources import jsonl, packed, preflight
from .pooling import embed

LINE = "CASE WHEN doc_id % 97 = 0 THEN '  ' WHEN doc_id % 89 = 1 THEN '{bad' ELSE concat('{\"id\":\"', doc_id, '\",\"', CASE WHEN doc_id % 3 = 0 THEN 'prompt' ELSE 'text' END, '\":\"', lang, ' ', source, '\"}') END"
LINES = f"(SELECT doc_id + 1 AS line_no, {LINE} AS value, doc_id FROM documents)"
GOOD = "doc_id % 97 <> 0 AND doc_id % 89 <> 1"


def lines(e: Exchange) -> DataFrame:
    """JSON Lines made from the documents' facts, with blank and malformed ones among them."""
    return e.documents.select((F.col("doc_id") + 1).alias("line_no"), F.expr(LINE).alias("value"), "doc_id")


@query(f"""SELECT count(*) FILTER (WHERE doc_id % 97 <> 0) AS records, count(*) FILTER (WHERE doc_id % 97 = 0) AS blank_records, count(*) FILTER (WHERE doc_id % 97 <> 0 AND doc_id % 89 = 1) AS malformed_records,
    count(*) FILTER (WHERE doc_id % 97 = 0 OR doc_id % 89 = 1) AS skipped_records, coalesce(min(line_no) FILTER (WHERE doc_id % 97 <> 0 AND doc_id % 89 = 1), 0) AS first_bad_line, CAST(max(octet_length(encode(value))) AS BIGINT) AS max_line_bytes,
    CAST(sum(octet_length(encode(value)) + 1) AS BIGINT) AS bytes, CAST(sum(ceil(length(value) / 4.0::DOUBLE)) FILTER (WHERE doc_id % 97 <> 0) AS BIGINT) AS estimated_tokens FROM {LINES} l""")
def fn_scan_jsonl(e: Exchange) -> DataFrame:
    return jsonl.scan(lines(e))


@query(f"SELECT line_no, value, ordinal, CAST(floor(ordinal / 256) AS BIGINT) AS chunk_index FROM (SELECT line_no, value, row_number() OVER (ORDER BY line_no) - 1 AS ordinal FROM {LINES} l WHERE doc_id % 97 <> 0) x")
def src_jsonl_split(e: Exchange) -> DataFrame:
    return jsonl.split(lines(e))


@query(f"SELECT chunk_index, count(*) AS expected_records, CAST(sum(octet_length(encode(value))) AS BIGINT) AS bytes FROM (SELECT value, CAST(floor((row_number() OVER (ORDER BY line_no) - 1) / 100) AS BIGINT) AS chunk_index FROM {LINES} l WHERE doc_id % 97 <> 0) x GROUP BY chunk_index")
def src_jsonl_stream_split(e: Exchange) -> DataFrame:
    return jsonl.split(lines(e), 100).groupBy("chunk_index").agg(F.count("*").alias("expected_records"), F.sum(F.octet_length("value")).alias("bytes"))


@query("SELECT count(*) AS records FROM documents WHERE doc_id % 97 <> 0")
def src_jsonl_count(e: Exchange) -> DataFrame:
    return lines(e).where(~jsonl.is_blank(F.col("value"))).agg(F.count("*").alias("records"))


@query(f"SELECT line_no, CASE WHEN doc_id % 89 <> 1 THEN CAST(doc_id AS VARCHAR) END AS id, CASE WHEN doc_id % 89 <> 1 THEN concat(lang, ' ', source) ELSE '' END AS body, CASE WHEN doc_id % 89 = 1 THEN 'malformed' END AS error FROM (SELECT d.*, l.line_no FROM {LINES} l JOIN documents d ON d.doc_id = l.doc_id) x WHERE doc_id % 97 <> 0")
def src_typed_jsonl(e: Exchange) -> DataFrame:
    return jsonl.typed(lines(e))


_SAMPLE = f"(SELECT d.doc_id, d.lang, d.source FROM documents d WHERE {GOOD} ORDER BY d.doc_id LIMIT 512)"


@query(f"SELECT field, count(*) AS occurrences, avg(n)::DOUBLE AS avg_string_len FROM (SELECT 'id' AS field, length(CAST(doc_id AS VARCHAR)) AS n FROM {_SAMPLE} s UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN 'prompt' ELSE 'text' END, length(concat(lang, ' ', source)) FROM {_SAMPLE} s) x GROUP BY field")
def tk_field_rank(e: Exchange) -> DataFrame:
    return jsonl.fields(lines(e))


@query("SELECT event_id, json_type(props, '$.k') = 'VARCHAR' AS is_string FROM events")
def fn_json_string(e: Exchange) -> DataFrame:
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    return e.events.select("event_id", F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)).alias("is_string"))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'duplicate_key' WHEN event_id % 13 = 0 THEN 'trailing_data' WHEN event_id % 17 = 0 THEN 'not_an_object' ELSE '' END AS error FROM events")
def fn_strict_json(e: Exchange) -> DataFrame:
    text = F.when(F.col("event_id") % 11 == 0, F.lit('{"a": {"k": 1, "k": 2}}')).when(F.col("event_id") % 13 == 0, F.concat("props", F.lit(" 1"))).when(F.col("event_id") % 17 == 0, F.lit("[1]")).otherwise(F.col("props"))
    return e.events.select("event_id", jsonl.strict_error(text).alias("error"))


@query("SELECT id, error FROM (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'empty' ELSE '' END AS error FROM documents) x")
def va_infer(e: Exchange) -> DataFrame:
    text = F.when(F.col("doc_id") % 4 == 0, '{"completions":[{"index":1,"text":"a"}]}').when(F.col("doc_id") % 4 == 1, '{"completions":[]}').otherwise('{"completions":[{"index":0,"text":"a"},{"index":1,"text":"b"}]}')
    return e.documents.select(F.col("doc_id").alias("id"), jsonl.infer_error(F.from_json(text, "completions array<struct<index int, text string>>")).alias("error"))


@query("SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'count' WHEN 1 THEN 'dimension' WHEN 2 THEN 'not_finite' WHEN 3 THEN 'zero' ELSE '' END AS error FROM embeddings")
def va_embed_json(e: Exchange) -> DataFrame:
    k, v = F.col("vec_id") % 5, F.col("embedding")
    zero = F.transform(v, lambda x: F.lit(0).cast("float"))
    vectors = F.when(k == 1, F.array(v, F.slice(v, 1, 3))).when(k == 2, F.array(v, F.transform(v, lambda x: F.lit(float("nan")).cast("float")))).when(k == 3, F.array(v, zero)).otherwise(F.array(v, v))
    return e.embeddings.select("vec_id", jsonl.embed_error(F.size(v), F.when(k == 0, 3).otherwise(2), vectors).alias("error"))


#: Vectors cut to a width, so many of them, under bounds that fit or not, with faults of all kinds; w, n, most and bound hang on vec_id.
_CASES = "vec_id % 7 + 1 AS w, vec_id % 4 AS n, vec_id % 5 AS most, CASE vec_id % 3 WHEN 0 THEN 0 WHEN 1 THEN vec_id % 7 + 1 ELSE vec_id % 7 + vec_id % 2 * 2 END AS bound, vec_id % 11 AS twist"


@query(f"""SELECT vec_id, CASE WHEN error = '' THEN n END AS rows, CASE WHEN error = '' THEN w END AS dim, error FROM (SELECT *, CASE WHEN n = 0 THEN CASE WHEN twist = 3 THEN 'json' ELSE 'count' END WHEN twist = 2 THEN 'numeric' WHEN bound > 0 AND w > bound THEN 'dimension' WHEN twist = 1 THEN 'numeric'
    WHEN bound > 0 AND w <> bound THEN 'dimension' WHEN most > 0 AND n > most THEN 'count' WHEN twist = 0 AND n = 3 THEN 'dimension' WHEN twist IN (3, 4) THEN 'json' ELSE '' END AS error FROM (SELECT vec_id, {_CASES} FROM embeddings) c) x""")
def va_embed_preflight(e: Exchange) -> DataFrame:
    """JSON vectors looked at before they are built: rows and width within the bounds of an attempt, or the kind of the first fault."""
    cases = e.embeddings.select("embedding", "vec_id", *[F.expr(c) for c in _CASES.split(", ")])
    numbers = F.transform(F.slice("embedding", F.lit(1), F.col("w").cast("int")), lambda x: x.cast("string"))
    first = F.when(F.col("twist") == 2, F.concat(F.array(F.lit('"1"')), F.slice(numbers, 2, 64))).when(F.col("twist") == 1, F.concat(F.slice(numbers, F.lit(1), (F.col("w") - 1).cast("int")), F.array(F.lit("-1e999")))).otherwise(numbers)
    third = F.when(F.col("twist") == 0, F.concat(numbers, F.array(F.lit("0.5")))).otherwise(numbers)
    gap = F.when(F.col("twist") == 5, " \n").otherwise("")
    rows = F.transform(F.slice(F.array(first, numbers, third), F.lit(1), F.col("n").cast("int")), lambda v: F.concat(F.lit("["), F.array_join(v, ","), gap, F.lit("]")))
    text = F.concat(gap, F.lit("["), F.array_join(rows, ", "), F.when(F.col("twist") == 3, "").when(F.col("twist") == 4, "] 7").otherwise("]"))
    return preflight.preflight(cases.withColumn("raw", text), "vec_id", "raw", "most", "bound")


@query("SELECT job_id, expected, got, CASE WHEN got = expected THEN '' WHEN got > expected THEN 'too_many' ELSE 'too_few' END AS error FROM (SELECT job_id, count(*) FILTER (WHERE NOT is_redundancy) AS expected, count(*) FILTER (WHERE status = 'complete') AS got FROM tasks GROUP BY job_id) x")
def va_count(e: Exchange) -> DataFrame:
    per = e.tasks.groupBy("job_id").agg(F.count_if(~F.col("is_redundancy")).alias("expected"), F.count_if(F.col("status") == "complete").alias("got"))
    return per.withColumn("error", F.when(F.col("got") == F.col("expected"), "").when(F.col("got") > F.col("expected"), "too_many").otherwise("too_few"))


@query("SELECT label, CAST(floor(vec_id / 65536) AS INTEGER) AS part, count(*) AS count, CAST(16 + 4 * 64 * count(*) AS BIGINT) AS bytes FROM embeddings GROUP BY label, 2")
def snk_packed_write(e: Exchange) -> DataFrame:
    files = packed.pack(e.embeddings, "label", "vec_id", "embedding")
    return files.select("label", F.col("part").cast("int").alias("part"), "count", F.octet_length("data").cast("long").alias("bytes"))


@query("SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS index, round(embedding[1]::DOUBLE, 6) AS first, '' AS error FROM embeddings")
def src_packed_read(e: Exchange) -> DataFrame:
    return read_packed(e.embeddings)


def read_packed(vectors: DataFrame, rows_of_a_file: int = 65_536) -> DataFrame:
    """label, index, first and error of every vector packed by label and read again; index goes on from part to part of a label."""
    rows = packed.unpack(packed.pack(vectors, "label", "vec_id", "embedding", rows_of_a_file), ["label", "part"])
    counts = vectors.groupBy("label", F.floor(F.col("vec_id") / rows_of_a_file).cast("long").alias("part")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("label").alias("_label"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row per file
    placed = rows.join(bases, F.col("label").eqNullSafe(F.col("_label")) & F.col("part").eqNullSafe(F.col("_part")), "left")
    at = F.when(F.col("error") == "", F.col("index") + F.col("base")).otherwise(F.col("index"))
    return placed.select("label", at.alias("index"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"), "error")


def synced(catalogue: DataFrame, feed: DataFrame) -> DataFrame:
    """id, job_type, price, status of a catalogue after a JSON record set (rows with `records`, an array in text) was laid over it.

    Records win over rows of their id: inserted, updated or same (null-safe); rows that no record names are removed. Of
    several records with one id the last by document and place counts; records without an id, and documents that are no
    arrays, count for nothing.
    """
    each = feed.select("document", F.posexplode(F.from_json("records", "array<struct<id string, job_type string, price long>>")).alias("place", "r")).where("r.id IS NOT NULL")
    latest = each.groupBy(F.col("r.id").alias("id")).agg(F.max_by("r", F.struct("document", "place")).alias("r")).select("id", F.col("r.job_type").alias("new_type"), F.col("r.price").alias("new_price"), F.lit(True).alias("named"))
    both = catalogue.select("id", "job_type", "price", F.lit(True).alias("known")).join(latest, "id", "full")
    same = F.col("job_type").eqNullSafe(F.col("new_type")) & F.col("price").eqNullSafe(F.col("new_price"))
    status = F.when(F.col("named").isNull(), "removed").when(F.col("known").isNull(), "inserted").when(same, "same").otherwise("updated")
    keep = lambda new, old: F.when(F.col("named").isNull(), F.col(old)).otherwise(F.col(new)).alias(old)
    return both.select("id", keep("new_type", "job_type"), keep("new_price", "price"), status.alias("status"))


@query("""WITH f AS (SELECT p_partkey, concat('m', p_partkey) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'embed' ELSE 'batch_infer' END AS job_type, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part)
    SELECT id, job_type, CASE WHEN p_partkey % 5 = 0 THEN price + 1 ELSE price END AS price, CASE WHEN p_partkey % 7 = 0 THEN 'inserted' WHEN p_partkey % 5 = 0 THEN 'updated' ELSE 'same' END AS status FROM f WHERE p_partkey % 3 <> 0 UNION ALL SELECT id, job_type, price, 'removed' FROM f WHERE p_partkey % 3 = 0 AND p_partkey % 7 <> 0""")
def src_catalog_json(e: Exchange) -> DataFrame:
    """A catalogue of models, one per part, after JSON documents of a hundred records each were written, read and laid over it.

    The catalogue lacks a seventh of the parts; the documents leave out a third and have another price for a fifth.
    """
    parts = e.part.select("p_partkey", F.concat(F.lit("m"), F.col("p_partkey")).alias("id"), F.when(F.col("p_partkey") % 2 == 0, "embed").otherwise("batch_infer").alias("job_type"), F.floor("p_retailprice").cast("long").alias("price"))
    told = parts.where("p_partkey % 3 <> 0").withColumn("price", F.col("price") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0))
    documents = told.groupBy(F.floor(F.col("p_partkey") / 100).alias("document")).agg(F.to_json(F.collect_list(F.struct("id", "job_type", "price"))).alias("records"))  # at most 100 records
    at = new_path(e.spark)
    documents.write.json(at)
    return synced(parts.where("p_partkey % 7 <> 0"), e.spark.read.schema("document long, records string").json(at))


# Workloads


Runner = Callable[[list[str]], list]
RUNNERS: dict[str, tuple[Runner, str]] = {}


def runner(job_type: str, result: str):
    """Registers a model as a function of a list of texts; it sees texts of like length together, and its order is put right after."""

    def register(f: Runner) -> Runner:
        RUNNERS[job_type] = (f, result)
        return f

    return register


@runner("batch_infer", "string")
def first_words(texts: list[str], most: int = 5) -> list:
    """A stand-in for greedy decoding: the first words again."""
    return [" ".join(t.split()[:most]) for t in texts]


def run_workload(df: DataFrame, job_type: str, key: str, text: str, batch: int = 32) -> DataFrame:
    """key and result of every row: each Arrow batch is sorted by length, run in slices, and put back in order."""
    f, result = RUNNERS[job_type]
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            order = part.t.str.len().argsort(kind="stable").to_numpy()
            out: list = [None] * len(part)
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                for i, r in zip(some, f(list(part.t.iloc[some])), strict=True):
                    out[i] = r
            yield pd.DataFrame({"k": part.k, "result": out})

    return df.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).mapInPandas(run, f"k {kind}, result {result}").withColumnRenamed("k", key)


@query("SELECT item_id, array_to_string(regexp_extract_all(text, '\\S+')[1:5], ' ') AS result FROM benchmark")
def ml_infer_runner(e: Exchange) -> DataFrame:
    return run_workload(e.benchmark, "batch_infer", "item_id", "text")


@query()
def ml_embed_runner(e: Exchange) -> DataFrame:
    return embed(e.benchmark, "item_id", "text").select("item_id", F.col("vector").cast("array<float>").alias("result"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'embed' ELSE 'batch_infer' END AS runner FROM jobs")
def ml_dispatch(e: Exchange) -> DataFrame:
    """The first registered runner that takes a job's type."""
    return e.jobs.select("id", F.coalesce(*[F.when(F.col("job_type") == k, F.lit(k)) for k in ("embed", *RUNNERS)]).alias("runner"))


def rate() -> Column:
    """Slices a second; without bound for a slice of no time, as the SQL has it."""
    return F.when(F.col("duration_ms") == 0, F.lit(float("inf"))).otherwise(1000.0 / F.nullif("duration_ms", F.lit(0)))


@query("""WITH r AS (SELECT worker_id, id, duration_ms, created_at, row_number() OVER (PARTITION BY worker_id ORDER BY created_at, id) AS n FROM durations),
    b AS (SELECT worker_id, avg(1000.0::DOUBLE / duration_ms) AS base FROM r WHERE n <= 2 GROUP BY worker_id),
    l AS (SELECT r.worker_id, r.n, 1000.0::DOUBLE / r.duration_ms < 0.75::DOUBLE * b.base AS low FROM r JOIN b ON b.worker_id = r.worker_id WHERE r.n > 2),
    s AS (SELECT *, low AND lag(low, 1, false) OVER w AND lag(low, 2, false) OVER w AS third FROM l WINDOW w AS (PARTITION BY worker_id ORDER BY n)) SELECT worker_id, min(n) AS alarm_at FROM s WHERE third GROUP BY worker_id""")
def ml_live_monitor(e: Exchange) -> DataFrame:
    """Where a worker's rate stays under 75 % of its first two slices' mean for the third time in a row."""
    w = Window.partitionBy("worker_id").orderBy(F.asc_nulls_last("created_at"), F.asc_nulls_last("id"))
    ranked = e.durations.select("worker_id", "created_at", "id", rate().alias("rate"), F.row_number().over(w).alias("n"))
    base = F.avg(F.when(F.col("n") <= 2, F.col("rate"))).over(Window.partitionBy("worker_id"))
    low = ranked.withColumn("low", F.col("rate") < 0.75 * base).where("n > 2")
    again = [F.lag("low", k, False).over(w) for k in (1, 2)]
    return low.withColumn("third", F.col("low") & again[0] & again[1]).where("third").groupBy("worker_id").agg(F.min("n").alias("alarm_at"))


@query("SELECT worker_id, max(rate) AS peak, avg(rate) FILTER (WHERE n > c * 0.75) / avg(rate) FILTER (WHERE n <= greatest(c * 0.25, 1)) >= 0.85 AS thermal_ok FROM (SELECT worker_id, 1000.0::DOUBLE / duration_ms AS rate, row_number() OVER (PARTITION BY worker_id ORDER BY created_at, id) AS n, count(*) OVER (PARTITION BY worker_id) AS c FROM durations) x GROUP BY worker_id")
def ml_sustained_bench(e: Exchange) -> DataFrame:
    own = Window.partitionBy("worker_id")
    r = e.durations.select("worker_id", rate().alias("rate"), F.row_number().over(own.orderBy(F.asc_nulls_last("created_at"), F.asc_nulls_last("id"))).alias("n"), F.count("*").over(own).alias("c"))
    mean = lambda c: F.avg(F.when(c, F.col("rate")))
    ok = mean(F.col("n") > F.col("c") * 0.75) / mean(F.col("n") <= F.greatest(F.col("c") * 0.25, F.lit(1))) >= 0.85
    return r.groupBy("worker_id").agg(F.max("rate").alias("peak"), ok.alias("thermal_ok"))
