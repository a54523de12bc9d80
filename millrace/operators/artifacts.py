"""The write side: results of chunks merged into objects, written in parts, read back and compared."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.entities import Exchange
from ..plans.registry import query
from ..plans.storage import new_path, written
from ..sources import files, multipart, packed

#: Rows of a chunk in the queries below; chunks of a block when their records are summed.
CHUNK, BLOCK = 100, 65_536
#: JSON results: vectors, or completions kept as they stand.
ENVELOPE = "vectors array<array<float>>, completions array<string>"


def earlier_records(chunks: DataFrame) -> DataFrame:
    """base of every (job, chunk): the records of the job's earlier chunks, from sums per block and then over blocks, so that a job of any number of chunks is spread."""
    block = F.floor(F.col("chunk") / BLOCK).alias("block")
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.select("job", "chunk", "records", block)
    of_block = rows.groupBy("job", "block").agg(F.sum("records").alias("n")).select("job", "block", F.coalesce(F.sum("n").over(upto("job", "block")), F.lit(0)).alias("before"))
    inside = rows.withColumn("inside", F.coalesce(F.sum("records").over(upto("job", "block", "chunk")), F.lit(0)))
    return inside.join(of_block, ["job", "block"]).select("job", "chunk", (F.col("before") + F.col("inside")).cast("long").alias("base"))


def merged_lines(results: DataFrame) -> DataFrame:
    """key, chunk, i, data: a line per record of JSON results (job, chunk, body), in chunk order.

    A vector gets its index in the job; a completion stays as it is; a body without either is one line, trimmed.
    """
    text = F.col("body").cast("string")
    read = results.select("job", "chunk", text.alias("text"), F.from_json(text, ENVELOPE).alias("r"))
    vectors, completions = F.coalesce(F.size("r.vectors"), F.lit(0)), F.coalesce(F.size("r.completions"), F.lit(0))
    n = F.when(vectors > 0, vectors).when(completions > 0, completions).otherwise(1)
    sized = read.withColumn("records", n)
    based = sized.join(earlier_records(sized), ["job", "chunk"])
    line = lambda v, i: F.to_json(F.struct((F.col("base") + i).alias("index"), v.alias("vector")))
    lines = F.when(vectors > 0, F.transform("r.vectors", line)).when(completions > 0, F.transform("r.completions", lambda c: F.trim(c))).otherwise(F.array(F.trim(F.col("text"))))
    each = based.select(F.col("job").alias("key"), "chunk", F.posexplode(lines).alias("i", "line"))
    return each.select("key", "chunk", F.col("i").cast("long").alias("i"), F.concat("line", F.lit("\n")).cast("binary").alias("data"))


def little_endian(n: Column) -> Column:
    """n as four bytes, the lowest first."""
    pair = lambda k: F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0")
    return F.unhex(F.concat(*[pair(k) for k in range(4)]))


def number(data: Column, at: int) -> Column:
    """The four bytes of data from `at` (from 1), the lowest first."""
    return F.conv(F.concat(*[F.hex(F.substring(data, at + k, 1)) for k in (3, 2, 1, 0)]), 16, 10).cast("long")


def merged_vectors(results: DataFrame) -> DataFrame:
    """key, chunk, i, data: a header per job, then the rows of its packed results (job, chunk, body) in chunk order.

    A job of unlike dimensions, or of more rows than the header's four bytes can count, is an error.
    """
    parsed = results.select("job", "chunk", number(F.col("body"), 9).alias("dim"), number(F.col("body"), 13).alias("count"), F.substring("body", 17, 1 << 30).alias("data"))
    sums = parsed.groupBy("job").agg(F.min("dim").alias("dim"), F.max("dim").alias("most"), F.sum("count").alias("count"))
    wrong = lambda c, why: F.when(c, F.raise_error(F.concat(F.lit(why), F.lit(" in job "), F.col("job"))).cast("binary"))
    head = F.coalesce(wrong(F.col("dim") != F.col("most"), "unlike dimensions"), wrong(F.col("count") >= 1 << 32, "too many rows"), F.concat(F.lit(packed.MAGIC), little_endian(F.lit(packed.VERSION)), little_endian(F.col("dim")), little_endian(F.col("count"))))
    heads = sums.select(F.col("job").alias("key"), F.lit(-1).cast("long").alias("chunk"), F.lit(0).cast("long").alias("i"), head.alias("data"))
    return heads.unionByName(parsed.select(F.col("job").alias("key"), "chunk", F.lit(0).cast("long").alias("i"), "data"))


def object_digests(spark: SparkSession, path: str) -> DataFrame:
    """key, bytes, records, sha256 of every object as it stands in its files now; an object's parts are streamed by one task, in blocks."""
    import hashlib

    at = f"{path}/{multipart.manifest(path)['run']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        out: list = []
        for batch in batches:
            for k, file, n in zip(*[batch.column(c).to_pylist() for c in ("key", "file", "records")], strict=True):
                if k != key:
                    key = k
                    out.append([k, 0, 0, hashlib.sha256()])
                where, name = files.at(f"{at}/{file}")
                with where.open_input_stream(name) as source:
                    while block := source.read(1 << 20):
                        out[-1][3].update(block)
                        out[-1][1] += len(block)
                out[-1][2] += n
            yield told(out[:-1])
            out = out[-1:]
        yield told(out)

    def told(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": [r[0] for r in rows], "bytes": [r[1] for r in rows], "records": [r[2] for r in rows], "sha256": [r[3].hexdigest() for r in rows]}, schema=pa.schema([("key", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, for by its few bytes the listing would go to one task
    listed = multipart.parts(spark, path).select("key", "task", "part", "file", "records").repartition(n, "key").sortWithinPartitions("key", "task", "part")
    return listed.mapInArrow(run, "key string, bytes long, records long, sha256 string")


# Results of the given tables


def packed_chunks(e: Exchange) -> DataFrame:
    """job, chunk, body: the vectors of a label in chunks, packed."""
    files_ = packed.pack(e.embeddings.where("label % 2 = 0 OR label >= 7"), "label", "vec_id", "embedding", CHUNK)
    return files_.select(F.concat(F.lit("embed-"), F.col("label").cast("string")).alias("job"), F.col("part").alias("chunk"), F.col("data").alias("body"))


def json_vectors(e: Exchange) -> DataFrame:
    """job, chunk, body: the vectors of other labels in chunks, as JSON."""
    rows = e.embeddings.where("label % 2 = 1 AND label < 7").groupBy("label", F.floor(F.col("vec_id") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))  # at most CHUNK rows
    body = F.to_json(F.struct(F.lit("embed").alias("job_type"), F.size("rows").alias("count"), F.col("rows.embedding").alias("vectors")))
    return rows.select(F.concat(F.lit("embed-"), F.col("label").cast("string")).alias("job"), "chunk", body.cast("binary").alias("body"))


def json_completions(e: Exchange) -> DataFrame:
    """job, chunk, body: whole texts of a language as completions, in chunks, as JSON."""
    rows = e.documents.groupBy("lang", F.floor(F.col("doc_id") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("rows"))  # at most CHUNK rows
    each = F.transform("rows", lambda r, i: F.struct(i.alias("index"), r["text"].alias("text")))
    return rows.select(F.concat(F.lit("infer-"), F.col("lang")).alias("job"), "chunk", F.to_json(F.struct(F.lit("batch_infer").alias("job_type"), each.alias("completions"))).cast("binary").alias("body"))


_HEX = "hex(CAST(CAST(x AS BIT) AS BLOB))"
#: The rows of embeddings with their vector's bytes in hex, each number's lowest byte first.
_BODIES = f"(SELECT label, vec_id, CAST(floor(vec_id / {CHUNK}) AS BIGINT) AS chunk, array_to_string([concat(substr({_HEX}, 7, 2), substr({_HEX}, 5, 2), substr({_HEX}, 3, 2), substr({_HEX}, 1, 2)) FOR x IN embedding], '') AS body FROM embeddings)"


def _header(count: str) -> str:
    return f"concat('{(packed.MAGIC + struct.pack('<II', packed.VERSION, 64)).hex()}', " + ", ".join(f"lpad(hex(({count} >> {8 * k}) & 255), 2, '0')" for k in range(4)) + ")"


@query(f"SELECT count(*) AS count, 64::BIGINT AS dim, CAST(16 + 256 * count(*) AS BIGINT) AS bytes, sha256(unhex(concat({_header('count(*)')}, string_agg(body, '' ORDER BY label, chunk, vec_id)))) AS sha256, count(*) AS rows_read, count(*) AS rows_equal FROM {_BODIES} b")
def snk_cxem_merge_file(e: Exchange) -> DataFrame:
    """All vectors as one object whose header is written in the commit; then what stands there: its bytes, its digest, and its rows against the table's."""
    at = new_path(e.spark)
    rows = e.embeddings.select("label", F.floor(F.col("vec_id") / CHUNK).alias("chunk"), "vec_id", "embedding")
    multipart.write_vectors(rows, at, ["label", "chunk", "vec_id"], "embedding")
    back = e.spark.read.format("packed_vectors").load(at).select(F.xxhash64("vector").alias("h"))
    same = back.groupBy("h").agg(F.count("*").alias("n")).join(e.embeddings.groupBy(F.xxhash64("embedding").alias("h")).agg(F.count("*").alias("m")), "h", "full")
    read = same.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read"), F.coalesce(F.sum(F.least("n", "m")), F.lit(0)).alias("rows_equal"))  # one row
    return multipart.whole_digest(e.spark, at).join(read)


@query(f"""SELECT concat('embed-', label) AS job, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS line_no, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS index, round(embedding[1]::DOUBLE, 6) AS first, NULL AS text_md5, true AS sound FROM embeddings WHERE label % 2 = 1 AND label < 7
    UNION ALL SELECT concat('infer-', lang), row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1, row_number() OVER (PARTITION BY lang, CAST(floor(doc_id / {CHUNK}) AS BIGINT) ORDER BY doc_id) - 1, NULL, md5(text), true FROM documents""")
def snk_ndjson_merge(e: Exchange) -> DataFrame:
    """JSON results of chunks merged into a text object per job, written in parts, and its lines read back with their number in the object."""
    at = new_path(e.spark)
    multipart.write_ordered(merged_lines(json_vectors(e).unionByName(json_completions(e))), at, ["chunk", "i"])
    return lines_of(e.spark, at)


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """job, line_no and what each line of the written objects holds; sound is false where a part is not what was written."""
    r = F.from_json(F.col("line").cast("string"), "index long, vector array<float>, text string")
    each = multipart.lines(spark, path).select(F.col("key").alias("job"), "line_no", r.alias("r"), "sound")
    return each.select("job", "line_no", "r.index", F.round(F.get("r.vector", F.lit(0)).cast("double"), 6).alias("first"), F.md5("r.text").alias("text_md5"), "sound")


def spoilt(results: DataFrame) -> DataFrame:
    """What of the results reaches the store: a chunk lost, one in the other format, one cut short."""
    of = lambda n: (F.col("job") == f"embed-{n}") & (F.col("chunk") == 1)
    other = F.lit('{"job_type":"embed","vectors":[[1.0]]}').cast("binary")
    body = F.when(of(8), other).when(of(9), F.substring(F.col("body"), F.lit(1), F.octet_length("body") - 1)).otherwise(F.col("body"))
    return results.where(~of(7)).withColumn("body", body)


def judged(expected: DataFrame, spark: SparkSession, store: str) -> DataFrame:
    """job, chunk, format, status, body of every expected chunk (job, chunk, bytes, sha256): missing, mixed (not of the format of the job's first chunk), corrupt, or nothing.

    The store's objects are named job/chunk. A format is told by the first bytes. What differs in size or digest from what
    the worker recorded, or cannot be parsed, is corrupt.
    """
    found = multipart.read_back(spark, store).select(F.substring_index("key", "/", 1).alias("job"), F.substring_index("key", "/", -1).cast("long").alias("chunk"), F.col("content").alias("body"), "found_bytes", "found_sha256")
    kind = F.when(F.col("body").isNull(), None).when(F.substring("body", 1, 4) == F.lit(packed.MAGIC), "packed").otherwise("json")
    formats = expected.select("job", "chunk").join(found.select("job", "chunk", kind.alias("format")), ["job", "chunk"], "left")
    own = formats.groupBy("job").agg(F.min_by("format", F.when(F.col("format").isNotNull(), F.col("chunk"))).alias("own"))
    rows = expected.join(own, "job").join(found, ["job", "chunk"], "left").withColumn("format", kind)  # bodies are dealt by chunk, never by job
    dim, count = number(F.col("body"), 9), number(F.col("body"), 13)
    parsed = F.when(F.col("format") == "packed", F.coalesce((dim > 0) & (count > 0) & (F.octet_length("body") == 16 + 4 * dim * count), F.lit(False))).otherwise(F.schema_of_variant(F.try_parse_json(F.col("body").cast("string"))).startswith("OBJECT"))
    status = F.when(F.col("body").isNull(), "missing").when(F.col("format") != F.col("own"), "mixed").when((F.col("found_bytes") != F.col("bytes")) | (F.col("found_sha256") != F.col("sha256")) | ~F.coalesce(parsed, F.lit(False)), "corrupt").otherwise("")
    return rows.select("job", "chunk", "own", "format", "bytes", "sha256", status.alias("status"), "body")


@query(f"""WITH c AS (SELECT concat('embed-', label) AS job, label, chunk, count(*) AS records, concat({_header('count(*)')}, string_agg(body, '' ORDER BY vec_id)) AS data FROM {_BODIES} b WHERE label % 2 = 0 OR label >= 7 GROUP BY label, chunk),
    m AS (SELECT concat('embed-', label) AS job, count(*) AS records, concat({_header('count(*)')}, string_agg(body, '' ORDER BY vec_id)) AS data FROM {_BODIES} b WHERE label % 2 = 0 OR label >= 7 GROUP BY label),
    d AS (SELECT concat('infer-', lang) AS job, CAST(floor(doc_id / {CHUNK}) AS BIGINT) AS chunk, doc_id, to_json({{'index': row_number() OVER (PARTITION BY lang, CAST(floor(doc_id / {CHUNK}) AS BIGINT) ORDER BY doc_id) - 1, 'text': text}})::VARCHAR AS line FROM documents),
    i AS (SELECT job, chunk, count(*) AS records, encode(concat('{{"job_type":"batch_infer","completions":[', string_agg(line, ',' ORDER BY doc_id), ']}}')) AS data FROM d GROUP BY job, chunk),
    j AS (SELECT job, count(*) AS records, encode(string_agg(concat(line, chr(10)), '' ORDER BY doc_id)) AS data FROM d GROUP BY job),
    bad AS (SELECT job, max(chunk) AS has FROM c WHERE label IN (7, 8, 9) AND chunk = 1 GROUP BY job)
    SELECT job, chunk, 'packed' AS format, '' AS status, records, CAST(length(data) / 2 AS BIGINT) AS bytes, sha256(unhex(data)) AS sha256 FROM c WHERE NOT (label IN (7, 8, 9) AND chunk = 1)
    UNION ALL SELECT job, chunk, 'packed', CASE label WHEN 7 THEN 'missing' WHEN 8 THEN 'mixed' ELSE 'corrupt' END, NULL, NULL, NULL FROM c WHERE label IN (7, 8, 9) AND chunk = 1
    UNION ALL SELECT m.job, -1, 'packed', 'merged', records, CAST(length(data) / 2 AS BIGINT), sha256(unhex(data)) FROM m LEFT JOIN bad ON bad.job = m.job WHERE bad.job IS NULL
    UNION ALL SELECT job, chunk, 'json', '', records, octet_length(data), sha256(data) FROM i UNION ALL SELECT job, -1, 'json', 'merged', records, octet_length(data), sha256(data) FROM j""")
def snk_merge_driver(e: Exchange) -> DataFrame:
    """Every expected chunk with what is wrong with it, and (chunk -1) the merged object of every job without a fault, as read back.

    Results go to the store first, where one is lost, one is of another format and one is cut short. A job's objects are
    merged in its own format, written in parts and read back; the object counts as merged only if every part has
    the size and digest that it had when written.
    """
    spark = e.spark
    results = packed_chunks(e).unionByName(json_completions(e))
    results = written(results)
    expected = results.select("job", "chunk", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha256"))
    store = new_path(spark)
    multipart.write_ordered(spoilt(results).select(F.concat_ws("/", "job", "chunk").alias("key"), F.col("body").alias("data")), store, [])
    chunks = written(judged(expected, spark, store))
    faulty = chunks.where("status <> ''").select("job").distinct()
    sound = chunks.join(chunks.select("job", "chunk").join(faulty, "job", "left_anti"), ["job", "chunk"], "left_semi")
    out = new_path(spark)
    pieces = merged_vectors(sound.where("own = 'packed'")).unionByName(merged_lines(sound.where("own = 'json'")))
    multipart.write_ordered(pieces, out, ["chunk", "i"])
    as_written = F.coalesce((F.col("found_sha256") == F.col("sha256")) & (F.col("found_bytes") == F.col("bytes")), F.lit(False))
    intact = multipart.read_back(spark, out).groupBy("key").agg(F.bool_and(as_written).alias("intact"))
    good, clean = F.col("status") == "", F.from_json(F.col("body").cast("string"), ENVELOPE)
    n = F.when(F.col("own") == "packed", number(F.col("body"), 13)).otherwise(F.size(clean["completions"])).cast("long")
    each = chunks.select("job", "chunk", F.col("own").alias("format"), "status", F.when(good, n).alias("records"), F.when(good, F.col("bytes")).alias("bytes"), F.when(good, F.col("sha256")).alias("sha256"))
    of_job = sound.groupBy("job").agg(F.min("own").alias("format"), F.sum(n).alias("records"))
    whole = object_digests(spark, out).select(F.col("key").alias("job"), "bytes", "sha256").join(intact.withColumnRenamed("key", "job"), "job").join(of_job, "job")
    return each.unionByName(whole.select("job", F.lit(-1).cast("long").alias("chunk"), "format", F.when(F.col("intact"), "merged").otherwise("not as written").alias("status"), "records", "bytes", "sha256"))
