"""Inputs of jobs: given in the request or as a key to an object of the buyer's own, and a look at their first bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.entities import Exchange
from ..plans.registry import query
from ..plans.storage import new_path
from ..sources import multipart

#: Bytes of a sample; lines of a block when bytes are summed.
SAMPLE, BLOCK = 1 << 20, 1 << 12


def resolved(requests: DataFrame, jobs: DataFrame, objects: DataFrame) -> DataFrame:
    """id, origin (inline or object), line_no, value of every line of every request's input, or one row with its error.

    requests has id, buyer_id and raw: a JSON string of lines, or an object with an s3_key. A key must name an object of a
    job (jobs/<id>/...) that the same buyer submitted; jobs has id and buyer_id, objects has key, line_no and value. The
    errors: required, malformed, not_a_job, foreign (also for a job that is not there), gone. Nobody's lines are joined to a
    request before its key has been found to be its buyer's.
    """
    raw = F.trim(F.coalesce("raw", F.lit("")))
    text = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string", {"mode": "PERMISSIVE"})["v"]
    key = F.from_json(raw, "s3_key string")["s3_key"]
    told = requests.select("id", "buyer_id", raw.alias("raw"), F.when(raw.startswith('"'), text).alias("text"), F.when(raw.startswith("{"), key).alias("key"))
    told = told.withColumn("job", F.regexp_extract(F.coalesce("key", F.lit("")), r"^jobs/([0-9]{1,18})/", 1)).withColumn("job", F.when(F.col("job") != "", F.col("job").cast("long")))
    owners = jobs.select(F.col("id").alias("job"), F.col("buyer_id").alias("owner"))
    judged = told.join(owners, "job", "left")
    has_key = F.coalesce(F.col("key"), F.lit("")) != ""
    error = F.when(F.col("raw").isin("", "null"), "required").when(F.col("text").isNotNull(), None).when(~has_key, "malformed").when(F.col("job").isNull(), "not_a_job").when(~F.coalesce(F.col("owner") == F.col("buyer_id"), F.lit(False)), "foreign")
    judged = judged.withColumn("error", error)
    none = [F.lit(None).cast("string").alias("origin"), F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("value")]
    refused = judged.where("error IS NOT NULL").select("id", *none, "error")
    pieces = F.split("text", "\n")
    whole = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    own = judged.where("text IS NOT NULL").select("id", F.lit("inline").alias("origin"), F.posexplode(whole).alias("line_no", "value"))
    inline = own.select("id", "origin", F.col("line_no").cast("long").alias("line_no"), "value", F.lit(None).cast("string").alias("error"))
    wanted = judged.where("error IS NULL AND text IS NULL").select("id", "key")
    found = wanted.join(objects.select("key", "line_no", "value"), "key", "left").select("id", F.when(F.col("line_no").isNotNull(), "object").alias("origin"), "line_no", "value", F.when(F.col("line_no").isNull(), "gone").alias("error"))
    return refused.unionByName(inline).unionByName(found)


def stored_lines(e: Exchange, path: str) -> DataFrame:
    """key, line_no, value of the text objects at path; parts hold whole lines, and numbers go on from part to part."""
    return multipart.lines(e.spark, path).select("key", "line_no", F.col("line").cast("string").alias("value"))


def peeked(lines: DataFrame, most: int = SAMPLE) -> DataFrame:
    """id, line_no, piece: the first `most` bytes of each id's lines (each with its line feed) in order; of the line that crosses the bound, its beginning.

    Bytes are summed per block of lines first. Only lines of the blocks that begin inside the bound are put in order, so a
    long input costs one sum. line_no must be unique per id; null values are empty lines.
    """
    data = F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).cast("binary")
    rows = lines.select("id", "line_no", data.alias("data"), F.floor(F.col("line_no") / BLOCK).alias("block"))
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("id", "block").agg(F.sum(F.octet_length("data")).alias("n")).select("id", "block", F.coalesce(F.sum("n").over(upto("id", "block")), F.lit(0)).alias("before"))
    near = rows.join(sums.where(F.col("before") < most), ["id", "block"])
    left = most - F.col("before") - F.coalesce(F.sum(F.octet_length("data")).over(upto("id", "block", "line_no")), F.lit(0))
    return near.withColumn("left", left).where("left > 0").select("id", "line_no", F.substring("data", F.lit(1), F.least(F.col("left"), F.octet_length("data")).cast("int")).alias("piece"))


#: A request per job: lines in the request, a key of the buyer's own or another's, or something that is neither.
RAW = """CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN concat('"{\\\\"id\\\\":', o_orderkey, '}\\\\n{\\\\"id\\\\":\\\\"second\\\\"}\\\\n"') WHEN 2 THEN concat('{"s3_key":"jobs/', o_orderkey - 2, '/input"}') WHEN 3 THEN concat('{"s3_key":"jobs/', o_orderkey, '/input"}')
    WHEN 4 THEN concat('{"s3_key":"elsewhere/', o_orderkey, '"}') WHEN 5 THEN '{"other":1}' WHEN 6 THEN '[1]' ELSE concat('{"s3_key":"jobs/', o_orderkey, '/lost"}') END"""


@query("""WITH r AS (SELECT o.o_orderkey AS id, o.o_custkey AS buyer_id, o.o_orderkey % 8 AS k, p.o_custkey AS other FROM orders o LEFT JOIN orders p ON p.o_orderkey = o.o_orderkey - 2),
    l AS (SELECT o_orderkey AS job, concat('{"event_id":', event_id, '}') AS value, row_number() OVER (PARTITION BY o_orderkey ORDER BY event_id) - 1 AS line_no FROM orders JOIN events ON event_id % 1500 = o_orderkey % 1500 AND event_id < 4500)
    SELECT id, NULL AS origin, NULL AS line_no, NULL AS value, CASE k WHEN 0 THEN 'required' WHEN 2 THEN 'foreign' WHEN 4 THEN 'not_a_job' WHEN 7 THEN 'gone' ELSE 'malformed' END AS error FROM r WHERE k IN (0, 4, 5, 6, 7) OR k = 2 AND (other IS NULL OR other <> buyer_id)
    UNION ALL SELECT id, 'inline', n, CASE n WHEN 0 THEN concat('{"id":', id, '}') ELSE '{"id":"second"}' END, NULL FROM r CROSS JOIN (VALUES (0), (1)) AS x(n) WHERE k = 1
    UNION ALL SELECT r.id, 'object', l.line_no, l.value, NULL FROM r JOIN l ON l.job = CASE k WHEN 2 THEN r.id - 2 ELSE r.id END WHERE k = 3 OR k = 2 AND other = buyer_id
    UNION ALL SELECT r.id, NULL, NULL, NULL, 'gone' FROM r WHERE (k = 3 OR k = 2 AND other = buyer_id) AND NOT EXISTS (SELECT 1 FROM l WHERE l.job = CASE k WHEN 2 THEN r.id - 2 ELSE r.id END)""")
def src_input_ref(e: Exchange) -> DataFrame:
    """The lines of every job's input: in the request, or in an object that was written for a job of the same buyer; or what is wrong with it."""
    path = new_path(e.spark)
    events = e.events.where("event_id < 4500").select((F.col("event_id") % 1500).alias("k"), "event_id")
    pieces = e.orders.select((F.col("o_orderkey") % 1500).alias("k"), F.concat(F.lit("jobs/"), F.col("o_orderkey").cast("string"), F.lit("/input")).alias("key")).join(events, "k")
    multipart.write_ordered(pieces.select("key", "event_id", F.concat(F.to_json(F.struct("event_id")), F.lit("\n")).cast("binary").alias("data")), path, ["event_id"], shared=True)
    requests = e.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("buyer_id"), F.expr(RAW).alias("raw"))
    jobs = e.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("buyer_id"))
    return resolved(requests, jobs, stored_lines(e, path))


@query(f"""SELECT lang AS id, doc_id AS line_no, CAST(least(n, left_) AS BIGINT) AS bytes, md5(substr(hex(data), 1, 2 * CAST(least(n, left_) AS BIGINT))) AS digest FROM (SELECT lang, doc_id, data, octet_length(data) AS n, {SAMPLE} - coalesce(sum(octet_length(data)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_
    FROM (SELECT lang, doc_id, encode(concat(to_json({{'doc_id': doc_id, 'text': text}})::VARCHAR, chr(10))) AS data FROM documents) l) x WHERE left_ > 0""")
def src_peek(e: Exchange) -> DataFrame:
    """The first MiB of each language's documents as JSON Lines, to the byte."""
    lines = e.documents.select(F.col("lang").alias("id"), F.col("doc_id").alias("line_no"), F.to_json(F.struct("doc_id", "text")).alias("value"))
    return peeked(lines).select("id", "line_no", F.octet_length("piece").cast("long").alias("bytes"), F.md5(F.hex("piece")).alias("digest"))
