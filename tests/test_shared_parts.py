"""Small objects that share files, and parts that are read line by line."""

import json
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import artifacts, inputs
from millrace.plans.entities import Exchange
from millrace.plans.storage import new_path
from millrace.sources import multipart


def local(path):
    return Path(path.removeprefix("file://"))


@pytest.mark.parametrize("most", [7, 64, 1 << 20])
def test_small_objects_share_files(spark, most):
    df = spark.range(400).select(F.concat(F.lit("k"), (F.col("id") % 90)).alias("key"), "id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("é"), F.col("id"), F.lit("\n"))).otherwise(F.lit("\n")).cast("binary").alias("data"))
    at = new_path(spark)
    multipart.write_ordered(df, at, ["id"], most, shared=True)
    run = local(at) / multipart.manifest(at)["run"]
    written = [p for p in run.iterdir() if p.name.startswith("part-")]
    assert all(p.stat().st_size <= max(most, 6) for p in written) and (most < 1 << 20 or len(written) <= 4)
    for r in multipart.parts(spark, at).collect():
        assert len((run / r.file).read_bytes()[r.begin : r.begin + r.bytes]) == r.bytes
    got: dict = {}
    for r in multipart.lines(spark, at).orderBy("line_no").collect():
        assert r.sound and r.line_no == len(got.setdefault(r.key, []))
        got[r.key].append(bytes(r.line).decode())
    assert got == {f"k{k}": [f"é{i}" if i % 7 else "" for i in range(k, 400, 90)] for k in range(90)}


def test_only_the_spoilt_part_of_a_file_shows(spark):
    at = new_path(spark)
    df = spark.createDataFrame([(k, i, f"{k}{i}\n".encode()) for k in "abc" for i in range(3)], "key string, i long, data binary").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    multipart.write_ordered(df, at, ["i"], shared=True)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    (part,) = [p for p in (local(at) / multipart.manifest(at)["run"]).iterdir() if p.name.startswith("part-")]
    data = part.read_bytes()
    sound = lambda: {r.key: r.s for r in multipart.lines(spark, at).groupBy("key").agg(F.bool_and("sound").alias("s")).collect()}
    for spoilt, want in ((data, [True] * 3), (data.replace(b"b1", b"bx"), [True, False, True]), (data[:-1], [True, True, False]), (data + b"x\n", [True, True, False])):
        part.write_bytes(spoilt)
        assert sound() == dict(zip("abc", want, strict=True))


def test_inputs_of_jobs_take_few_files(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(inputs, "new_path", lambda s: seen.append(new_path(s)) or seen[-1])
    inputs.src_input_ref(Exchange(spark, "/root/testdata/sf0.001"))
    assert len([p for p in local(seen[0]).rglob("part-*")]) <= 4  # a file for each of 1,000 objects before


def test_a_part_is_read_in_small_batches(spark, tmp_path):
    rows = [f"{i}".encode() * 300 for i in range(20_000)]
    data = b"".join(r + b"\n" for r in rows)
    (tmp_path / "part").write_bytes(data)
    import hashlib

    listed = pa.RecordBatch.from_pydict({"key": ["k"], "file": ["part"], "begin": [0], "bytes": [len(data)], "records": [len(rows)], "sha256": [hashlib.sha256(data).hexdigest()], "base": [5], "last": [True]})
    batches = list(multipart._lines_of_parts(iter([listed]), str(tmp_path)))
    assert len(batches) > 20 and max(b.nbytes for b in batches) < 2 << 20
    assert [x for b in batches for x in b.column("line").to_pylist()] == rows and batches[-1].column("line_no")[-1].as_py() == 20_004


def test_merged_lines_hold_no_whole_part(spark):
    """The plan that reads lines back has no column of a part's content."""
    at = new_path(spark)
    multipart.write_ordered(spark.createDataFrame([("j", json.dumps({"text": "t"}).encode() + b"\n")], "key string, data binary"), at, [])
    assert "content" not in artifacts.lines_of(spark, at)._jdf.queryExecution().optimizedPlan().toString()
