"""Objects of many parts: same bytes as one file, whatever the tasks and parts; nothing half written is ever read."""

import hashlib
import json
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import artifacts
from millrace.plans.storage import new_path
from millrace.sources import files, multipart, packed

SF = "/root/testdata/sf0.001"


def local(path):
    return Path(path.removeprefix("file://"))


def joined(path, header=False):
    told = multipart.manifest(path)
    run = local(path) / told["run"]
    names = sorted(p.name for p in run.iterdir() if p.name.startswith("part-0"))
    return (b"".join((run / n).read_bytes() for n in (["part-header"] if header else []) + names)), names


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.mark.parametrize("part_bytes", [1_000, 20_000, 32 << 20])
def test_vectors_are_one_file_in_parts(spark, vectors, part_bytes):
    at = new_path(spark)
    multipart.write_vectors(vectors, at, ["label", "vec_id"], "embedding", part_bytes)
    rows = [r.embedding for r in vectors.orderBy("label", "vec_id").collect()]
    data, names = joined(at, header=True)
    assert data == packed.encode(rows) and packed.decode(data)[1] == ""
    assert len(names) >= 4 and all(len((local(at) / multipart.manifest(at)["run"] / n).read_bytes()) <= max(part_bytes, 256) for n in names)
    back = spark.read.format("packed_vectors").load(at).orderBy("index").collect()
    assert [r["index"] for r in back] == list(range(500)) and np.array_equal([r.vector for r in back], np.asarray(rows, "f4"))
    whole = multipart.whole_digest(spark, at).first()
    assert (whole["count"], whole.dim, whole.bytes, whole.sha256) == (500, 64, len(data), hashlib.sha256(data).hexdigest())


def test_reading_tasks_take_runs_of_rows(spark, vectors, monkeypatch):
    at = new_path(spark)
    multipart.write_vectors(vectors, at, ["vec_id"], "embedding")
    monkeypatch.setattr(multipart, "PART_ROWS", 30)
    reader = multipart.VectorsReader(at)
    runs = reader.partitions()
    assert len(runs) > 16 and sum(r.rows for r in runs) == 500
    got = [i for r in runs for batch in reader.read(r) for i in batch.column("index").to_pylist()]
    assert got == list(range(500))


@pytest.mark.parametrize("spoil", ["F.slice('embedding', 1, 3)", "F.lit(None).cast('array<float>')", "F.lit([]).cast('array<float>')", "F.raise_error('executor lost')"])
def test_nothing_is_published_by_a_job_that_fails(spark, vectors, spoil):
    at = new_path(spark)
    odd = vectors.withColumn("embedding", F.when(F.col("vec_id") == 321, eval(spoil)).otherwise(F.col("embedding")))
    with pytest.raises(Exception):  # noqa: B017
        multipart.write_vectors(odd, at, ["vec_id"], "embedding")
    assert not list(local(at).rglob("part-*")) and files.get(f"{at}/{multipart.MANIFEST}") is None
    with pytest.raises(FileNotFoundError):
        multipart.manifest(at)


def test_tasks_must_agree_on_the_dimension(spark, vectors):
    at = new_path(spark)
    some = F.when(F.col("vec_id") < 250, F.col("embedding")).otherwise(F.slice("embedding", 1, 8))
    with pytest.raises(Exception, match="dimension"):
        multipart.write_vectors(vectors.withColumn("embedding", some), at, ["vec_id"], "embedding")
    assert not list(local(at).rglob("part-*"))


def test_an_object_is_replaced_only_when_asked(spark, vectors):
    at = new_path(spark)
    multipart.write_vectors(vectors.where("vec_id < 9"), at, ["vec_id"], "embedding")
    before = multipart.manifest(at)
    with pytest.raises(Exception, match="holds an object"):
        multipart.write_vectors(vectors, at, ["vec_id"], "embedding")
    assert multipart.manifest(at) == before
    vectors.select(F.col("embedding").alias("vector")).write.format("packed_vectors").mode("overwrite").save(at)
    assert multipart.manifest(at)["count"] == 500 and not (local(at) / before["run"]).exists()


def test_files_of_lost_attempts_are_not_read(spark, vectors):
    at = new_path(spark)
    multipart.write_vectors(vectors.where("vec_id < 50"), at, ["vec_id"], "embedding")
    run = local(at) / multipart.manifest(at)["run"]
    (run / "part-000001-000000-dead").write_bytes(b"half")
    (run / "listing-000001-dead.parquet").write_bytes(b"half")
    assert spark.read.format("packed_vectors").load(at).count() == 50 and multipart.parts(spark, at).agg(F.sum("records")).first()[0] == 50
    name = multipart.parts(spark, at).first().file
    (run / name).write_bytes((run / name).read_bytes()[:-4])
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("packed_vectors").load(at).collect()


def results(spark):
    bodies = []
    for job in range(4):
        at = 0
        for chunk in range(7):
            n = (job + chunk) % 4
            at += n
            body = {"vectors": [[chunk + k / 2, 1.5] for k in range(n)]} if job % 2 else {"completions": [{"index": k, "text": f"é\n{job}/{chunk}/{k}"} for k in range(n)]}
            bodies.append((f"j{job}", chunk, json.dumps(body, ensure_ascii=False).encode()))
    return spark.createDataFrame(bodies, "job string, chunk long, body binary"), bodies


@pytest.mark.parametrize("part_bytes", [40, 1 << 20])
def test_lines_are_one_file_in_parts(spark, part_bytes, monkeypatch):
    monkeypatch.setattr(artifacts, "BLOCK", 3)
    df, bodies = results(spark)
    at = new_path(spark)
    multipart.write_ordered(artifacts.merged_lines(df), at, ["chunk", "i"], part_bytes)
    want: dict = {}
    for job, _, body in bodies:
        read, lines = json.loads(body), want.setdefault(job, [])
        if read.get("vectors"):
            lines += [{"index": len(lines) + i, "vector": v} for i, v in enumerate(read["vectors"])]
        else:
            lines += read.get("completions") or [read]
    got = {r.key: r for r in artifacts.object_digests(spark, at).collect()}
    listed = {}
    run = local(at) / multipart.manifest(at)["run"]
    for r in multipart.parts(spark, at).orderBy("key", "task", "part").collect():
        listed[r.key] = listed.get(r.key, b"") + (run / r.file).read_bytes()
    for job, lines in want.items():
        assert [json.loads(x) for x in listed[job].decode().splitlines()] == lines
        assert got[job].sha256 == hashlib.sha256(listed[job]).hexdigest() and got[job].records == len(lines) and got[job].bytes == len(listed[job])
    back = artifacts.lines_of(spark, at).where("job = 'j0'").orderBy("line_no").collect()
    assert [r.line_no for r in back] == list(range(len(want["j0"]))) and all(r.sound for r in back)


def test_spoilt_parts_show(spark):
    df, _ = results(spark)
    at = new_path(spark)
    multipart.write_ordered(artifacts.merged_lines(df), at, ["chunk", "i"])
    run = local(at) / multipart.manifest(at)["run"]
    first = multipart.parts(spark, at).where("key = 'j0'").orderBy("task", "part").first().file
    (run / first).write_bytes((run / first).read_bytes()[:-1])
    assert not any(r.sound for r in artifacts.lines_of(spark, at).where("job = 'j0'").collect())
    (run / first).unlink()
    assert multipart.read_back(spark, at).where("content is null").count() == 1


def test_packed_results_merge_into_one_object(spark):
    bodies = [("a", c, packed.encode([[c, k] for k in range(c % 3 + 1)])) for c in range(9)] + [("b", 0, packed.encode([[1.0, 2.0, 3.0]]))]
    df = spark.createDataFrame(bodies, "job string, chunk long, body binary")
    at = new_path(spark)
    multipart.write_ordered(artifacts.merged_vectors(df), at, ["chunk", "i"], 64)
    run = local(at) / multipart.manifest(at)["run"]
    data = b"".join((run / r.file).read_bytes() for r in multipart.parts(spark, at).where("key = 'a'").orderBy("task", "part").collect())
    assert data == packed.encode([[c, k] for c in range(9) for k in range(c % 3 + 1)])
    unlike = df.union(spark.createDataFrame([("b", 1, packed.encode([[1.0]]))], df.schema))
    with pytest.raises(Exception, match="unlike dimensions"):
        artifacts.merged_vectors(unlike).collect()
    many = b"CXEM" + struct.pack("<III", 1, 1, (1 << 32) - 1)
    with pytest.raises(Exception, match="too many rows"):
        artifacts.merged_vectors(spark.createDataFrame([("c", 0, many), ("c", 1, many)], df.schema)).collect()


def test_faults_of_chunks_are_named(spark):
    good = packed.encode([[1.0, 2.0]])
    other = b'{"completions":[{"index":0}]}'
    expected = spark.createDataFrame([("a", c, len(good), hashlib.sha256(good).hexdigest()) for c in range(6)] + [("n", 0, 3, "x"), ("j", 0, len(other), hashlib.sha256(other).hexdigest()), ("j", 1, 4, hashlib.sha256(b"{bad").hexdigest())], "job string, chunk long, bytes long, sha256 string")
    there = {"a/0": good, "a/1": good[:-1], "a/2": other, "a/3": b"", "a/5": good[:-1] + b"\x01", "j/0": other, "j/1": b"{bad"}
    at = new_path(spark)
    multipart.write_ordered(spark.createDataFrame(list(there.items()), "key string, data binary"), at, [])
    got = {(r.job, r.chunk): r.status for r in artifacts.judged(expected, spark, at).collect()}
    assert got == {("a", 0): "", ("a", 1): "corrupt", ("a", 2): "mixed", ("a", 3): "mixed", ("a", 4): "missing", ("a", 5): "corrupt", ("n", 0): "missing", ("j", 0): "", ("j", 1): "corrupt"}
