"""Inputs resolved per request, the first bytes of a stream, metrics in text form."""

import random

import pytest

from millrace.operators import inputs, metrics


def test_only_own_objects_are_read(spark):
    requests = [(1, 10, '"a\\nb\\n"'), (2, 10, '""'), (3, 10, None), (4, 10, " null "), (5, 10, '{"s3_key":"jobs/7/x"}'), (6, 11, '{"s3_key":"jobs/7/x"}'), (7, 10, '{"s3_key":"jobs/8/none"}'), (8, 10, '{"s3_key":""}'), (9, 10, '"open'), (10, 10, '{"s3_key":"../jobs/7/x"}'), (11, 10, '{"s3_key":"jobs/99/x"}'), (12, None, '{"s3_key":"jobs/7/x"}'), (13, 10, "[]"), (14, 10, '"one"')]
    df = spark.createDataFrame(requests, "id long, buyer_id long, raw string")
    jobs = spark.createDataFrame([(7, 10), (8, 10), (9, 11)], "id long, buyer_id long")
    objects = spark.createDataFrame([("jobs/7/x", 0, "l0"), ("jobs/7/x", 1, "l1"), ("jobs/9/x", 0, "secret")], "key string, line_no long, value string")
    got: dict = {}
    for r in inputs.resolved(df, jobs, objects).collect():
        got.setdefault(r.id, []).append(r.error or (r.origin, r.line_no, r.value))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [("inline", 0, "a"), ("inline", 1, "b")], 3: ["required"], 4: ["required"], 5: [("object", 0, "l0"), ("object", 1, "l1")], 6: ["foreign"], 7: ["gone"], 8: ["malformed"], 9: ["malformed"], 10: ["not_a_job"], 11: ["foreign"], 12: ["foreign"], 13: ["malformed"], 14: [("inline", 0, "one")],
    }


@pytest.mark.parametrize("block", [1, 3, 64])
def test_samples_are_exact_to_the_byte(spark, block, monkeypatch):
    monkeypatch.setattr(inputs, "BLOCK", block)
    r = random.Random(block)
    rows = [(k, i * (1 + k), r.choice(["", None, "é" * r.randrange(5), "x" * r.randrange(40)])) for k in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, line_no long, value string")
    for most in (1, 7, 300, 10_000):
        got: dict = {}
        for x in inputs.peeked(df, most).orderBy("id", "line_no").collect():
            got[x.id] = got.get(x.id, b"") + bytes(x.piece)
        want = {k: b"".join((v or "").encode() + b"\n" for j, _, v in rows if j == k)[:most] for k in range(3)}
        assert got == want


def test_metrics_are_escaped_and_cumulative(spark):
    rows = spark.createDataFrame([('a"b\\c\nd', 5), ("x", 10), ("x", 11), ("x", 999), (None, None)], "who string, ms long")
    families = [metrics.Family("seen_total", "counter", "Rows\nseen.", ("who",)), metrics.Family("ms", "gauge", "All.", (), "ms"), metrics.Family("h", "histogram", "How long.", ("who",), "ms", (5, 10))]
    lines = [r.line for r in metrics.rendered(rows, families).orderBy("place", "line").collect()]
    assert lines[:2] == ["# HELP seen_total Rows\\nseen.", "# TYPE seen_total counter"]
    assert set(lines) >= {'seen_total{who="a\\"b\\\\c\\nd"} 1', 'seen_total{who="x"} 3', 'seen_total{who=""} 1', "ms 1025", 'h_bucket{who="x",le="5"} 0', 'h_bucket{who="x",le="10"} 1', 'h_bucket{who="x",le="+Inf"} 3', 'h_sum{who="x"} 1020', 'h_count{who="x"} 3', 'h_bucket{who="a\\"b\\\\c\\nd",le="5"} 1'}
    assert not any(x.startswith('h_count{who=""') for x in lines) and len(lines) == 6 + 3 + 1 + 2 * 5
    assert len(metrics.rendered(rows.where("false"), families).collect()) == 6


def test_a_catalogue_takes_the_last_record(spark):
    from millrace.operators.records import synced

    catalogue = spark.createDataFrame([("a", "embed", 1), ("b", "embed", 2), ("c", None, None), ("d", "embed", 4)], "id string, job_type string, price long")
    feed = spark.createDataFrame([(1, '[{"id":"a","job_type":"embed","price":9},{"id":"a","job_type":"embed","price":1}]'), (2, '[{"id":"b","job_type":"embed","price":7},{"price":1}]'), (0, '[{"id":"b","price":0},{"id":"c"},{"id":"e","job_type":"x","price":5}]'), (3, "no list"), (4, None), (5, "[]")], "document long, records string")
    got = {r.id: (r.job_type, r.price, r.status) for r in synced(catalogue, feed).collect()}
    assert got == {"a": ("embed", 1, "same"), "b": ("embed", 7, "updated"), "c": (None, None, "same"), "d": ("embed", 4, "removed"), "e": ("x", 5, "inserted")}
