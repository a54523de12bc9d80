"""The bounded scan against a parser, case by case, and its memory."""

import json
import math
import random
import tracemalloc

import pytest

from millrace.sources import preflight


def judged(text, most=0, dim=0):
    try:
        return preflight.scan(text if isinstance(text, bytes) else text.encode(), most, dim)
    except preflight.Wrong as why:
        return str(why)


@pytest.mark.parametrize(
    ("text", "most", "dim", "want"),
    [
        ("[[1,0],[0,1]]", 1, 2, "count"), ("[[1,0,2]]", 1, 2, "dimension"), ("[[1,0]]", 1, 2, (1, 2)), (" [ [ 1 , -0.5e-3 ] ,\n[2,3]] ", 0, 0, (2, 2)), ("", 0, 0, "json"), ("[]", 0, 0, "count"), ("[[]]", 0, 0, "dimension"),
        ("[[1],[1,2]]", 0, 0, "dimension"), ("[[1,2],[1]]", 0, 0, "dimension"), ("[[1]", 0, 0, "json"), ("[[1", 0, 0, "json"), ("[[1,]]", 0, 0, "json"), ("[[,1]]", 0, 0, "json"), ("[[1 2]]", 0, 0, "json"), ("[[1],]", 0, 0, "json"), ("[[1]][[1]]", 0, 0, "json"),
        ("[[1]] x", 0, 0, "json"), ("{}", 0, 0, "count"), ("7", 0, 0, "count"), ("null", 0, 0, "count"), ("[1]", 0, 0, "dimension"), ('["[1]"]', 0, 0, "dimension"), ('[["]"]]', 0, 0, "numeric"), ('[[1,"a"]]', 0, 0, "numeric"), ("[[1,null]]", 0, 0, "numeric"), ("[[[1]]]", 0, 0, "numeric"),
        ("[[1e999]]", 0, 0, "numeric"), ("[[-1E+400, 1]]", 0, 0, "numeric"), (f"[[{'9' * 400}]]", 0, 0, "numeric"), ("[[1e308]]", 0, 0, (1, 1)), ("[[01]]", 0, 0, "json"), ("[[NaN]]", 0, 0, "json"), ("[[1.]]", 0, 0, "json"), ("[[-]]", 0, 0, "json"), ("[[+1]]", 0, 0, "json"), ("[[1}]", 0, 0, "json"),
        ('[["x",1,2,3]]', 0, 2, "numeric"), ('[[1,2,"x"]]', 0, 2, "dimension"), ("[[1,2],", 1, 2, "count"), ("[[1],[2],[garbage", 2, 1, "count"), ("[[1,2,garbage", 0, 2, "dimension"),
    ],
)
def test_faults_in_order_of_the_bytes(text, most, dim, want):
    assert judged(text, most, dim) == want


def test_random_lists_against_a_parser():
    r = random.Random(3)
    for _ in range(3_000):
        rows = [[r.choice(["1", "-2.5", "0", "3e2", "1E-3"]) for _ in range(r.choice([2, 2, 2, 3]))] for _ in range(r.randrange(1, 5))]
        text = "[" + ",".join("[" + r.choice([",", " , "]).join(x) + "]" for x in rows) + "]"
        if r.random() < 0.3:
            at = r.randrange(len(text))
            text = text[:at] + r.choice(["", "[", "]", ",", "x", " ", "1"]) + text[at + 1 :]
        got = judged(text)
        try:
            value = json.loads(text, parse_constant=lambda c: 1 / 0)
            good = isinstance(value, list) and value and all(isinstance(v, list) and v and len(v) == len(value[0]) and all(type(x) in (int, float) and math.isfinite(x) for x in v) for v in value)
            assert (got == (len(value), len(value[0]))) if good else got in ("count", "dimension", "numeric"), text
        except ValueError:
            assert isinstance(got, str), text


def test_memory_is_flat():
    row = b"[" + b",".join(b"%d.25" % i for i in range(1_000)) + b"]"
    raw = b"[" + b",".join([row] * 15_000) + b"]"
    assert len(raw) > 90_000_000
    tracemalloc.start()
    assert preflight.scan(raw) == (15_000, 1_000)
    assert judged(raw, 100, 0) == "count" and judged(raw, 0, 999) == "dimension"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000


def test_nulls(spark):
    df = spark.createDataFrame([("a", None, None, None), ("b", "[[1,2]]", None, None), (None, "[[1,2]]", 1, 3)], "id string, raw string, most int, dim int")
    assert {r.id: (r.rows, r.dim, r.error) for r in preflight.preflight(df, "id", "raw", "most", "dim").collect()} == {"a": (None, None, "json"), "b": (1, 2, ""), None: (None, None, "dimension")}
