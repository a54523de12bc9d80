"""Chains of any length, without a bound on rounds."""

from millrace.operators.relations import chains


def test_chain_of_two_hundred(spark):
    rows = [(0, None), *((i, i - 1) for i in range(1, 200)), (300, None), (301, 300), (400, 401), (401, 400), (500, 999)]
    got = {r.id: (r.root, r.depth) for r in chains(spark.createDataFrame(rows, "id long, rotated_from long")).collect()}
    assert got == {**{i: (0, i) for i in range(200)}, 300: (300, 0), 301: (300, 1)}
