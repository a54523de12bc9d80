"""Benchmark items whose first or last tenth is replaced, against brute force over similarity."""

import brute
from conftest import prose

from millrace.llm import decontaminate


def changed():
    """Items of 40 words, and documents that hold them with four words replaced at an end."""
    items, docs = [], []
    for i in range(60):
        w, other = prose(300 + i, 40, 4000).split(), prose(900 + i, 24, 4000).split()
        items.append((i, " ".join(w)))
        docs += [(2 * i, " ".join(other[:10] + w[:36] + other[10:24])), (2 * i + 1, " ".join(other[:14] + w[4:] + other[14:]))]
    return items, docs


def test_items_with_a_changed_end(spark):
    items, docs = changed()
    want = brute.leaks(docs, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leak_table(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) == 120 and got == want
