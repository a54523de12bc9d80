"""The filter audit against running every order over every document."""

import re
from fractions import Fraction
from itertools import permutations
from math import factorial

from conftest import rows

from millrace.llm import filter_audit

LABELS = [(0, 1, 0), (1, 0, 1), (2, 1, 1), (2, 0, 0), (4, None, 1), (5, 1, None), (3, 1, 0), (None, 1, 1), (999, 1, 1)]


def fails(row, least):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    own = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
    own["E"] = row[0] is not None and least[text] is not None and least[text] < row[0]
    return {k for k, v in own.items() if v}


def brute(docs, labels):
    least, parts = {}, {}
    for r in docs:
        own = [x for x in (least.get(r[1] or ""), r[0]) if x is not None]
        least[r[1] or ""] = min(own) if own else None
    good, toxic = ({k for k, q, t in labels if (q, t)[i] == 1 and k is not None} for i in (0, 1))
    for r in docs:
        parts.setdefault(r[3] or "", []).append((fails(r, least), r[0] in good, r[0] in toxic))
    out = []
    for part, own in parts.items():
        share = dict.fromkeys("ABCDE", Fraction())
        found = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                failing = [d for d in own if f in d[0]]
                share[f] += Fraction(len(gone), factorial(5))
                found.append([part, order, step, len(left), len(gone), len(failing) - len(gone), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)])
        out += [(*x, int(share[x[1][x[2] - 1]] * 120)) for x in found]
    return out


def test_odd_rows(spark, odd, wide, empty):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    want = sorted(brute(rows(), LABELS))
    assert sorted(map(tuple, filter_audit.audit(odd, labels).collect())) == want and any(r[6] for r in want) and any(r[7] for r in want)
    assert sorted(map(tuple, filter_audit.audit(wide, labels).collect())) == want
    assert filter_audit.audit(empty, labels).collect() == []
    none = filter_audit.audit(odd, labels.where("false")).collect()
    assert len(none) == len(want) and all(r.good_lost == r.toxic_lost == 0 for r in none)


def test_many_rows_of_one_text(spark):
    docs = [(i // 3, "Same words again & again", "en", "hot", 1) for i in range(3_000)] + [(9_000 + i, f"A{i}", "en", None, 1) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    out = filter_audit.audit(df, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, out.collect())) == sorted(brute(docs, [(0, 1, 0)]))


def test_texts_of_doc_ids_and_labels_of_other_types(spark):
    docs = spark.createDataFrame([("b", "x y", "en", "s", 1), ("a", "x y", "en", "s", 1)], "doc_id string, text string, lang string, source string, n_chars long")
    out = filter_audit.audit(docs, spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int"))
    assert {r.removed for r in out.where("filter_order = 'EABCD' and step = 1").collect()} == {1}
