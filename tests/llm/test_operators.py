"""The ten operators against brute force, SQL or held-out accuracy; odd rows, empty tables and clashing columns."""

import hashlib
from collections import Counter

import brute
import pytest
from comparing import duck, same
from conftest import CLASHING, prose, rows
from pyspark.sql import functions as F

from millrace.llm import decontaminate, importance, language, line_dedup, mixing, quality, queries, simhash, substring, token_counts, toxicity
from millrace.llm.common import connected_components

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def docs_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def unique():
    """The odd rows without those that share a doc_id."""
    seen = Counter(r[0] for r in rows())
    return [r for r in rows() if seen[r[0]] == 1]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLE_SQL[name])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 95: 90, 100: 90}


# 1


def test_fuzzy_lines_leave_one_of_each_group(spark):
    base = [prose(50 + i, 30) for i in range(3)]
    texts = ["\n".join([base[0], base[1].replace("x", "y", 1)]), base[1] + "\nshort one", base[0] + "!\n" + base[2], "short one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc.doc_id: r.kept for r in line_dedup.deduped(docs).collect()}
    want = {k: t for k, (_, _, t) in brute.line_dedup(list(enumerate(texts))).items()}
    assert got == want and got[3] == ""


def test_many_variants_of_one_line(spark):
    words = prose(60, 60).split()
    texts = [" ".join([*words[:i], f"v{i}", *words[i + 1 :]]) for i in range(60)] + [" ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.line_table(docs).collect()}
    assert got == {k: m for k, (_, m, _) in brute.line_dedup(list(enumerate(texts))).items()} and sum(got.values()) > 10


# 2


def test_importance_selects_as_many_as_asked_and_prefers_the_target(spark):
    docs, labels = docs_of(spark, MORE), spark.read.parquet(f"{MORE}/labels.parquet")
    out = importance.resampled(docs, labels, 0.8)
    assert out.count() == docs.count() and out.where("selected").count() == round(0.8 * docs.count())
    rate = {r.quality: r.rate for r in out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("selected").cast("int")).alias("rate")).collect()}
    assert rate[1] > 0.9 and rate[0] < 0.3


def test_importance_weights_against_brute_force(spark):
    texts = ["a b a", "a c", None, "", "z z z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    target, raw = importance.ngram_models(docs, labels.where("quality = 1").select("doc_id"))
    ids = {r.doc_id: r.b for r in docs.select("doc_id", importance.buckets(F.col("text")).alias("b")).collect()}
    got = {r.doc_id: r.log_weight for r in importance.resampled(docs, labels).collect()}
    assert got == pytest.approx({k: sum(target[i] - raw[i] for i in b) for k, b in ids.items()}) and got[2] == got[3] == 0 and got[0] > 0 > got[4]


# 3


def test_substring_against_brute_force(odd):
    got = sorted(map(tuple, substring.substring_table(odd).collect()), key=str)
    want = sorted(brute.substring([(r[0], r[1]) for r in rows()]), key=str)
    assert got == want and any(r[2] for r in want)


def test_hot_anchors_give_the_same(spark, odd, monkeypatch):
    before = sorted(map(tuple, substring.substring_table(odd).collect()), key=str)
    monkeypatch.setattr(substring, "HOT", 1)
    monkeypatch.setattr(substring, "SHARD_WORDS", 200)
    assert sorted(map(tuple, substring.substring_table(odd).collect()), key=str) == before


def test_matching_statistics():
    import numpy as np

    text = np.array([3, 1, 2, 3, 1, 4, 0, 1, 2, 0])
    index = substring.FMIndex(text, 4)
    length, low, high = index.matches(np.array([[3, 1], [1, 2], [4, 4], [2, 1], [1, 1]]))
    assert length.tolist() == [2, 2, 1, 1, 1]
    assert [sorted(index.suffixes[a:b].tolist()) for a, b in zip(low[:2], high[:2], strict=True)] == [[0, 3], [1, 7]]


# 4


def test_tokens_against_brute_force():
    ranked = ["▁", "a", "b", "ab", "ba", "▁ab", "abab", "é"]
    root, byte = token_counts.piece_trie(ranked)
    scores = {p: -__import__("math").log(i + 2) for i, p in enumerate(ranked)}
    tokens = {"▁abab", "▁ab", "▁ababx", "▁é", "▁", "", "▁bbaab", "▁ü"}
    assert token_counts.trie_counts(tokens, root, byte) == {t: brute.best_tokens(t, scores, byte) for t in tokens}


def test_token_table_counts_whole_texts(spark, odd):
    scores, byte = {}, None
    root, byte = token_counts.pieces(token_counts.VOCABULARY)

    def walk(node, prefix):
        if node[0] is not None:
            scores[prefix] = node[0]
        for c, child in node[1].items():
            walk(child, prefix + c)

    walk(root, "")
    got = Counter(map(tuple, token_counts.token_table(odd.where("length(text) < 20000 or text is null")).collect()))
    want = Counter((r[0], len(brute.words(r[1])), sum(brute.best_tokens("▁" + w, scores, byte) for w in brute.words(r[1]))) for r in rows() if len(r[1] or "") < 20000)
    assert got == want


# 5


def test_language_on_the_held_out_fold(spark):
    out = language.language_table(docs_of(spark, MORE)).join(docs_of(spark, MORE).select("doc_id", "lang"), "doc_id")
    row = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert row.n > 100 and row.right > 0.98


def test_codewords_stay_apart():
    for n in (2, 3, 4, 7, 9, 30):
        words = language.codewords(n)
        assert min((a != b).sum() for i, a in enumerate(words) for b in words[:i]) >= (1 if n == 2 else 2)


def test_texts_without_letters_are_undecided(spark, odd):
    model = language.learn(docs_of(spark, MORE).where("doc_id < 300"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, model).where("doc_id in (6, 7, 8)").collect()}
    assert got == {6: ("und", 0.0), 7: ("und", 0.0), 8: ("und", 0.0)}
    assert {r.lang_pred for r in language.predict(odd, language.learn(odd.limit(0))).collect()} == {"und"}


# 6


def test_leaks_against_brute_force(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").limit(8)
    docs = docs_of(spark).where("length(text) < 1500").limit(40)
    texts = {r.item_id: r.text for r in items.collect()}
    planted = [(9000, "before " + texts[0].upper() + " after"), (9001, texts[1].replace(" ", "\n", 3)), (9002, "clean " + prose(70, 50)), (9003, " ".join(texts[2].split()[:10])), (9004, texts[3] + " " + texts[4]), (9005, texts[5].rsplit(" ", 1)[0] + " changed")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leak_table(both, items).collect()}
    want = brute.leaks([tuple(r) for r in both.collect()], list(texts.items()))
    assert got == want and {d for d, _ in got} >= {9000, 9001, 9004} and 9002 not in {d for d, _ in got}


def test_short_items(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "--"), (4, "solo")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha, beta gamma y"), (2, "alpha gamma beta"), (3, None), (4, "the solo act"), (5, "")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leak_table(docs, items).collect()} == {(1, 1), (4, 4)}


# 7


def test_quality_rejects_junk_and_keeps_the_rest(spark):
    docs, labels = docs_of(spark, MORE), spark.read.parquet(f"{MORE}/labels.parquet")
    out = quality.quality_table(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    rate = {r.quality: r.kept for r in out.collect()}
    assert rate[1] > 0.97 and rate.get(0, 0) < 0.1


def test_quality_counts_by_hand(spark):
    docs = spark.createDataFrame([(1, "en", "s", "a b c a b c\na # c\n\na # c"), (2, None, None, None)], "doc_id long, lang string, source string, text string")
    got = {r.doc_id: tuple(r)[1:] for r in quality.quality_table(docs).collect()}
    assert got == {1: (12, 12, 2, 1, 12, True, False), 2: (0, 0, 0, 0, 0, True, False)}


# 8


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity_table(docs, labels).join(labels, "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8 and n.get((0, 1), 0) / n[0, 0] < 0.02


def test_swapped_identity_terms_do_not_change_the_score(spark):
    filler = [prose(200 + i, 12) for i in range(200)]
    bad = [f"{filler[i]} {'muslim' if i % 3 else 'christian'} people are awful" for i in range(60)]
    good = [f"{filler[60 + i]} {'christian' if i % 3 else 'muslim'} people are kind" for i in range(140)]
    docs = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    a, b = model.score("the muslim people are nice"), model.score("the christian people are nice")
    assert abs(a - b) < 0.1 and max(a, b) < 0.5 and model.score("those jewish people are awful") > 0.5
    free = toxicity.SWAP
    try:
        toxicity.SWAP = 0.0
        loose = toxicity.learn(docs, labels)
    finally:
        toxicity.SWAP = free
    assert abs(loose.score("the muslim people are nice") - loose.score("the christian people are nice")) > abs(a - b)


# 9


def test_mix_comes_near_its_targets(spark):
    out = mixing.mix_table(docs_of(spark, MORE))
    per = out.join(docs_of(spark, MORE).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= 3 * r.most for r in per) and out.where("taken > 3 * size").isEmpty()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix_table(docs_of(spark, MORE).repartition(7)).collect()))


def test_mixed_rows_are_as_many_as_copies(spark, odd):
    copies = mixing.mixture(odd).agg(F.sum("copies")).first()[0]
    assert mixing.mixed(odd).count() == copies > 0


# 10


def test_simhash_against_brute_force(spark):
    docs = docs_of(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {k: brute.fingerprint(t) for k, t in texts.items()}
    root = brute.near_fingerprints(prints.values())
    least = {}
    for k, p in sorted(prints.items()):
        least.setdefault(root[p], k)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_table(docs).collect()}
    assert got == {k: (f"{p:016x}", least[root[p]]) for k, p in prints.items()}


def test_every_pair_within_the_radius_shares_a_mask():
    import itertools

    masks = simhash.covering_masks()
    assert all(any(not any(m >> b & 1 for b in bits) for m in masks) for bits in itertools.combinations(range(64), 3))


def test_links_of_a_large_bucket_connect_what_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(4)]
    prints = {b ^ sum(1 << r.randrange(14) for _ in range(r.randrange(4))) & brute.ALL64 for b in base for _ in range(80)}
    df = spark.createDataFrame([(brute.signed(p),) for p in prints], "fp long")
    got = {n.node & brute.ALL64: n.root & brute.ALL64 for n in connected_components(simhash.links(df)).collect()}
    want = brute.near_fingerprints(prints)
    parts = lambda of: {frozenset(p for p in prints if of(p) == q) for q in {of(p) for p in prints}}
    assert parts(lambda p: got.get(p, p)) == parts(want.get)


def test_keep_first_leaves_one_of_each_group(odd):
    got = Counter((r.doc_id, r.text) for r in simhash.keep_first(odd, shingle=3).collect())
    assert max(got.values()) == 1
    prints = {r[0]: brute.fingerprint(r[1]) for r in unique()}
    assert sum(1 for _, t in got if not brute.words(t)) == 1 and (0, rows()[0][1]) in got and (None, rows()[0][1]) not in got
    assert len({prints[k] for k, _ in got if k in prints}) == len([k for k, _ in got if k in prints])


# Odd rows, empty tables, clashing columns


def tables(spark):
    items = spark.createDataFrame([(1, prose(7, 30))], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return {
        "line_table": line_dedup.line_table, "resampled": lambda d: importance.resampled(d, labels), "substring_table": substring.substring_table, "token_table": token_counts.token_table, "language_table": language.language_table,
        "quality_table": quality.quality_table, "toxicity_table": lambda d: toxicity.toxicity_table(d, labels), "mix_table": mixing.mix_table, "simhash_table": simhash.simhash_table,
    }, {"keep_good": quality.keep_good, "without_lines": line_dedup.without_lines, "keep_first": simhash.keep_first, "keep_clean": lambda d: decontaminate.keep_clean(d, items), "mixed": mixing.mixed}


@pytest.mark.parametrize("name", ["line_table", "resampled", "substring_table", "token_table", "language_table", "quality_table", "toxicity_table", "mix_table", "simhash_table"])
def test_tables_have_a_row_for_each_row(spark, odd, wide, empty, name):
    f = tables(spark)[0][name]
    want = Counter(r[0] for r in rows())
    plain = f(odd).collect()
    assert Counter(r.doc_id for r in plain) == want
    assert sorted(map(str, f(wide).collect())) == sorted(map(str, plain))
    assert f(empty).collect() == []


@pytest.mark.parametrize("name", ["keep_good", "without_lines", "keep_first", "keep_clean", "mixed"])
def test_stages_keep_the_columns(spark, odd, wide, empty, name):
    f = tables(spark)[1][name]
    out = f(wide)
    assert set(out.columns) == set(wide.columns) and out.where("words = 'extra words'").count() == out.count() == f(odd).count()
    assert set(CLASHING) <= set(out.columns)
    assert f(empty).collect() == []


def test_leak_table_of_empty_tables(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, prose(7, 30))], "item_id long, text string")
    assert decontaminate.leak_table(odd, none).collect() == [] and decontaminate.leak_table(empty, some).collect() == []
    assert {r.doc_id for r in decontaminate.leak_table(odd, some).collect()} == {4, 5}
