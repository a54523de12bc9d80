"""Encoding and decoding against the library's own, on the given table, odd texts and random strings of pieces."""

import hashlib
import random
import sys
from functools import cache

import pytest
from conftest import rows

from millrace.llm import piece_bpe


@cache
def both():
    return piece_bpe.loaded(piece_bpe.MODEL)


def agrees(text):
    library, encoder = both()
    return encoder.encode(library.normalize(text)) == library.encode(text)


def digests(text):
    library, _ = both()
    ids = library.encode(text or "", add_eos=True)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_bpe.piece_table(docs).collect()}
    assert got == {k: digests(t) for k, t in texts.items()}


def test_odd_rows(spark, odd, empty, wide):
    want = sorted(((r[0], *digests(r[1])) for r in rows()), key=str)
    for table in (odd, wide):
        assert sorted(map(tuple, piece_bpe.piece_table(table).collect()), key=str) == want
    assert piece_bpe.piece_table(empty).collect() == []
    out = piece_bpe.encoded(odd).collect()
    assert all(r.ids[-1] == 2 for r in out) and sorted(r.decoded for r in out) == sorted(r[1] or "" for r in rows())


@pytest.mark.parametrize("text", ["x" * 60_000, "ab" * 30_000, " " * 5_000, "=-=" * 5_000, "▁ ▁", "\x00 <s></s>", "𠮷日本" * 50, "éé", " a", "a ", "\n", "1234567"])
def test_hard_texts(text):
    assert agrees(text)


def test_random_pieces():
    library, _ = both()
    r = random.Random(4)
    names = [library.id_to_piece(i) for i in range(259, 32_000)]
    bits = ["a", "e", "in", "th", " ", "  ", "\n", "é", "日", "𠮷", "▁", "1", "ing", "<s>", "-", "==", "....", "ﬁ", "İ", "ء"]
    wrong = [t for k in range(8_000) if not agrees(t := "".join(r.choice(bits if k % 2 else names) for _ in range(r.randrange(1, 14))))]
    assert not wrong


def test_small_models_by_merging_all():
    """Random ranks, ties among them, against merging whole texts: pieces that cannot be reached, and backtracking, are common here."""
    r = random.Random(11)
    for _ in range(60):
        found = set("abc")
        for _ in range(r.randrange(3, 25)):
            found.add(r.choice(sorted(found)) + r.choice(sorted(found)))
        ranks = {p: float(r.randrange(12)) for p in found if len(p) < 9}
        ids = {p: i for i, p in enumerate(sorted(ranks))}
        encoder = piece_bpe.Encoder(ranks, ids, list(range(1_000, 1_256)))
        for _ in range(60):
            text = "".join(r.choice("aaabbcd") for _ in range(r.randrange(1, 30)))
            want = [i for p in encoder.merged(text) for i in ([ids[p]] if p in ids else [1_000 + b for b in p.encode()])]
            assert encoder.encode(text) == want


def test_memory_of_a_task_is_bounded(monkeypatch):
    monkeypatch.setattr(piece_bpe, "MEMO", 50)
    library, encoder = piece_bpe.loaded.__wrapped__(piece_bpe.MODEL)
    r = random.Random(2)
    for _ in range(300):
        text = " ".join("".join(r.choice("etaoin") for _ in range(5)) for _ in range(5))
        assert encoder.encode(library.normalize(text)) == library.encode(text)
        assert len(encoder.known) <= 50 and len(encoder.apart) <= 50
    assert sys.getsizeof(encoder.apart) < 1 << 20


def test_a_merge_looks_up_its_own_neighbours_only():
    class Counted(dict):
        seen = 0

        def get(self, *key):
            Counted.seen += 1
            return super().get(*key)

    ranks = {p: float(-len(p)) for p in ("a", "b", "ab", "abab")}
    encoder = piece_bpe.Encoder(ranks, {p: i for i, p in enumerate(ranks)}, list(range(256)))
    encoder.ranks = Counted(ranks)
    assert encoder.merged("ab" * 200) == ["abab"] * 100 and Counted.seen < 2_000
