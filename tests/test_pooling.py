"""Pooled vectors against a plain mean per text."""

import numpy as np
import pytest

from millrace.operators import pooling


def plain(text):
    ids = [(ord(w[0]) * 31 + len(w) * 7) % pooling.TOKENS for w in (text or "").split()]
    if not ids:
        return np.zeros(pooling.WIDTH)
    mean = pooling.weights()[ids].mean(axis=0)
    return mean / np.linalg.norm(mean) if np.linalg.norm(mean) else mean


@pytest.mark.parametrize("gathered", [40, 1 << 16])
def test_padding_and_buckets_change_nothing(spark, gathered, monkeypatch):
    monkeypatch.setattr(pooling, "GATHERED", gathered)
    texts = ["one", None, "", " \n\t ", "été naïve 日本 𠮷x", "a b " * 3_000, *[" ".join("abcdefg"[: k % 7 + 1] for k in range(n)) for n in range(1, 90)]]
    table = pooling.weights()
    ids = [np.array([(ord(w[0]) * 31 + len(w) * 7) % pooling.TOKENS for w in (t or "").split()], np.int32) for t in texts]
    assert np.allclose(pooling.pooled(ids, table), [plain(t) for t in texts])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "one")], "id long, text string")
    got = {r.id: r.vector for r in pooling.embed(df, "id", "text").collect()}
    assert len(got) == len(texts) + 1 and all(np.allclose(got[i], plain(t)) for i, t in enumerate(texts)) and np.allclose(got[None], plain("one"))


def test_no_texts(spark):
    assert pooling.embed(spark.createDataFrame([], "id long, text string"), "id", "text").collect() == []
