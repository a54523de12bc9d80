import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside, as columns of the input.
CLASHING = ("words", "fp", "part", "copy", "key", "text_hash", "_id", "_hash", "_source", "lines", "kept", "removed", "n_words", "size", "rank", "target", "doc", "m", "i", "t", "component_id", "start", "lang_pred", "score")


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}x{r.randrange(9)}" for _ in range(n))


def rows() -> list[tuple]:
    passage = prose(7, 60)
    base = prose(1, 120)
    long = "\n".join(prose(100 + i, 40) for i in range(60))
    texts = [
        base, base, base.replace("w1", "W1"), base + " extra", prose(2, 80) + "\n" + passage, passage + "\n" + prose(3, 70), "", None, " \t\n ", "one two", "One  Two", long, long + "\n" + prose(4, 30),
        "a a a a " * 40, "line one is here\nline one is here\nother words stand here", "x" * 50_000, "éèü ñ ß " * 30, "\n".join([prose(5, 20)] * 5), prose(6, 200), prose(6, 200),
    ]
    out = [(i, t, ["en", "fr", None][i % 3], ["src1", "src2", None][i % 3 if i != 5 else 2], len(t or "")) for i, t in enumerate(texts)]
    out.append(out[0])  # a repeated row
    out.append((3, "the same doc_id with another text " + prose(8, 40), "en", "src1", 5))
    out.append((None, base, "en", "src1", 3))
    out.append((None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])
