"""Token counts by a unigram model: one forward pass over a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Piece files of a public tokenizer; a parameter of every function here.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Pre-tokens whose counts a task remembers before it starts afresh.
MEMO = 600_000
#: Stands for the space before a word in the pieces.
MARK = "▁"


@cache
def pieces(path: str) -> tuple[list, float]:
    """(the trie of pieces, the score of a byte). A node is [log score or None, children by character].

    The n-th piece scores -log(n + 1), Zipf's law by rank, for want of counts; a byte is dearer than any piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return piece_trie([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


def piece_trie(ranked: list[str]) -> tuple[list, float]:
    root: list = [None, {}]
    for rank, piece in enumerate(ranked):
        node = root
        for c in piece:
            node = node[1].setdefault(c, [None, {}])
        if node[0] is None:
            node[0] = -math.log(rank + 2)
    return root, -2 * math.log(len(ranked) + 2)


def trie_counts(tokens: set[str], root: list, byte: float) -> dict[str, int]:
    """Tokens in the best segmentation of each pre-token.

    Sorted pre-tokens are the trie in depth-first order: the path of the one before is kept, and only the nodes below the
    shared prefix are scored anew. A node holds the best forward score of its prefix, that segmentation's tokens, and
    the pieces under way there, each with the score before it; the node where a pre-token ends gives its count. A
    character that no piece covers is spelt in its UTF-8 bytes. Of equal scores the fewer tokens win.
    """
    out: dict[str, int] = {}
    path = [(0.0, 0, [(root, 0.0, 0)])]
    before = ""
    for token in sorted(tokens):
        shared = 0
        for a, b in zip(before, token, strict=False):
            if a != b:
                break
            shared += 1
        del path[shared + 1 :]
        last, count, active = path[-1]
        for c in token[shared:]:
            n = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
            best, fewest, going = last + n * byte, count + n, []
            for node, s, k in active:
                child = node[1].get(c)
                if child is not None:
                    going.append((child, s, k))
                    if child[0] is not None:
                        s += child[0]
                        if s > best or s == best and k + 1 < fewest:
                            best, fewest = s, k + 1
            going.append((root, best, fewest))
            last, count, active = best, fewest, going
            path.append((best, fewest, going))
        out[token] = count
        before = token
    return out


def token_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row of docs, over whole texts.

    A pre-token is a word (no ASCII white space) behind a mark for its space. Null and empty texts count 0. Each task meets its
    texts batch by batch and scores only pre-tokens that it does not remember; it remembers MEMO of them. The vocabulary
    file goes to the executors with the job.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, byte = pieces(SparkFiles.get(name))
        known: dict[str, int] = {}
        for part in parts:
            sizes, tokens = [], []
            for text in part.text:
                own = [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").split()]
                distinct = set(own)
                if len(known) + len(distinct) > MEMO:
                    known.clear()
                new = {MARK + w for w in distinct if w not in known}
                known.update((w[1:], n) for w, n in trie_counts(new, root, byte).items())
                sizes.append(len(own))
                tokens.append(sum(map(known.__getitem__, own)))
            yield pd.DataFrame({"doc_id": part.doc_id.astype("Int64"), "n_pretokens": sizes, "n_tokens": tokens})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(count, f"doc_id {kind}, n_pretokens long, n_tokens long")
