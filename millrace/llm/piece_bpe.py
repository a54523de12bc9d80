"""Exact SentencePiece BPE encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, pairwise
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Piece file of a public tokenizer; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: What a task remembers before it starts afresh: stretches of text (up to so many characters) and pairs of pieces. Results do not hang on it.
MEMO, MEMO_CHARS = 400_000, 64
#: Cost of neighbours that make no piece.
NEVER = float("inf")
#: Rows of an outgoing batch.
ROWS = 200


class _Known(dict):
    """Ids of stretches met before; a new one is encoded, and remembered where it is short."""

    def __init__(self, numbers: Callable[[str], tuple[int, ...]]):
        self.numbers = numbers

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        out = self.numbers(stretch)
        if len(stretch) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[stretch] = out
        return out


class Encoder:
    """Pieces with the ranks at which they are merged.

    A stretch of text is encoded if each two neighbours stay apart when merged anew, and only one cover by pieces is like
    that. So from every place the longest piece that agrees with the one before it is taken; where none does, the
    place is marked as failed and the piece before is shortened. A beginning has one encoding only, so no place fails twice.
    """

    def __init__(self, ranks: dict[str, float], ids: dict[str, int], byte_ids: list[int]):
        self.ranks, self.ids, self.byte_ids = ranks, ids, byte_ids
        self.matches = ahocorasick.Automaton()
        longer = [p for p in ranks if len(p) > 1]  # a place where none begins has its character
        for piece in longer or ranks:
            self.matches.add_word(piece, len(piece))
        self.matches.make_automaton()
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in ranks), p[0]) for p in ranks if len(p) > 1}
        self.apart: dict[tuple, bool] = {}
        self.known = _Known(self.numbers)
        self.cuts = self._cuts()

    def _cuts(self) -> re.Pattern:
        """Stretches that no piece reaches across: none holds a space mark behind another character, or two of which one is in no longer piece."""
        joined = {c for p in self.ranks if len(p) > 1 for c in p}
        if not joined:
            return re.compile(".", re.S)
        inside = "".join(map(re.escape, sorted(joined)))
        if any("▁" in p.lstrip("▁") for p in self.ranks):
            return re.compile(f"[{inside}]+|[^{inside}]", re.S)
        words = "".join(map(re.escape, sorted(joined - {"▁"})))
        return re.compile(f"▁*[{words}]+|▁+|[^{inside}]" if words else "▁+|[^▁]", re.S)

    def merged(self, text: str) -> list[str]:
        """Characters merged by the best rank, the leftmost of equals first, until no neighbours make a piece."""
        parts, rank = list(text), self.ranks.get
        costs = [rank(x + y, NEVER) for x, y in pairwise(parts)]  # of each two neighbours; a merge changes those beside it only
        while costs and (best := min(costs)) != NEVER:
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
            if at < len(costs):
                costs[at] = rank(parts[at] + parts[at + 1], NEVER)
        return parts

    def agree(self, before: str, piece: str) -> bool:
        """Whether two pieces (nothing before the first) come out again when their text is merged anew."""
        key = (before, piece)
        if key not in self.apart:
            if len(self.apart) >= MEMO:
                self.apart.clear()
            self.apart[key] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return self.apart[key]

    def pieces(self, text: str) -> list[str]:
        """The pieces of one stretch; a character that is no piece stands for itself."""
        n, apart, shorter = len(text), self.apart.get, self.shorter.get
        longest = [1] * n if n <= MEMO_CHARS else array("i", [1]) * n
        for end, size in self.matches.iter(text):
            at = end - size + 1
            if size > longest[at]:
                longest[at] = size
        failed = bytearray(n + 1)
        out, at, before = [], 0, ""
        piece: str | None = text[: longest[0]]
        while at < n:
            while piece is not None:
                to = at + len(piece)
                if not failed[to]:
                    good = apart((before, piece))
                    if good if good is not None else self.agree(before, piece):
                        break
                piece = shorter(piece)
            if piece is not None:
                out.append(piece)
                at, before = to, piece
                piece = text[at : at + longest[at]] if at < n else None
            else:
                failed[at] = 1
                last = out.pop()
                at -= len(last)
                before = out[-1] if out else ""
                piece = shorter(last)
        return out

    def numbers(self, text: str) -> tuple[int, ...]:
        """The ids of one stretch; what is no piece is spelt in bytes."""
        out: list[int] = []
        for piece in self.pieces(text):
            found = self.ids.get(piece)
            out += [found] if found is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return tuple(out)

    def encode(self, normalized: str) -> list[int]:
        """The ids of a text that the model's rules have been put to (its spaces are marks)."""
        return list(chain.from_iterable(map(self.known.__getitem__, self.cuts.findall(normalized))))


@cache
def loaded(path: str):
    """(the library's processor, whose rules for spaces and whose decoder are used, and an Encoder of its pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds, names = range(model.get_piece_size()), model.id_to_piece
    byte_ids = [i for i in kinds if model.is_byte(i)]
    if len(byte_ids) != 256 or any(model.is_unused(i) for i in kinds):
        raise ValueError("the model must have a piece for each byte, and none that is unused")
    plain = [i for i in kinds if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    by_byte = sorted(byte_ids, key=lambda i: int(names(i)[3:5], 16))
    return model, Encoder({names(i): -model.get_score(i) for i in plain}, {names(i): i for i in plain}, by_byte)


def encoded(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (with the end id) and decoded (the library's text of these ids) of every row, over whole texts.

    The ids are those of the library's own encode with an end id only. A null text is an empty one, whose ids are the end
    id alone. Every row is by itself: repeated rows and null keys give a row each. The model must be a BPE model with byte
    pieces; its file goes to the executors with the job. Of a text, a task holds its ids and one number per character of a stretch
    without spaces.
    """
    spark = docs.sparkSession
    spark.sparkContext.addFile(model)
    name = Path(model).name

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, encoder = loaded(SparkFiles.get(name))
        end = library.eos_id()
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                some = part.slice(at, ROWS)
                ids = [[*encoder.encode(library.normalize(t)), end] if t else [end] for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(library.decode(ids), pa.string())], [key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def piece_table(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by one space) and decoded_sha256 of every row; odd rows as in encoded()."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded(docs, model).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
