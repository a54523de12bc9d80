"""A look at the vectors of a JSON result before any is built: rows and width, or what is wrong, within given bounds."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows, numbers of a row and numbers in all that no result may exceed.
MOST_ROWS, MOST_WIDTH, MOST_NUMBERS = 1_000_000, 65_536, 16 << 20

_NUMBER = rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_GAP = rb"[ \t\r\n]*+"
_ROW = re.compile(rb"\[%s%s(?:%s,%s%s)*+%s\]" % (_GAP, _NUMBER, _GAP, _GAP, _NUMBER, _GAP))
_SPACE, _ONE = re.compile(_GAP), re.compile(_NUMBER)
#: Values that are no numbers: opened lists and objects, words, strings.
_OTHER = re.compile(rb'[\[{]|true|false|null|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"')
_LONG = re.compile(rb"[0-9]{300}")


class Wrong(Exception):
    """json, count, dimension or numeric."""


def _skip(raw: bytes, at: int) -> int:
    return _SPACE.match(raw, at).end()


def _end_of_number(raw: bytes, at: int) -> int:
    """Behind the value at `at`, which must be a number that a double holds; as a parser that goes token by token would judge it."""
    found = _ONE.match(raw, at)
    if found is None:
        raise Wrong("numeric" if _OTHER.match(raw, at) else "json")
    end = found.end()
    if raw[end : end + 1] not in (b",", b"]", b" ", b"\t", b"\r", b"\n"):
        raise Wrong("json")
    if not math.isfinite(float(found.group())):
        raise Wrong("numeric")
    return end


def _slow_row(raw: bytes, at: int, most: int) -> tuple[int, int]:
    """(width, place behind it) of the row at `at`, number by number: for rows that the pattern of whole rows leaves open."""
    width, at = 0, _skip(raw, at + 1)
    while raw[at : at + 1] not in (b"]", b"}", b""):
        if width >= most:
            raise Wrong("dimension")
        if width:
            if raw[at : at + 1] != b",":
                raise Wrong("json")
            at = _skip(raw, at + 1)
        at = _skip(raw, _end_of_number(raw, at))
        width += 1
    if raw[at : at + 1] != b"]":
        raise Wrong("json")
    return width, at + 1


def _row(raw: bytes, at: int, most: int) -> tuple[int, int]:
    """(width, place behind it) of the row at `at`. Commas are counted first, in place: no more than `most` numbers are ever looked at."""
    close = raw.find(b"]", at)
    if close > 0 and raw.count(b",", at, close) < most:
        found = _ROW.match(raw, at)
        if found is not None and found.end() == close + 1:
            plain = raw.find(b"e", at, close) < 0 and raw.find(b"E", at, close) < 0 and not (close - at > 300 and _LONG.search(raw, at, close))
            if plain or all(math.isfinite(float(n.group())) for n in _ONE.finditer(raw, at, close)):  # only these can be beyond a double
                return raw.count(b",", at, close) + 1, close + 1
    return _slow_row(raw, at, most)


def scan(raw: bytes, max_records: int = 0, dimension: int = 0) -> tuple[int, int]:
    """(rows, width) of a JSON list of lists of numbers; raises Wrong at the first fault, in the order of the bytes.

    At most max_records rows (0: MOST_ROWS) of exactly `dimension` numbers (0: all as wide as the first) are read, and
    nothing behind the first that exceeds either is looked at. Nothing is built: what is held besides raw does not grow with it.
    """
    at = _skip(raw, 0)
    if raw[at : at + 1] != b"[":
        whole = _OTHER.match(raw, at) or _ONE.match(raw, at)
        raise Wrong("count" if whole else "json")
    at, rows, dim, numbers = _skip(raw, at + 1), 0, 0, 0
    while raw[at : at + 1] not in (b"]", b"}", b""):
        if rows >= MOST_ROWS or 0 < max_records <= rows:
            raise Wrong("count")
        if rows:
            if raw[at : at + 1] != b",":
                raise Wrong("json")
            at = _skip(raw, at + 1)
        if raw[at : at + 1] != b"[":
            raise Wrong("dimension" if _OTHER.match(raw, at) or _ONE.match(raw, at) else "json")
        width, at = _row(raw, at, min(dimension or MOST_WIDTH, MOST_WIDTH, MOST_NUMBERS - numbers))
        if not width or width != (dim or width) or width != (dimension or width):
            raise Wrong("dimension")
        dim, rows, numbers, at = width, rows + 1, numbers + width, _skip(raw, at)
    if raw[at : at + 1] != b"]":
        raise Wrong("json")
    if not rows:
        raise Wrong("count")
    if _skip(raw, at + 1) != len(raw):
        raise Wrong("json")
    return rows, dim


def preflight(df: DataFrame, key: str, raw: str, max_records: str, dimension: str) -> DataFrame:
    """key, rows, dim and error (empty, json, count, dimension or numeric) per row; null text is no JSON, null bounds are none.

    rows and dim are null where there is an error.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = pa.schema([("rows", pa.int64()), ("dim", pa.int64()), ("error", pa.string())])

    def one(text: bytes | None, most: int | None, dim: int | None) -> tuple:
        try:
            return (*scan(text or b"", most or 0, dim or 0), "")
        except Wrong as why:
            return None, None, str(why)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [one(r.as_py(), m.as_py(), d.as_py()) for r, m, d in zip(part.column(1), part.column(2), part.column(3), strict=True)]
            rest = [pa.array([f[i] for f in found], t) for i, t in enumerate(schema.types)]
            yield pa.RecordBatch.from_arrays([part.column(0), *rest], ["k", *schema.names])

    fed = df.select(F.col(key).alias("k"), F.col(raw).cast("binary").alias("raw"), F.col(max_records).cast("long").alias("most"), F.col(dimension).cast("long").alias("dim"))
    return fed.mapInArrow(run, f"k {kind}, rows long, dim long, error string").withColumnRenamed("k", key)
