"""Text, hash and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, or 0.9 of them where less than half of the bytes are ASCII, rounded up; 0 for nothing."""
    n, ascii_ = F.length(text), F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.when(n == 0, 0).when(ascii_ / F.octet_length(text) < 0.5, F.ceil(n * F.lit(0.9).cast("double"))).otherwise(F.ceil(n / 4.0)).cast("long")


def hash_prefix(data: Column) -> Column:
    """The first 64 bits of the SHA-256 of data, unsigned, as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(data, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hmac_unit(secret: str, message: Column) -> Column:
    """HMAC-SHA256 of message under secret, as a number from 0 to 1: its first 64 bits over 2^64."""
    key = secret.encode().ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return hash_prefix(F.concat(pad(0x5C), inner)).cast("double") / F.lit(2.0**64)


def sampled(unit: Column, probability: Column) -> Column:
    """At probabilities of 0 or less, or 1 or more, always; else where the unit is below."""
    return (probability <= 0) | (probability >= 1) | (unit < probability)


def class_key(engine: Column, build: Column) -> Column:
    return F.when(F.trim(build) == "", "").otherwise(F.concat_ws("|", engine, build))


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 for vectors of different length or without length."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot, aa, bb = (total(F.zip_with(wide(x), wide(y), lambda p, q: p * q)) for x, y in ((a, b), (a, a), (b, b)))
    return F.when((F.size(a) == F.size(b)) & (aa > 0) & (bb > 0), dot / (F.sqrt(aa) * F.sqrt(bb))).otherwise(0.0)
