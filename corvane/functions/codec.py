"""Length-prefixed encoding and content hashes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count(n: Column) -> Column:
    """A number as eight big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def field(text: Column) -> Column:
    """The byte length of a text and its UTF-8 bytes; null stays null."""
    raw = F.encode(text.cast("string"), "UTF-8")
    return F.concat(count(F.octet_length(raw)), raw)


def field_of(raw: Column) -> Column:
    """The length of bytes and the bytes."""
    return F.concat(count(F.octet_length(raw)), raw)


def fields(*texts: Column) -> Column:
    return F.concat(*[field(t) for t in texts])


def optional(text: Column) -> Column:
    """One byte that tells whether there is a value, then the value."""
    return F.when(text.isNull(), F.lit(bytes([0]))).otherwise(F.concat(F.lit(bytes([1])), field(text)))


def each(items: Column, encode) -> Column:
    """The number of items and the encoding of each, in order."""
    return F.concat(count(F.size(items)), F.aggregate(items, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, encode(x))))


def texts(items: Column) -> Column:
    return each(items, field)


def sha256(encoded: Column) -> Column:
    return F.sha2(encoded, 256)
