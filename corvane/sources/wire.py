"""Protocol-buffer bytes of observations: fields on the wire and ids by content, in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def scan(raw: bytes) -> Iterator[tuple[int, int, int, int, int | bytes]]:
    """Field number, wire type, start, end and value of each field; ValueError if the bytes end within one."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            if at >= len(raw) or shift > 63:
                raise ValueError("truncated")
            value |= (raw[at] & 0x7F) << shift
            at += 1
            if raw[at - 1] < 0x80:
                return value, at
            shift += 7

    at = 0
    while at < len(raw):
        start = at
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind in (1, 2, 5):
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            if at + size > len(raw):
                raise ValueError("truncated")
            value, at = raw[at : at + size], at + size
        else:
            raise ValueError("wire type")
        yield tag >> 3, kind, start, at, value


def without_field(raw: bytes, number: int) -> bytes:
    return b"".join(raw[a:b] for n, _, a, b, _ in scan(raw) if n != number)


def content_id(raw: Column) -> Column:
    """SHA-256 of a message without its id (field 2), unknown fields included; null if it isn't well formed."""

    def one(b):
        try:
            return None if b is None else hashlib.sha256(without_field(bytes(b), 2)).hexdigest()
        except ValueError:
            return None

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(one)

    return F.pandas_udf(run, "string")(raw)


def fields(raw: Column) -> Column:
    """The top-level fields in order; numbers as eight big-endian bytes; null if it isn't well formed."""

    def one(b):
        try:
            return None if b is None else [{"number": n, "wire_type": k, "value": v if isinstance(v, bytes) else v.to_bytes(8, "big")} for n, k, _, _, v in scan(bytes(b))]
        except (ValueError, OverflowError):
            return None

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(one)

    return F.pandas_udf(run, "array<struct<number:int,wire_type:int,value:binary>>")(raw)


def varint(n: Column) -> Column:
    """A length below 2^28 in base 128, low group first."""
    byte = lambda k, more: F.unhex(F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(F.lit(127)) + (128 if more else 0)), 2, "0"))
    upto = lambda last: F.concat(*[byte(k, k < last) for k in range(last + 1)])
    return F.when(n < 1 << 7, upto(0)).when(n < 1 << 14, upto(1)).when(n < 1 << 21, upto(2)).otherwise(upto(3))


def _text_field(number: int, text: Column) -> Column:
    raw = F.encode(text, "UTF-8")
    return F.when(text == "", F.lit(b"")).otherwise(F.concat(F.lit(bytes([number << 3 | 2])), varint(F.octet_length(raw)), raw))


def _event_id(protocol: str, number: int, key: Column) -> Column:
    wrapped = F.concat(F.lit(bytes([number << 3 | 2])), varint(F.octet_length(key)), key)
    return F.concat(F.lit(f"event:{protocol}:sha256:"), F.sha2(wrapped, 256))


CONTENT_ID = "^sha256:[0-9a-f]{64}$"


def x402_event_id(payment: Column, request: Column, scope: Column, discovery: Column) -> Column:
    """Canonical id of an x402 event, by payment or, without one, by discovery; null for a key of neither mode."""
    by_payment = payment.rlike("^[A-Za-z0-9_-]{16,128}$") & (discovery == "")
    by_discovery = (payment == "") & discovery.rlike(CONTENT_ID) & (request == discovery)
    fits = (by_payment | by_discovery) & request.rlike(CONTENT_ID) & (F.trim(scope) != "")
    key = F.concat(_text_field(1, payment), _text_field(2, request), _text_field(3, scope), _text_field(4, discovery))
    return F.when(fits, _event_id("x402", 1, key))


def mpp_event_id(realm: Column, method: Column, challenge: Column) -> Column:
    """Canonical id of an MPP challenge; null if a part is blank."""
    fits = (F.trim(realm) != "") & method.rlike("^[a-z0-9:_-]+$") & (F.trim(challenge) != "")
    return F.when(fits, _event_id("mpp", 2, F.concat(_text_field(1, realm), _text_field(2, method), _text_field(3, challenge))))


def mpp_discovery_event_id(service: Column, http_method: Column, path: Column, offer: Column) -> Column:
    """Canonical id of a declared offer; the number of the first offer, 0, isn't written."""
    index = F.when(offer == 0, F.lit(b"")).otherwise(F.concat(F.lit(bytes([32])), varint(offer)))
    key = F.concat(_text_field(1, service), _text_field(2, http_method), _text_field(3, path), index)
    return F.when((F.trim(service) != "") & http_method.rlike("^[a-z]+$") & (F.trim(path) != ""), _event_id("mpp", 3, key))
