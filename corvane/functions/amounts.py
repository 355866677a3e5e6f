"""Exact amounts beyond 38 digits: canonical texts summed in limbs of 18 digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB, LIMBS = 18, 5
#: Fixed value: largest unsigned 128-bit number.
U128_MAX = "340282366920938463463374607431768211455"


def is_canonical(amount: Column) -> Column:
    """0, or digits without a leading 0."""
    return F.coalesce(amount.rlike("^(0|[1-9][0-9]*)$"), F.lit(False))


def fits_u128(amount: Column) -> Column:
    most = F.lit(U128_MAX)
    return is_canonical(amount) & ((F.length(amount) < len(U128_MAX)) | ((F.length(amount) == len(U128_MAX)) & (amount <= most)))


def parses_u128(amount: Column) -> Column:
    """Whether a text is an unsigned number of at most 128 bits, perhaps with a plus or leading zeros."""
    digits = F.regexp_replace(amount, r"^\+?0*(?=[0-9])", "")
    return F.coalesce(amount.rlike(r"^\+?[0-9]+$"), F.lit(False)) & F.coalesce(fits_u128(digits), F.lit(False))


def is_less(a: Column, b: Column) -> Column:
    """Whether canonical amount a is less than b."""
    return F.struct(F.length(a), a) < F.struct(F.length(b), b)


def exact_sum(amount: Column) -> Column:
    """Sum of canonical amounts of up to 78 digits, as a canonical text; nulls are let be, null for no amount."""
    padded = F.lpad(amount, LIMB * LIMBS, "0")
    sums = [F.sum(F.substring(padded, LIMB * i + 1, LIMB).cast("decimal(20,0)")).cast("decimal(38,0)") for i in range(LIMBS)]
    base = F.lit(10**LIMB).cast("decimal(38,0)")
    carry, limbs = F.lit(0).cast("decimal(38,0)"), []
    for s in reversed(sums):
        whole = s + carry
        limbs.append(F.lpad((whole % base).cast("decimal(18,0)").cast("string"), LIMB, "0"))
        carry = ((whole - whole % base) / base).cast("decimal(38,0)")
    return F.regexp_replace(F.concat(carry.cast("string"), *reversed(limbs)), "^0+(?=.)", "")
