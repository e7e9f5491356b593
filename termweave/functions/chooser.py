"""Salted hashing of terms to a number from 0 to 1, the same on every machine and in every session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import LONG_MAX


def uniform(term: Column, salt: str) -> Column:
    """|first 8 bytes of md5(term "|" salt) as a signed big-endian number| / (2**63 - 1). Integers hash as decimal text."""
    digest = F.md5(F.concat(term.cast("string"), F.lit(f"|{salt}")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    number = F.shiftleft(half(1), 32).bitwiseOR(half(9))
    # the lowest number has no absolute value of its own type
    return F.abs(number.cast("double")) / F.lit(float(LONG_MAX))
