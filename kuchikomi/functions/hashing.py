"""Hash expressions any engine can reproduce, the source of all randomness in this package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column) -> Column:
    """md5 of the parts joined with ``|``."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hex_number(hexadecimal: Column, start: int, digits: int) -> Column:
    """``digits`` hexadecimal digits from ``start`` as a bigint (at most 15 digits)."""
    return F.conv(F.substring(hexadecimal, start, digits), 16, 10).cast("bigint")


def unit_interval(hexadecimal: Column, start: int) -> Column:
    """13 digits, i.e. 52 bits, as a double in [0, 1): fine enough to address 10^15 rows."""
    return hex_number(hexadecimal, start, 13).cast("double") / F.lit(float(2**52))


def compact(value: Column, chars: int = 64) -> Column:
    """A short stand-in for counting distinct values without shuffling long texts.

    Values up to ``chars`` characters stand for themselves; longer ones become a mark and their SHA-256,
    which is one character too long to be mistaken for a short value.
    """
    text = value.cast("string")
    return F.when(F.length(text) > chars, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)
