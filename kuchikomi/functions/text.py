"""Text expressions: Unicode-aware cleaning, stripping, lengths and previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that count as whitespace. ``\s`` adds tab, newline, vertical tab,
# form feed, carriage return and space.
WHITESPACE = r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Every run but a single space, which stays as it is: between most words nothing has to be replaced.
# One look at the next character tells printable ASCII apart, which is quicker than the class of all whitespace.
_RUN = f" (?=[^!-~])[{WHITESPACE}]+|(?=[^ -~])[{WHITESPACE}]+"
# The same characters one by one, for functions that take a set of characters.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def clean_text(text: Column) -> Column:
    """Collapse every whitespace run to one space and strip; null becomes the empty string."""
    return F.coalesce(F.trim(F.regexp_replace(text, _RUN, " ")), F.lit(""))


def strip(text: Column) -> Column:
    """Remove whitespace, also the ideographic space, from both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def char_length(text: Column) -> Column:
    """Length in code points; null stays null."""
    return F.length(text).cast("bigint")


def stripped_length(text: Column) -> Column:
    return char_length(strip(text))


def preview(text: Column, chars: int) -> Column:
    """The text, cut to ``chars`` characters plus an ellipsis if it is longer."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def filled(text: Column) -> Column:
    """True for a value that is neither null nor the empty string."""
    return text.isNotNull() & (text != "")
