"""Token expressions at character and word granularity, and fixed-length id sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kuchikomi.domain import CHAR_ID_SPACE, PAD_ID, WORD_ID_SPACE
from kuchikomi.functions.hashing import hex_number
from kuchikomi.functions.text import WHITESPACE

# One word is a run of one script, a run of digits, or any other single visible character. The long
# vowel mark U+30FC belongs to no script and is counted with katakana.
WORD_RUNS = (
    r"\p{IsHan}+|\p{IsHiragana}+|[\p{IsKatakana}\x{30fc}]+|\p{IsHangul}+|\p{IsCyrillic}+|\p{IsGreek}+"
    r"|[\p{IsLatin}\p{M}]+|\p{N}+"
)
WORD = rf"{WORD_RUNS}|[^{WHITESPACE}]"
SEGMENT = rf"{WORD_RUNS}|(?s:.)"

# The same matches as of the patterns above, found sooner: what most texts hold is told by its first character. ASCII letters
# are of one script only, and other ASCII characters but digits of none.
LATIN_FIRST = r"[A-Za-z][A-Za-z\p{IsLatin}\p{M}]*+"
SOON_WORD = rf"(?![\t-\r\x1c- ])(?:{LATIN_FIRST}|[!-/:-@\[-`{{-~]|{WORD})"
SOON_SEGMENT = rf"{LATIN_FIRST}|[\x00-/:-@\[-`{{-\x7F]|{SEGMENT}"


def char_tokens(text: Column) -> Column:
    """Code points of a text; the empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def char_ids(chars: Column) -> Column:
    return F.transform(chars, lambda c: F.ascii(c) % F.lit(CHAR_ID_SPACE))


def word_tokens(text: Column) -> Column:
    """Script-run words; whitespace separates and is dropped."""
    return F.regexp_extract_all(text, F.lit(SOON_WORD), F.lit(0))


def leading_words(text: Column, n: int) -> Column:
    """The text up to its ``n``-th word; words of it are the first ones of the text, and no more of the text is read."""
    return F.regexp_extract(text, rf"^(?:[{WHITESPACE}]*+(?:{SOON_WORD})){{0,{n}}}+", 0)


def word_ids(words: Column) -> Column:
    """Reproducible hash ids: the leading 32 bits of md5, reduced to the id space."""
    return F.transform(words, lambda w: (hex_number(F.md5(w), 1, 8) % F.lit(WORD_ID_SPACE)).cast("int"))


def padded(ids: Column, length: int) -> Column:
    """Exactly ``length`` ids: cut on the right, or filled with the pad id."""
    fill = F.array_repeat(F.lit(PAD_ID), length)
    return F.slice(F.concat(ids, fill), 1, length)


def attention(ids: Column, length: int) -> Column:
    """1 where a padded sequence holds a real id, 0 where it holds padding."""
    real = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))


def shown(tokens: Column) -> Column:
    """Tokens on one line."""
    return F.array_join(tokens, " | ")
