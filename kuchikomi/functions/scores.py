"""Score and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kuchikomi.domain import ASPECTS, NEGATIVE, NEUTRAL, POSITIVE


def score_map(scores: Column) -> Column:
    """Turn ``[{code, score}]`` into a map from lower-cased code to score.

    Entries without a code are skipped, a null score is kept, and the last entry of a repeated code
    wins. An entry is kept only at the last position of its key, so the map never sees a duplicate and
    no session-wide policy has to be changed.
    """
    entries = F.transform(
        F.filter(
            F.coalesce(scores, F.array().cast("array<struct<code:string,score:double>>")),
            lambda e: e["code"].isNotNull() & (e["code"] != ""),
        ),
        lambda e: F.struct(F.lower(e["code"]).alias("code"), e["score"].alias("score")),
    )
    later_first = F.reverse(entries)
    codes = F.transform(later_first, lambda e: e["code"])
    last_of_each = F.filter(later_first, lambda e, i: F.array_position(codes, e["code"]) == i + 1)
    return F.map_from_entries(F.reverse(last_of_each))


def aspect_score(scores: Column, aspect: str) -> Column:
    """One aspect's score out of a score map, null when absent."""
    return scores.getItem(aspect)


def sentiment(score: Column) -> Column:
    """Stars to class: up to 2 negative, exactly 3 neutral, anything else positive (2.5 included)."""
    return (
        F.when(score.isNull(), F.lit(None).cast("int"))
        .when(score <= 2.0, F.lit(NEGATIVE))
        .when(score == 3.0, F.lit(NEUTRAL))
        .otherwise(F.lit(POSITIVE))
    )


def recode_polarity(label: Column) -> Column:
    """-1, 0, 1 to 0, 1, 2; any other value becomes null."""
    return (
        F.when(label == -1, F.lit(NEGATIVE)).when(label == 0, F.lit(NEUTRAL)).when(label == 1, F.lit(POSITIVE))
    )


def aspect_index(aspect: Column) -> Column:
    """Aspect name to id, -1 when unknown."""
    known = F.array(*[F.lit(a) for a in ASPECTS])
    return F.coalesce(F.array_position(known, aspect).cast("int"), F.lit(0)) - 1


def aspect_label(index: Column) -> Column:
    """Aspect id to name; an unknown id is shown as its number."""
    known = F.array(*[F.lit(a) for a in ASPECTS])
    return F.coalesce(F.get(known, index.cast("int")), index.cast("string"))


def percent(part: Column, whole: Column) -> Column:
    """Unrounded percentage; null instead of an error for an empty whole."""
    return F.try_divide(F.lit(100.0) * part, whole)


def shown_percent(part: Column, whole: Column) -> Column:
    """Percentage for display: two places, halves to even."""
    return F.bround(percent(part, whole), 2)
