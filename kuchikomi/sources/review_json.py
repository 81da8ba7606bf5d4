"""One review as JSON text, decoded without losing it to a field of another type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kuchikomi.domain import CORRUPT, RAW_REVIEW
from kuchikomi.functions.text import strip

# Every field as text: a string as it is, anything else as its JSON.
_AS_TEXT = T.StructType([*[T.StructField(f.name, T.StringType()) for f in RAW_REVIEW.fields], T.StructField(CORRUPT, T.StringType())])
_MARKED = T.StructType([*_AS_TEXT.fields[:-1], T.StructField("mark", T.StringType())])
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def decoded(text: Column) -> Column:
    """The object's fields as text; ``CORRUPT`` is set if the text is not a JSON object."""
    return F.from_json(text, _AS_TEXT, _OPTIONS)


def marked(text: Column) -> Column:
    """``text`` read as the first of two elements, the other a mark made from the text itself: one pass gives fields and end."""
    return F.from_json(F.concat(F.lit("["), text, F.lit(',{"mark":"'), _mark(text), F.lit('"}]')), T.ArrayType(_MARKED))


def _mark(text: Column) -> Column:
    return F.xxhash64(text).cast("string")


def alone(text: Column, elements: Column) -> Column:
    """The fields of ``text``, whose ``marked`` elements are given, if it is one JSON object and nothing else, null otherwise."""
    bare = strip(text)
    whole = (F.size(elements) == 2) & (F.try_element_at(elements, F.lit(2))["mark"] == _mark(text))
    return F.when(bare.startswith("{") & bare.endswith("}") & whole, F.try_element_at(elements, F.lit(1)))


def is_object(text: Column, fields: Column) -> Column:
    """Whether ``text``, whose ``decoded`` fields are given, is one JSON object and nothing else.

    The decoder stops at the end of the object, so what follows is tested by reading the text as the first of two
    elements, the other a mark made from the text itself, which therefore cannot hold it.
    """
    bare, mark = strip(text), F.xxhash64(text).cast("string")
    elements = F.from_json(F.concat(F.lit("["), text, F.lit(',{"mark":"'), mark, F.lit('"}]')), "array<struct<mark: string>>")
    alone = (F.size(elements) == 2) & (F.try_element_at(elements, F.lit(2))["mark"] == mark)
    return bare.startswith("{") & bare.endswith("}") & fields[CORRUPT].isNull() & F.coalesce(alone, F.lit(False))


def typed(fields: Column) -> list[Column]:
    """The decoded fields in the types of ``RAW_REVIEW``: a value that does not fit is null, a score that is no object is left out."""
    entries = F.filter(F.from_json(fields["scores"], T.ArrayType(T.StringType())), lambda s: strip(s).startswith("{"))
    score = F.transform(
        F.transform(entries, lambda s: F.from_json(s, "code string, score string")),
        lambda s: F.struct(s["code"].alias("code"), s["score"].try_cast("double").alias("score")),
    )
    return [
        fields["id"].alias("id"),
        fields["title"].alias("title"),
        fields["comment"].alias("comment"),
        fields["overallScore"].try_cast("double").alias("overallScore"),
        fields["postDateTime"].alias("postDateTime"),
        F.from_json(fields["provider"], "name string").alias("provider"),
        F.from_json(fields["reservation"], "checkInDate string").alias("reservation"),
        score.alias("scores"),
    ]


def decoded_array(text: Column) -> Column:
    """A JSON array of reviews, with whatever follows it, as an array of ``RAW_REVIEW``; other elements are left out.

    Each step names an element once, so it is decoded once and not once per field.
    """
    elements = F.filter(F.from_json(text, T.ArrayType(T.StringType())), lambda e: strip(e).startswith("{"))
    return F.transform(F.transform(elements, decoded), lambda r: F.struct(*typed(r)))
