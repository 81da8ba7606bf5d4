"""Review pages: HTML with an embedded JSON array of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuchikomi.domain import (
    CONTENTS_MARKER,
    LIST_MARKER,
    PAGINATION_TERMS,
    PAGINATION_URL_CHARS,
    PAGINATION_URL_PARTS,
    PAGINATION_URLS_SHOWN,
    TOTAL_MARKER,
)
from kuchikomi.functions.text import WHITESPACE
from kuchikomi.sources.review_json import decoded_array

# What counts as a URL in page markup; the set of blanks is wider.
URL = rf"""https?[^"'<>{WHITESPACE}]+"""


def _cut(text: Column, marker: str) -> Column:
    """What precedes and what follows the first ``marker``; the whole text alone when it does not occur.

    One mention of ``text``, so that chained cuts do not multiply the expression.
    """
    return F.split(text, rf"\Q{marker}\E", 2)


def after(text: Column, marker: str) -> Column:
    """What follows the first occurrence of ``marker``, null when it does not occur."""
    return F.get(_cut(text, marker), F.lit(1))


def until(text: Column, marker: str) -> Column:
    """What precedes the first occurrence of ``marker``, null when it does not occur."""
    return F.try_element_at(_cut(text, marker), F.lit(-2))


def between(text: Column, first: str, last: str) -> Column:
    return until(after(text, first), last)


def embedded_array(text: Column, *markers: str) -> Column:
    """The JSON array opening after the markers, taken in turn, with all that follows it; null if any is missing."""
    for marker in markers:
        text = after(text, marker)
    return F.concat(F.lit("["), after(text, "["))


def extract_pages(pages: DataFrame) -> DataFrame:
    """Add ``reported_total`` and ``reviews`` (decoded array); pages without the array have null reviews.

    The total is the integer between its marker and the next comma, null when there is none.
    """
    kept = [c for c in pages.columns if c != "html"]
    listed = pages.select(*kept, after(F.col("html"), LIST_MARKER).alias("_list"))
    return listed.select(
        *kept,
        F.trim(between(F.col("_list"), TOTAL_MARKER, ",")).try_cast("bigint").alias("reported_total"),
        decoded_array(embedded_array(F.col("_list"), CONTENTS_MARKER)).alias("reviews"),
    )


def unreadable_pages(extracted: DataFrame) -> DataFrame:
    """Pages whose review array is missing: the rejects of the extraction."""
    return extracted.where(F.col("reviews").isNull()).drop("reviews")


def page_reviews(extracted: DataFrame) -> DataFrame:
    """One row per review with its position on the page."""
    kept = [c for c in extracted.columns if c != "reviews"]
    return extracted.select(*kept, F.posexplode("reviews").alias("position", "review")).select(
        *kept, "position", "review.*"
    )


def page_ends(extracted: DataFrame) -> DataFrame:
    """Number of reviews on each page and the id, time and title of the first and the last."""
    first = F.try_element_at("reviews", F.lit(1))
    last = F.try_element_at("reviews", F.lit(-1))
    kept = [c for c in extracted.columns if c != "reviews"]
    return extracted.select(
        *kept,
        F.coalesce(F.size("reviews"), F.lit(0)).cast("bigint").alias("n_reviews"),
        first["id"].alias("first_id"),
        first["postDateTime"].alias("first_posted"),
        first["title"].alias("first_title"),
        last["id"].alias("last_id"),
        last["postDateTime"].alias("last_posted"),
        last["title"].alias("last_title"),
    )


def term_counts(pages: DataFrame) -> DataFrame:
    """Case-insensitive occurrences of each pagination term on each page, one row per page and term."""
    counted = [F.regexp_count("html", F.lit(f"(?i){term}")).cast("bigint").alias(term) for term in PAGINATION_TERMS]
    return pages.select("page_id", *counted).unpivot("page_id", list(PAGINATION_TERMS), "term", "occurrences")


def pagination_urls(pages: DataFrame) -> DataFrame:
    """The first URLs of each page that look like pagination, cut for display, with their place on the page."""
    wanted = "(?i)" + "|".join(PAGINATION_URL_PARTS)
    urls = F.regexp_extract_all("html", F.lit(URL), F.lit(0))
    matching = F.filter(urls, lambda u: F.regexp_like(u, F.lit(wanted)))
    return pages.select(
        "page_id", F.posexplode(F.slice(matching, 1, PAGINATION_URLS_SHOWN)).alias("position", "url")
    ).select("page_id", "position", F.substring("url", 1, PAGINATION_URL_CHARS).alias("url"))
