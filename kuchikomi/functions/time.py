"""Time expressions; months are those of UTC, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# A time of day followed by an offset or the name of a zone.
_ZONED = r":\d{2}.*?(?:[Zz]|[+-]\d{1,2}(?::?\d{2}){0,2}|[A-Za-z]+(?:/\w+)+|(?:UTC|GMT|UT).*)\s*$"


def parse_strict(text: Column) -> Column:
    """ISO text to an instant, UTC where no offset is given; a malformed value fails the job, null stays null."""
    broken = F.raise_error(F.concat(F.lit("not a timestamp: "), text)).cast("timestamp")
    return F.coalesce(parse_lenient(text), F.when(text.isNotNull(), broken))


def parse_lenient(text: Column) -> Column:
    """ISO text to an instant, UTC where no offset is given; a malformed value becomes null."""
    read = text.try_cast("timestamp")
    # Nearly all zoned times end in Z or +hh:mm after a time of day; only others need the pattern.
    before_offset = F.length(text) - 5
    offset = F.substring(text, before_offset, F.lit(1)).isin("+", "-") & (F.substring(text, -3, 1) == ":")
    daytime = (F.instr(text, ":") > 0) & (F.instr(text, ":") < before_offset)
    zoned = (daytime & (text.endswith("Z") | offset)) | F.regexp_like(text, F.lit(_ZONED))
    return F.when(zoned, read).otherwise(F.from_utc_timestamp(read, F.current_timezone()))


def month_of(instant: Column) -> Column:
    """UTC calendar month of an instant as sortable ``yyyy-MM``."""
    return F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM")


def month_start(month: Column) -> Column:
    """First day of a ``yyyy-MM`` month."""
    return F.to_date(F.concat(month, F.lit("-01")))
