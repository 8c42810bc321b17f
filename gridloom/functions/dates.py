"""Dates written by people: ISO, or day first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_PREFIX = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
ISO_DATE = ISO_PREFIX + r"\z"
ISO_TIME = (
    ISO_PREFIX + r"[T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?( ?(Z|[+-][0-9]{2}(:?[0-9]{2})?))?\z"
)
#: Two digits, two digits and a year of four, which is what most people write.
_FULL_DAY_FIRST = r"^[0-9]{2}[/\-.][0-9]{2}[/\-.](?!00)[0-9]{4}\z"
DAY_FIRST = r"^([0-9]{1,2})[/\-.]([0-9]{1,2})[/\-.]([0-9]{2,4})\z"


def day_first(text: Column) -> Column:
    """``15/9/26``: day, month, year; years below 100 are of this century."""
    written = F.regexp_replace(text, DAY_FIRST, "$3-$2-$1")
    century = F.regexp_replace(written, r"^(?:00)?([0-9]{2})-", "20$1-")
    padded = F.regexp_replace(century, r"^([0-9]{3})-", "0$1-")
    parts = [F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)]
    return F.when(text.rlike(_FULL_DAY_FIRST), F.concat_ws("-", *parts).try_cast("date")).when(
        text.rlike(DAY_FIRST), padded.try_cast("date")
    )


def iso_date(text: Column) -> Column:
    """The day as written, with or without a valid time after it; never shifted by a zone."""
    valid = text.rlike(ISO_DATE) | (text.rlike(ISO_TIME) & _iso_time(text).isNotNull())
    # The fifth character settles most text without a search.
    return F.when(
        F.substring(text, 5, 1) == "-", F.when(valid, F.substring(text, 1, 10).try_cast("date"))
    )


def _iso_time(text: Column) -> Column:
    clean = F.translate(F.regexp_replace(text, r"(?<=[0-9]) (?=[Z+-])", ""), ",", ".")
    # Seconds and a zone are optional in what people write and not in what Spark reads.
    seconds = F.regexp_replace(clean, r"^(.{11}[0-9]{1,2}:[0-9]{2})(?=\z|[Z+-])", "$1:00")
    zoned = F.regexp_replace(seconds, r"^(.{11}[0-9:.]+)\z", "$1Z")
    return zoned.try_cast("timestamp")


def iso_instant(text: Column) -> Column:
    """ISO text as an instant; a time without a zone is UTC."""
    return F.when(
        text.rlike(ISO_DATE), F.concat(text, F.lit("T00:00:00Z")).try_cast("timestamp")
    ).when(text.rlike(ISO_TIME), _iso_time(text))


def midnight(date: Column) -> Column:
    return F.concat(date.cast("string"), F.lit("T00:00:00Z")).try_cast("timestamp")
