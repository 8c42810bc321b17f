"""Numbers written by people."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import WS

_PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z"


def with_numbers(df: DataFrame, texts: Mapping[str, Column]) -> DataFrame:
    """Add a double per text: ``1.234,56`` and ``1,234.56`` alike; null when it holds no number.

    Only digits, separators and signs are read. A separator that repeats alone groups
    thousands; otherwise the last separator is the decimal one. Each step is a column of its
    own, because the next one reads it several times.
    """
    kept, plain = "__kept_{}", "__plain_{}"
    df = df.withColumns(
        {kept.format(n): F.regexp_replace(t, r"[^0-9,.+-]", "") for n, t in texts.items()}
    )
    df = df.withColumns({plain.format(n): _canonical(F.col(kept.format(n))) for n in texts})
    df = df.withColumns({n: _value(F.col(plain.format(n))) for n in texts})
    return df.drop(*[t.format(n) for n in texts for t in (kept, plain)])


def _canonical(kept: Column) -> Column:
    """Plain digits with a decimal point. Separators without any digit ("...") become zero."""
    commas = F.length(kept) - F.length(F.translate(kept, ",", ""))
    points = F.length(kept) - F.length(F.translate(kept, ".", ""))
    thousands = ((points > 1) & (commas == 0)) | ((commas > 1) & (points == 0))
    # The last separator: the rest of the text after it holds no other.
    decimal_comma = kept.rlike(r",[^,.]*\z")
    grouped = F.translate(kept, ",.", "")
    return (
        F.when(thousands, F.when(grouped == "", "0").otherwise(grouped))
        .when(decimal_comma, F.translate(kept, ",.", "."))
        .otherwise(F.translate(kept, ",", ""))
    )


def _value(plain: Column) -> Column:
    value = F.when(plain.rlike(_PLAIN), plain.try_cast("double"))
    return F.nullif(F.nullif(value, F.lit(float("inf"))), F.lit(float("-inf")))


def round_half_up(number: Column) -> Column:
    """Nearest integer, halves towards plus infinity; null outside 64 bits."""
    low = F.floor(number)
    rounded = low + F.when(number - low >= 0.5, 1).otherwise(0)
    return F.when((number >= -(2.0**63)) & (number < 2.0**63), rounded).cast("bigint")


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]", "")
