"""Apparent types: which of the closed set of types one cell could be.

A cell may fit several types, so the answer is one small integer with a bit per type. The
bits are summed by the profile; see ``operators.profile``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.cells import BOOLEAN, DATETIME, NUMBER, TEXT, Cell
from gridloom.functions.text import WS

# The types a column can be voted, most specific first.
PRIORITY = ("boolean", "integer", "decimal", "date", "datetime", "email", "phone", "text")
# Fixed value: share of the filled cells that must fit.
ACCEPTANCE = 0.9
# Words read as booleans.
BOOLEAN_WORDS = (
    "true", "false", "si", "sí", "no", "yes", "verdadero", "falso", "1", "0", "x",
)
# The shape of each type.
EMAIL = rf"(?i)^[^{WS}@]+@[^{WS}@]+\.[a-z]{{2,}}\z"
PHONE = rf"^\+?[0-9][0-9{WS}\-().]{{5,18}}\z"
PHONE_MARK = rf"[+{WS}\-().]"
INTEGER = r"^[+-]?[0-9]+\z"
DECIMAL = r"^[+-]?([0-9]+([.,][0-9]+)?|[.,][0-9]+)\z"
LEADING_ZERO = r"^[+-]?0[0-9]"
DATE_ONLY = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4})\z"
DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?"

FLAGS = ("date", "datetime", "boolean", "integer", "decimal", "email", "phone", "leading_zero")
BIT = {name: 1 << i for i, name in enumerate(FLAGS)}


def _bit(name: str, test: Column) -> Column:
    return F.when(test, BIT[name]).otherwise(0)


def _text_mask(text: Column) -> Column:
    # Only text that opens with a digit, sign or separator can be a date, number or phone, and
    # most of that is a bare number, so most text is settled by one or two searches.
    numeric_start = F.substring(text, 1, 1).isin(*"0123456789+-.,")
    short = F.length(text) <= max(len(word) for word in BOOLEAN_WORDS)
    boolean = _bit("boolean", short & F.lower(text).isin(*BOOLEAN_WORDS))
    email = _bit("email", F.contains(text, F.lit("@")) & text.rlike(EMAIL))
    phone = _bit("phone", text.rlike(PHONE) & text.rlike(PHONE_MARK))
    # A signed or dotted number may also be a phone; bare digits may not.
    marked = F.startswith(text, F.lit("+")) | F.contains(text, F.lit("."))
    number_phone = F.when(marked, phone).otherwise(0)
    padded = F.lit(BIT["leading_zero"])
    return (
        F.when(~numeric_start, boolean.bitwiseOR(email))
        .when(
            text.rlike(INTEGER),
            F.when(text.rlike(LEADING_ZERO), padded)
            .otherwise(F.lit(BIT["integer"] | BIT["decimal"]).bitwiseOR(boolean))
            .bitwiseOR(number_phone),
        )
        .when(
            text.rlike(DECIMAL),
            F.when(text.rlike(LEADING_ZERO), padded)
            .otherwise(F.lit(BIT["decimal"]))
            .bitwiseOR(number_phone),
        )
        .when(text.rlike(DATE_ONLY), BIT["date"] | BIT["datetime"])
        .when(text.rlike(DATE_TIME), BIT["datetime"])
        .otherwise(
            F.when(text.rlike(LEADING_ZERO), padded).otherwise(0).bitwiseOR(phone).bitwiseOR(email)
        )
    )


def type_mask(cell: Cell) -> Column:
    def number() -> Column:
        whole = cell.number == F.floor(cell.number)
        return F.lit(BIT["decimal"]).bitwiseOR(_bit("integer", whole))

    def time() -> Column:
        no_time = (F.hour(cell.time) + F.minute(cell.time) + F.second(cell.time)) == 0
        return F.lit(BIT["datetime"]).bitwiseOR(_bit("date", no_time))

    cases = {TEXT: lambda: _text_mask(cell.text)}
    if cell.number is not None:
        cases[NUMBER] = number
    if cell.flag is not None:
        cases[BOOLEAN] = F.lit(BIT["boolean"])
    if cell.time is not None:
        cases[DATETIME] = time
    return cell.branch(cases)
