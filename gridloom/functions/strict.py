"""Strict validation of records written by hand: nothing is rounded, trimmed or guessed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.coerce import NOT_STORED, SPARK_TYPES
from gridloom.functions.numbers import with_numbers
from gridloom.functions.text import text_length
from gridloom.plans.model import Field

# Limits of text.
MAX_TEXT, MAX_PHONE = 10_000, 40
# The shapes accepted.
EMAIL = (
    r"^(?!\.)(?!.*\.\.)([A-Za-z0-9_'+\-.]*)[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9\-]*\.)+[A-Za-z]{2,}\z"
)
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
DATETIME = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?"
    r"(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"
)
# The reasons given. %s is the field.
NOT_TEXT = '"%s" debe ser texto.'
TOO_LONG = '"%s" es demasiado largo.'
NOT_AN_EMAIL = '"%s" no parece un correo valido.'
NOT_A_NUMBER = '"%s" debe ser un numero.'
NOT_AN_INTEGER = '"%s" debe ser un numero entero.'
NOT_A_BOOLEAN = '"%s" debe ser si o no.'
NOT_A_DATE = '"%s" debe ser una fecha.'
DATE_FORMAT = '"%s" debe tener el formato AAAA-MM-DD.'
NOT_A_DATETIME = '"%s" debe ser una fecha con hora.'
NOT_AN_OPTION = '"%s" admite: %s.'
NO_TARGET = 'Elige un valor para "%s".'
BAD_FORMAT = "Uno de los valores no tiene el formato esperado."


def with_strict(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Add ``__value_<field>`` and ``__reason_<field>`` for fields that are columns of ``df``."""
    types = {field.name: field.dataType for field in df.schema}
    numbers = {
        f"__number_{f.name}": F.col(f.name)
        for f in fields
        if f.type in ("integer", "decimal") and isinstance(types[f.name], T.StringType)
    }
    df = with_numbers(df, numbers) if numbers else df
    checks = {f.name: _strict(F.col(f.name), types[f.name], f) for f in fields}
    df = df.withColumns({f"__reason_{n}": reason for n, (_, reason) in checks.items()})
    df = df.withColumns(
        {
            f"__value_{f.name}": F.when(
                F.col(f"__reason_{f.name}").isNull(), checks[f.name][0]
            ).cast(SPARK_TYPES[f.type])
            for f in fields
        }
    )
    return df.drop(*numbers)


def _strict(column: Column, data_type: T.DataType, field: Field) -> tuple[Column, Column]:
    """The value of a field and the reason it is refused. Null is refused where required."""
    name = field.name
    texts = isinstance(data_type, T.StringType)
    numeric = isinstance(data_type, T.NumericType)
    none = F.lit(None).cast("string")

    def say(template: str) -> Column:
        return F.lit(template.replace("%s", name, 1))

    if field.type in ("text", "phone"):
        limit = MAX_PHONE if field.type == "phone" else MAX_TEXT
        wrong = say(NOT_TEXT)
        reason = F.when(text_length(column) > limit, say(TOO_LONG)) if texts else wrong
        value = column
    elif field.type == "email":
        wrong = say(NOT_AN_EMAIL)
        reason = F.when(~column.rlike(EMAIL), wrong) if texts else wrong
        value = column
    elif field.type in ("integer", "decimal"):
        wrong = say(NOT_A_NUMBER)
        number = F.col(f"__number_{name}") if texts else column
        if texts or numeric:
            double = number.cast("double")
            finite = double.isNotNull() & ~F.isnan(double) & (F.abs(double) < float("inf"))
            reason = F.when(~finite, wrong)
            if field.type == "integer":
                reason = reason.when(number != F.floor(number), say(NOT_AN_INTEGER))
            value = number.try_cast(SPARK_TYPES[field.type])
            reason = reason.when(value.isNull(), F.lit(NOT_STORED))
        else:
            value, reason = F.lit(None), wrong
    elif field.type == "boolean":
        wrong = say(NOT_A_BOOLEAN)
        fits = isinstance(data_type, T.BooleanType)
        value, reason = (column, none) if fits else (F.lit(None), wrong)
    elif field.type == "date":
        wrong = say(NOT_A_DATE)
        value = column.try_cast("date") if texts else F.lit(None)
        reason = (
            F.when(~column.rlike(DATE), say(DATE_FORMAT)).when(value.isNull(), F.lit(BAD_FORMAT))
            if texts
            else wrong
        )
    elif field.type == "datetime":
        wrong = say(NOT_A_DATETIME)
        value = column.try_cast("timestamp") if texts else F.lit(None)
        reason = F.when(~column.rlike(DATETIME) | value.isNull(), wrong) if texts else wrong
    elif field.type == "select" and field.options:
        listed = NOT_AN_OPTION.replace("%s", name, 1).replace("%s", ", ".join(field.options), 1)
        wrong = F.lit(listed)
        value = column
        reason = F.when(~column.isin(*field.options), wrong) if texts else wrong
    else:
        wrong = say(NO_TARGET if field.type == "relation" else NOT_TEXT)
        value, reason = column, none if texts else wrong
    absent = wrong if field.required else none
    return value, F.when(column.isNull(), absent).otherwise(reason)
