"""Cells: one dynamically typed scalar, seen through a fixed set of expressions.

A ``Cell`` is built either from an ordinary typed column, where the kind is known when the
plan is built and only one branch is emitted, or from the ``struct<kind,s,n,b,t>`` of a
sheet, where the branches become a ``case``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.text import WS, normalize_text, trim_ws

TEXT, NUMBER, BOOLEAN, DATETIME = "text", "number", "boolean", "datetime"

CELL_TYPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("n", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("t", T.TimestampNTZType()),
    ]
)


def number_text(number: Column) -> Column:
    """Shortest text of a double: no exponent between 1e-6 and 1e21, no trailing ``.0``."""
    size = F.abs(number)
    plain = number.cast("string")
    exponent = F.regexp_replace(
        F.regexp_replace(plain, r"(\.0)?E", "e"), r"e(\d)", r"e+$1"
    )
    digits = F.rtrim(plain.cast("decimal(38,22)").cast("string"), F.lit("0"))
    return (
        F.when(F.isnan(number) | (size == float("inf")), F.lit(""))
        .when((size < 1e15) & (number == F.floor(number)), number.cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), plain)
        .when((size >= 1e15) & (size < 1e21), plain.cast("decimal(38,0)").cast("string"))
        .when((size >= 1e-6) & (size < 1e15), digits)
        .otherwise(exponent)
    )


def time_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


@dataclass(frozen=True)
class Cell:
    """``kind`` is one of the four names when known while planning, else a column."""

    kind: str | Column
    text: Column
    number: Column | None = None
    flag: Column | None = None
    time: Column | None = None
    null: Column | None = None
    #: Whether a text cell is blank, when there is a cheaper test than its trimmed text.
    no_words: Column | None = None

    def branch(self, cases: dict[str, Column | Callable[[], Column]]) -> Column:
        """The expression for this cell's kind; ``text`` is the default.

        A case given as a function is only built when the kind is possible.
        """

        def built(case: Column | Callable[[], Column]) -> Column:
            return case if isinstance(case, Column) else case()

        if isinstance(self.kind, str):
            return built(cases[self.kind] if self.kind in cases else cases[TEXT])
        others = [(kind, case) for kind, case in cases.items() if kind != TEXT]
        chosen = F
        for kind, case in others:
            chosen = chosen.when(self.kind == kind, built(case))
        return chosen.otherwise(built(cases[TEXT])) if others else built(cases[TEXT])

    def may_be(self, kind: str) -> bool:
        """False only when this cell is known to be of a kind with its own case."""
        return not isinstance(self.kind, str) or self.kind in (kind, BOOLEAN, DATETIME)

    def text_unless(self, *kinds: str) -> Column:
        """The text, null for a sheet's cell of these kinds, which have a value that is read instead."""
        if isinstance(self.kind, str):
            return self.text
        return F.when(F.coalesce(~self.kind.isin(*kinds), F.lit(True)), self.text)

    @property
    def blank(self) -> Column:
        return self.branch(
            {
                TEXT: self.text == "" if self.no_words is None else self.no_words,
                NUMBER: self._missing(self.number),
                BOOLEAN: self._missing(self.flag),
                DATETIME: self._missing(self.time),
            }
        )

    def _missing(self, payload: Column | None) -> Column:
        if self.null is not None:
            return self.null
        return F.lit(True) if payload is None else payload.isNull()

    @property
    def key(self) -> Column:
        """Normalized value; null for a blank cell."""
        keyed = self.branch(
            {
                TEXT: lambda: normalize_text(self.text),
                NUMBER: self.text,
                BOOLEAN: self.text,
                DATETIME: F.lower(self.text),
            }
        )
        return F.when(~self.blank, keyed)

    @property
    def link_key(self) -> Column:
        """Normalized value, null also when nothing is left of it."""
        return F.nullif(self.key, F.lit(""))


def as_ntz(column: Column, data_type: T.DataType) -> Column:
    """Wall-clock time; an instant is written in UTC whatever the session zone is."""
    if isinstance(data_type, T.TimestampType):
        return F.to_utc_timestamp(column, F.current_timezone()).cast("timestamp_ntz")
    return column.cast("timestamp_ntz")


def cell_of(column: Column, data_type: T.DataType) -> Cell:
    if isinstance(data_type, T.StructType):
        time = column["t"]
        no_words = ~F.coalesce(column["s"].rlike(f"[^{WS}]"), F.lit(False))
        text = (
            F.when(column["kind"] == TEXT, trim_ws(column["s"]))
            .when(column["kind"] == NUMBER, number_text(column["n"]))
            .when(column["kind"] == BOOLEAN, column["b"].cast("string"))
            .when(column["kind"] == DATETIME, time_text(time))
        )
        return Cell(
            column["kind"], _filled(text), column["n"], column["b"], time, no_words=no_words
        )
    if isinstance(data_type, T.BooleanType):
        return Cell(BOOLEAN, _filled(column.cast("string")), flag=column, null=column.isNull())
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        time = as_ntz(column, data_type)
        return Cell(DATETIME, _filled(time_text(time)), time=time, null=column.isNull())
    if isinstance(data_type, T.FloatType):
        column = column.cast("string").cast("double")
        data_type = T.DoubleType()
    if isinstance(data_type, T.DoubleType):
        return Cell(NUMBER, _filled(number_text(column)), number=column, null=column.isNull())
    if isinstance(data_type, T.DecimalType) and data_type.scale:
        text = F.rtrim(F.rtrim(column.cast("string"), F.lit("0")), F.lit("."))
        return Cell(NUMBER, _filled(text), number=column, null=column.isNull())
    if isinstance(data_type, T.NumericType):
        return Cell(NUMBER, _filled(column.cast("string")), number=column, null=column.isNull())
    text = column.cast("string")
    return Cell(TEXT, _filled(trim_ws(text)))


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def cells_of(df: DataFrame, columns: list[str] | None = None) -> dict[str, Cell]:
    types = {field.name: field.dataType for field in df.schema}
    return {
        name: cell_of(column(name), types[name]) for name in columns or df.columns
    }


def trimmed(df: DataFrame) -> tuple[DataFrame, dict[str, Cell]]:
    """``df`` with its text columns trimmed, nulls as empty text, and the cells of its columns.

    The text of a sheet's cell is a column beside it. Expressions that read a text several times then read
    a column instead of building it again.
    """
    cells, columns = cells_of(df), []
    for name, cell in cells.items():
        if not isinstance(cell.kind, str):
            columns += [column(name), cell.text.alias(f"__text_of_{name}")]
            cells[name] = replace(cell, text=column(f"__text_of_{name}"), no_words=None)
        elif cell.kind == TEXT:
            columns.append(cell.text.alias(name))
            cells[name] = Cell(TEXT, column(name))
        else:
            columns.append(column(name))
    return df.select(*columns), cells
