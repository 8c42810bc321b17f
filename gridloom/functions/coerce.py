"""Cell coercion for imports: a value, and a reason when there is none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import dates
from gridloom.functions.cells import BOOLEAN, DATETIME, NUMBER, TEXT, Cell, cells_of
from gridloom.functions.numbers import round_half_up, with_numbers, without_spaces
from gridloom.functions.stages import staged
from gridloom.functions.text import literal_key, normalize_text, quoted

# Words read as true and false once normalized.
TRUE_WORDS = ("true", "si", "yes", "verdadero", "1", "x")
FALSE_WORDS = ("false", "no", "falso", "0", "")
# The reasons given for a cell. %s is the field, then the quoted cell.
MISSING = 'Falta "%s", que es obligatorio.'
NOT_A_NUMBER = '"%s" no es un numero.'
NOT_AN_INTEGER = '"%s" deberia ser un numero entero, y trae "%s".'
NOT_A_DECIMAL = '"%s" deberia ser un numero, y trae "%s".'
NOT_A_BOOLEAN = '"%s" deberia ser si o no, y trae "%s".'
NOT_A_DATE = '"%s" deberia ser una fecha, y trae "%s".'
NO_SUCH_DATE = '"%s" tiene una fecha que no existe: "%s".'
NOT_AN_OPTION = '"%s" no admite el valor "%s". Valores posibles: %s.'
NOT_STORED = "No pudimos guardar esta fila."
# Fixed value: options listed in a message.
OPTIONS_IN_MESSAGE = 8

SPARK_TYPES: dict[str, T.DataType] = {
    "text": T.StringType(),
    "integer": T.LongType(),
    "decimal": T.DecimalType(18, 4),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
    "email": T.StringType(),
    "phone": T.StringType(),
    "select": T.StringType(),
    "relation": T.StringType(),
}
_INTEGER = r"^[+-]?[0-9]+\z"


@dataclass(frozen=True)
class Coerced:
    """Names of the columns with the value of a field and the reason it has none."""

    value: str
    reason: str


@dataclass(frozen=True)
class Target:
    """How to read one source column: the field's name, type and rules."""

    source: str
    type: str
    label: str
    required: bool = False
    options: Sequence[str] = ()


@dataclass(frozen=True)
class _Rule:
    """A value per kind of cell, and the reason for a filled cell without a value."""

    values: dict[str, Column]
    reason: Column


def message(template: str, label: str, text: Column | None = None) -> Column:
    """A reason that names the field and quotes the cell."""
    parts = template.split("%s")
    if text is None:
        return F.lit(parts[0] + label + parts[1])
    return F.concat(F.lit(parts[0] + label + parts[1]), quoted(text), F.lit(parts[2]))


def coerce(
    df: DataFrame, targets: Mapping[str, Target], cells: Mapping[str, Cell] | None = None
) -> tuple[DataFrame, dict[str, Coerced]]:
    """Add a value and a reason column per target to ``df``.

    Text, parsed number, value and reason are separate steps, each read by the next, so the
    plan stays proportional to the number of fields.
    """
    cells = cells or cells_of(df, sorted({t.source for t in targets.values()}))
    source = {name: cells[t.source] for name, t in targets.items()}
    df = df.withColumns({f"__text_{n}": source[n].text for n in targets})
    # From here on the text is a column that is already there.
    cell = {n: replace(source[n], text=F.col(f"__text_{n}"), no_words=None) for n in targets}
    numeric = {n: cell[n] for n, t in targets.items() if t.type in ("integer", "decimal")}
    # White space inside a number goes with all else that is no part of one.
    df = with_numbers(
        df, {f"__number_{n}": c.text_unless(NUMBER) for n, c in numeric.items() if c.may_be(TEXT)}
    )
    words = {n: cell[n].text_unless(BOOLEAN, NUMBER) for n, t in targets.items() if t.type == "boolean"}
    words |= {n: cell[n].text for n, t in targets.items() if t.type == "select"}
    df = df.withColumns({f"__word_{n}": normalize_text(text) for n, text in words.items()})
    rules = {n: _RULES[t.type](cell[n], n, t) for n, t in targets.items()}
    df = df.withColumns(
        {
            f"__value_{n}": F.when(~cell[n].blank, cell[n].branch(rules[n].values)).cast(
                SPARK_TYPES[t.type]
            )
            for n, t in targets.items()
        }
    )
    none = F.lit(None).cast("string")
    df = df.withColumns(
        {
            f"__reason_{n}": F.when(
                F.col(f"__value_{n}").isNull(),
                F.when(cell[n].blank, message(MISSING, t.label) if t.required else none).otherwise(
                    rules[n].reason
                ),
            )
            for n, t in targets.items()
        }
    )
    helpers = [f"__{h}_{n}" for n in targets for h in ("text", "number", "word")]
    names = {n: Coerced(f"__value_{n}", f"__reason_{n}") for n in targets}
    return staged(df.drop(*helpers)), names


def _text(cell: Cell, name: str, target: Target) -> _Rule:
    return _Rule({TEXT: cell.text}, F.lit(None).cast("string"))


def _integer(cell: Cell, name: str, target: Target) -> _Rule:
    values, reasons = {}, {TEXT: F.lit(NOT_STORED)}
    if cell.may_be(TEXT):
        number = F.col(f"__number_{name}")
        tight = without_spaces(cell.text)
        whole = tight.rlike(_INTEGER)
        values[TEXT] = F.when(whole, tight.try_cast("bigint")).otherwise(round_half_up(number))
        reasons[TEXT] = F.when(
            ~whole & number.isNull(), message(NOT_AN_INTEGER, target.label, cell.text)
        ).otherwise(F.lit(NOT_STORED))
    if cell.number is not None:
        exact = cell.number.try_cast("bigint")
        values[NUMBER] = F.when(exact == cell.number, exact).otherwise(
            round_half_up(cell.number.cast("double"))
        )
        reasons[NUMBER] = _number_reason(cell, target.label)
    return _Rule(values, cell.branch(reasons))


def _decimal(cell: Cell, name: str, target: Target) -> _Rule:
    values, reasons = {}, {TEXT: F.lit(NOT_STORED)}
    if cell.may_be(TEXT):
        number = F.col(f"__number_{name}")
        values[TEXT] = number.try_cast("decimal(18,4)")
        reasons[TEXT] = F.when(
            number.isNull(), message(NOT_A_DECIMAL, target.label, cell.text)
        ).otherwise(F.lit(NOT_STORED))
    if cell.number is not None:
        values[NUMBER] = cell.number.try_cast("decimal(18,4)")
        reasons[NUMBER] = _number_reason(cell, target.label)
    return _Rule(values, cell.branch(reasons))


def _number_reason(cell: Cell, label: str) -> Column:
    number = cell.number.cast("double")
    infinite = F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(infinite, message(NOT_A_NUMBER, label)).otherwise(F.lit(NOT_STORED))


def _boolean(cell: Cell, name: str, target: Target) -> _Rule:
    word = F.col(f"__word_{name}")
    values = {TEXT: F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)}
    if cell.flag is not None:
        values[BOOLEAN] = cell.flag
    if cell.number is not None:
        values[NUMBER] = cell.number != 0
    return _Rule(values, message(NOT_A_BOOLEAN, target.label, cell.text))


def _date(cell: Cell, name: str, target: Target) -> _Rule:
    values = {TEXT: F.coalesce(dates.iso_date(cell.text), dates.day_first(cell.text))}
    if cell.time is not None:
        values[DATETIME] = cell.time.cast("date")
    return _Rule(values, _date_reason(cell, target.label))


def _datetime(cell: Cell, name: str, target: Target) -> _Rule:
    local = dates.midnight(dates.day_first(cell.text))
    values = {TEXT: F.coalesce(dates.iso_instant(cell.text), local)}
    if cell.time is not None:
        values[DATETIME] = F.concat(cell.time.cast("string"), F.lit("Z")).cast("timestamp")
    return _Rule(values, _date_reason(cell, target.label))


def _date_reason(cell: Cell, label: str) -> Column:
    return F.when(
        cell.text.rlike(dates.DAY_FIRST), message(NO_SUCH_DATE, label, cell.text)
    ).otherwise(message(NOT_A_DATE, label, cell.text))


def _select(cell: Cell, name: str, target: Target) -> _Rule:
    options = target.options
    if not options:
        return _text(cell, name, target)
    listed = {literal_key(option): option for option in reversed(options)}
    word = F.col(f"__word_{name}")
    value = F.coalesce(*[F.when(word == key, option) for key, option in listed.items()])
    parts = NOT_AN_OPTION.split("%s")
    reason = F.concat(
        F.lit(parts[0] + target.label + parts[1]),
        quoted(cell.text),
        F.lit(parts[2] + ", ".join(options[:OPTIONS_IN_MESSAGE]) + parts[3]),
    )
    return _Rule({TEXT: value}, reason)


_RULES = {
    "text": _text,
    "email": _text,
    "phone": _text,
    "integer": _integer,
    "decimal": _decimal,
    "boolean": _boolean,
    "select": _select,
    "date": _date,
    "datetime": _datetime,
}
