"""Text keys, numbers, types and coercion of single cells."""

import hashlib
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridloom.functions.cells import number_text
from gridloom.functions.coerce import Target, coerce
from gridloom.functions.numbers import with_numbers
from gridloom.functions.text import header_key, literal_key, normalize_text, text_length
from gridloom.operators.profile import long_cells, profile_table, profiles, value_stats

KEYS = {
    "ACME": "acme",
    "  ACME  ": "acme",
    "Acmé": "acme",
    "Acmé": "acme",
    "Gestión  de\t flota": "gestion de flota",
    "Ñandú": "nandu",
    "　İstanbul﻿": "istanbul",
    "ACME SA": "acme sa",
    "한국": "한국",
    " ": "",
}


def test_normalized_keys(spark):
    df = spark.createDataFrame(list(KEYS.items()), "written string, expected string")
    for row in df.withColumn("key", normalize_text(F.col("written"))).collect():
        assert row.key == row.expected
        assert literal_key(row.written) == row.expected


def test_header_keys(spark):
    names = {"Email Cliente": "email_cliente", "EMAIL-CLIENTE": "email_cliente", " N° (2) ": "n_2",
             "###": ""}
    df = spark.createDataFrame(list(names.items()), "written string, expected string")
    for row in df.withColumn("key", header_key(F.col("written"))).collect():
        assert row.key == row.expected


def test_length_counts_utf16_units(spark):
    df = spark.createDataFrame([("abc", 3), ("ñandú", 5), ("a😀", 3)], "t string, n int")
    assert df.where(text_length(F.col("t")) != F.col("n")).count() == 0


NUMBERS = [
    ("1234.56", 1234.56), ("1234", 1234.0), ("0", 0.0), ("-5.5", -5.5), ("1.234,56", 1234.56),
    ("-5,5", -5.5), ("1.234.567,89", 1234567.89), ("1,234.56", 1234.56),
    ("1,234,567.89", 1234567.89), ("1 234,56", 1234.56), ("  42  ", 42.0),
    ("1.234.567", 1234567.0), ("1,234,567", 1234567.0), ("", None), ("abc", None), ("   ", None),
    ("1.234", 1.234), ("1,234", 1.234), ("12.345.678,90", 12345678.9), ("$ 1.234,56", 1234.56),
    ("1.234,56 USD", 1234.56), ("...", 0.0), ("5.", 5.0), (".5", 0.5), ("1,2.3,4", None),
    ("1.2,3.4", None), ("-", None), ("+-5", None), ("9" * 400, None), ("abc1", 1.0),
]


def test_human_numbers(spark):
    df = spark.createDataFrame(NUMBERS, "written string, expected double")
    for row in with_numbers(df, {"value": F.col("written")}).collect():
        assert row.value == row.expected, row.written


def test_text_of_numbers(spark):
    cases = {350.0: "350", 12345678.5: "12345678.5", 1e-7: "1e-7", 1.5e-7: "1.5e-7", 1e21: "1e+21",
             0.1: "0.1", -0.0: "0", 0.000123: "0.000123", -2.5: "-2.5", 1e20: "100000000000000000000",
             float("nan"): "", float("inf"): ""}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, n double")
    rows = df.select("i", number_text(F.col("n")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == list(cases.values())


def run(spark, value, kind, schema="string", **rules):
    df = spark.createDataFrame([(value,)], f"v {schema}")
    rows, names = coerce(df, {"x": Target("v", kind, "Campo", **rules)})
    row = rows.first()
    return row[names["x"].value], row[names["x"].reason]


@pytest.mark.parametrize(
    "value, kind, expected",
    [
        (" 350 ", "integer", 350), ("-12", "integer", -12), ("350,4", "integer", 350),
        ("2,5", "integer", 3), ("-2,5", "integer", -2), ("$ 1.500,00", "decimal", 1500),
        ("si", "boolean", True), ("Sí", "boolean", True), ("x", "boolean", True),
        ("FALSE", "boolean", False), ("0", "boolean", False),
        ("2026-09-15", "date", date(2026, 9, 15)), ("01/09/26", "date", date(2026, 9, 1)),
        ("15-9-2026", "date", date(2026, 9, 15)), ("15.09.2026", "date", date(2026, 9, 15)),
        ("2026-09-15T23:30:00-05:00", "date", date(2026, 9, 15)),
        ("2026-09-15 14:30", "datetime", datetime(2026, 9, 15, 14, 30)),
        ("2026-09-15T14:30:00.250Z", "datetime", datetime(2026, 9, 15, 14, 30, 0, 250000)),
        ("  ACME  ", "text", "ACME"), ("no-es-un-correo", "email", "no-es-un-correo"),
        ("   ", "integer", None), ("", "text", None),
    ],
)
def test_coercion(spark, value, kind, expected):
    assert run(spark, value, kind) == (expected, None)


@pytest.mark.parametrize(
    "value, kind, reason",
    [
        ("pendiente", "integer", '"Campo" deberia ser un numero entero, y trae "pendiente".'),
        ("pendiente", "decimal", '"Campo" deberia ser un numero, y trae "pendiente".'),
        ("quiza", "boolean", '"Campo" deberia ser si o no, y trae "quiza".'),
        ("31/02/2026", "date", '"Campo" tiene una fecha que no existe: "31/02/2026".'),
        ("45/13/2026", "date", '"Campo" tiene una fecha que no existe: "45/13/2026".'),
        ("2026-02-31", "date", '"Campo" deberia ser una fecha, y trae "2026-02-31".'),
        ("2026-09-15 nunca", "date", '"Campo" deberia ser una fecha, y trae "2026-09-15 nunca".'),
        ("x" * 200, "integer", f'"Campo" deberia ser un numero entero, y trae "{"x" * 40}...".'),
        ("123456789012345", "decimal", "No pudimos guardar esta fila."),
        ("9" * 30, "integer", "No pudimos guardar esta fila."),
    ],
)
def test_refusals(spark, value, kind, reason):
    assert run(spark, value, kind) == (None, reason)


def test_required_and_options(spark):
    assert run(spark, " ", "text", required=True)[1] == 'Falta "Campo", que es obligatorio.'
    options = ("Abierto", "Cerrado")
    assert run(spark, "  CERRADO ", "select", options=options) == ("Cerrado", None)
    assert run(spark, "abiértó", "select", options=options) == ("Abierto", None)
    assert run(spark, "Pendiente", "select", options=options)[1] == (
        '"Campo" no admite el valor "Pendiente". Valores posibles: Abierto, Cerrado.'
    )


def test_typed_cells(spark):
    assert run(spark, 350.4, "integer", "double") == (350, None)
    assert run(spark, -2.5, "integer", "double") == (-2, None)
    assert run(spark, 3.0, "boolean", "double") == (True, None)
    assert run(spark, float("inf"), "decimal", "double")[1] == '"Campo" no es un numero.'
    assert run(spark, True, "text", "boolean") == ("true", None)
    assert run(spark, datetime(2026, 9, 15, 10), "date", "timestamp_ntz")[0] == date(2026, 9, 15)
    assert run(spark, date(2026, 9, 15), "datetime", "date")[0] == datetime(2026, 9, 15)


def test_profile_of_a_column(spark):
    values = ["ACME", "ACME", None, "NORTE", "  acme  ", ""]
    df = spark.createDataFrame(list(enumerate(values)), "row int, Cliente string")
    row = profile_table(df, "t", "row").first()
    assert (row.total, row.empty, row.distinct, row.samples) == (6, 2, 2, ["ACME", "NORTE"])
    assert row.type == "text" and not row.repeats and not row.identifying


def column_type(spark, values, header="Dato", schema="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"row int, `{header}` {schema}")
    row = profiles(value_stats(long_cells(df, "t", "row"))).first()
    return row.type


def test_type_votes(spark):
    assert column_type(spark, ["1", "2", "30"]) == "integer"
    assert column_type(spark, ["1,5", "2.25", "3"]) == "decimal"
    assert column_type(spark, ["si", "no", "x"]) == "boolean"
    assert column_type(spark, ["15/09/2026", "1-1-26"]) == "date"
    assert column_type(spark, ["2026-09-15T10:00", "2026-09-15 11:30:00"]) == "datetime"
    assert column_type(spark, ["a@b.co", "C@D.ORG"]) == "email"
    assert column_type(spark, ["+593 99 123 4567", "02 234-5678"]) == "phone"
    assert column_type(spark, ["099123456", "099123457"]) == "text"
    assert column_type(spark, ["0.5", "-0.25", "0"]) == "decimal"
    assert column_type(spark, ["007", "1", "2", "3"]) == "text"
    # 19 of 20 is enough, 17 of 20 is not.
    assert column_type(spark, ["5"] * 19 + ["n/d"]) == "integer"
    assert column_type(spark, ["5"] * 17 + ["n/d"] * 3) == "text"
    assert column_type(spark, [None, " "]) == "text"
    assert column_type(spark, [1.0, 2.0], schema="double") == "integer"
    assert column_type(spark, [datetime(2026, 1, 1), datetime(2026, 1, 2, 5)], schema="timestamp_ntz") == "datetime"
    # The header breaks a tie between types that fit, and imposes nothing.
    assert column_type(spark, ["1-1-2026", "2-1-2026"], "Fecha de alta") == "date"
    assert column_type(spark, ["12,5", "13,5"], "Telefono") == "decimal"


def test_key_signals(spark):
    df = spark.createDataFrame(
        [(i, f"A-{i}", f"c{i % 8}", None) for i in range(80)],
        "row int, `Código` string, Cliente string, vacia string",
    )
    rows = {r.column: r for r in profiles(value_stats(long_cells(df, "t", "row"))).collect()}
    assert rows["Código"].identity_candidate and rows["Código"].identifying
    assert rows["Cliente"].repeats and not rows["Cliente"].identifying
    assert rows["vacia"].ratio == 0 and not rows["vacia"].identifying


def test_text_beside_a_column_that_is_never_null_is_normalized(spark):
    rows = [(i, i, text) for i, text in enumerate(["ACME", " acme ", "Acmé", "norte", "01/02/2026", "  "])]
    schema = "row int not null, n bigint not null, cliente string not null"
    stats = value_stats(long_cells(spark.createDataFrame(rows, schema), "t", "row")).where("column = 'cliente'")
    got = {r.key: (r.n, r.first_row, r.max_len, r.n_date) for r in stats.collect()}
    assert got == {"acme": (3, 0, 4, 0), "norte": (1, 3, 5, 0), "01/02/2026": (1, 4, 10, 1), None: (1, 5, None, 0)}


@pytest.mark.parametrize("digest", [False, True])
def test_stats_of_long_and_typed_values(spark, digest):
    long = "Palabra  y  más " * 40
    rows = [(0, long, Decimal("1.500"), 2.0, None, True, date(2026, 1, 2)), (1, long.upper() + " ", Decimal("1.5"), 2.5, 3, None, None),
            (2, " " * 400, Decimal("2.000"), float("nan"), 3, False, date(2026, 1, 2))]
    schema = "row int, largo string, d decimal(10,3), x double, w int, b boolean, f date"
    stats = value_stats(long_cells(spark.createDataFrame(rows, schema), "t", "row"), digest).collect()
    got = {}
    for r in stats:
        got.setdefault(r.column, {})[r.key] = (r.n, r.first_row, r.max_len)
    key = ("palabra y mas " * 40).strip()
    key = hashlib.sha256(key.encode()).hexdigest() if digest else key
    assert got["largo"] == {key: (2, 0, len(long.strip())), None: (1, 2, None)}
    assert got["d"] == {"1.5": (2, 0, 3), "2": (1, 2, 1)}
    assert got["x"] == {"2": (1, 0, 1), "2.5": (1, 1, 3), "": (1, 2, 0)} and got["w"] == {None: (1, 0, None), "3": (2, 1, 1)}
    assert got["b"] == {"true": (1, 0, 4), None: (1, 1, None), "false": (1, 2, 5)}
    assert got["f"] == {"2026-01-02t00:00:00.000z": (2, 0, 24), None: (1, 1, None)}
    whole = {r.key: r.n_integer for r in stats if r.column == "d"}
    assert whole == {"1.5": 0, "2": 1}


def test_large_tables_are_profiled_in_as_many_tasks_as_their_cells_need(spark, monkeypatch):
    """The sizes of shuffles left millions of values to a task, as alike values are packed to a few bits."""
    from gridloom.functions.cells import CELL_TYPE
    from gridloom.operators import headers, profile

    words = ["a", " A ", "á", None, "", "12", "x" * 400, "No"]
    rows = [(i if i % 5 else None, words[i % 8], i % 3 or None, {"k": i}) for i in range(300)] + [(1, "a", 1, {"k": 1})] * 40
    df = spark.createDataFrame(rows, "row int, t string, n int, m map<string,int>").withColumn("u", F.col("row") * 7)
    text = F.when(F.col("t").isNotNull(), F.struct(F.lit("text").alias("kind"), F.col("t").alias("s"), *[F.lit(None).cast(k).alias(c) for c, k in (("n", "double"), ("b", "boolean"), ("t", "timestamp_ntz"))]))
    grid = df.select(F.lit("f").alias("file"), F.lit(0).alias("sheet_index"), F.coalesce("row", F.lit(0)).cast("bigint").alias("row_index"),
                     F.lit(2).alias("columns"), F.array(text, text).cast(f"array<{CELL_TYPE.simpleString()}>").alias("cells"))
    named = spark.createDataFrame([("f", 0, ["p", "q"])], "file string, sheet_index int, names array<string>")

    def found():
        longs = [profile.long_cells(df, "t", "row", ["t", "n", "u", "row"]), headers.long_rows(grid, named)]
        stats = [profile.value_stats(long, digest) for long in longs for digest in (False, True)]
        sets = [profile.value_sets(long) for long in longs]
        tasks = [stats[0].rdd.getNumPartitions(), stats[1].rdd.getNumPartitions(), *[long.tasks for long in longs]]
        return [sorted(map(repr, frame.collect())) for frame in (*stats, *sets)], tasks

    whole, _ = found()
    monkeypatch.setattr(profile, "CELLS", 50)
    parts, tasks = found()
    assert parts == whole
    assert tasks == [28, 28, 28, 14]
