"""Entities, links, failures and summaries on small sheets."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.functions.dates import day_first
from gridloom.operators import entities as E
from gridloom.plans.importer import Table, plan_import, run_import
from gridloom.plans.model import SOURCE, Entity, Field, Model
from gridloom.session import small_methods
from gridloom.sources import report

CLIENTS = Entity(
    "clientes", "viajes", (Field("cliente", source="Cliente"), Field("ruc", source="RUC")),
    display="cliente", dedupe="cliente", derived=True,
)
TRIPS = Entity(
    "viajes", "viajes",
    (Field("fecha", "date", "Fecha"), Field("cliente", "relation", "Cliente", target="clientes"),
     Field("valor", "decimal", "Valor"),
     Field("estado", "select", "Estado", options=("Abierto", "Cerrado"))),
    display="fecha",
)
SCHEMA = "row int, Fecha string, Cliente string, RUC string, Valor string, Estado string"


def trips(spark, rows):
    return {"viajes": Table(spark.createDataFrame(
        [(i + 2, *row) for i, row in enumerate(rows)], SCHEMA), "row", "Viajes")}


def test_spellings_give_two_clients(spark):
    names = ["ACME", "acme", "  ACME  ", "Acmé", "NORTE"]
    done = plan_import(Model((CLIENTS, TRIPS)),
                       trips(spark, [("01/09/26", n, "1", "10", "Abierto") for n in names]))
    clients = {r.cliente for r in done.records("clientes").collect()}
    assert clients == {"ACME", "NORTE"}
    links = [r.cliente for r in done.records("viajes").orderBy(f"{SOURCE}.row").collect()]
    assert len(set(links[:4])) == 1 and links[4] != links[0] and None not in links
    first = done.records("viajes").orderBy(f"{SOURCE}.row").first()
    assert first[SOURCE].asDict() == {"sheet": 0, "row": 2}


def test_same_name_two_codes(spark):
    by_code = Entity("clientes", "viajes", CLIENTS.fields, display="cliente", dedupe="ruc")
    rows = [("01/09/26", "ACME", "111" if i % 2 else "222", "1", "Abierto") for i in range(12)]
    done = plan_import(Model((by_code,)), trips(spark, rows))
    assert {r.ruc for r in done.records("clientes").collect()} == {"111", "222"}


def test_blank_key(spark):
    rows = [("01/09/26", "ACME", "1", "1", "Abierto")] * 10 + [("01/09/26", " ", None, "1", "Abierto")]
    done = plan_import(Model((CLIENTS, TRIPS)), trips(spark, rows))
    assert done.records("clientes").count() == 1
    assert done.records("viajes").count() == 11
    assert done.records("viajes").where("cliente is null").count() == 1
    assert done.summary().first().asDict() == {
        "modules": 2, "records": 12, "relations": 1, "failed_rows": 0, "blank_key_rows": 1}


def test_bad_cells_are_reported(spark, tmp_path):
    rows = [
        ("01/09/26", "ACME", "1", "10", "Abierto"),
        ("no es una fecha", "ACME", "1", "20", "Abierto"),
        ("03/09/26", "ACME", "1", "tampoco", "Abierto"),
        ("04/09/26", "ACME", "1", "40", "Inventado"),
        ("05/09/26", "ACME", "1", "50", "Cerrado"),
    ] + [("06/09/26", "ACME", "1", "10", "Abierto")] * 8
    model = Model((CLIENTS, TRIPS))
    done = run_import(spark, model, trips(spark, rows), str(tmp_path / "out"), datetime(2026, 1, 1))
    assert done.records("viajes").count() == 10
    failed = done.failures().orderBy("row_number").collect()
    assert [r.row_number for r in failed] == [3, 4, 5]
    assert failed[2].reason.endswith("Valores posibles: Abierto, Cerrado.")
    assert failed[1].raw[3] == "tampoco"
    assert done.summary().first().failed_rows == 3
    report.write_report(done.failures(), str(tmp_path / "report"))
    lines = next((tmp_path / "report").glob("*.csv")).read_text().splitlines()
    assert lines[0] == "Hoja,Fila,Modulo,Motivo" and len(lines) == 4
    assert lines[1].startswith("Viajes,3,viajes,")


def test_bad_first_row_does_not_claim_its_key(spark):
    strict = Entity("clientes", "viajes", (Field("cliente", source="Cliente"),
                                           Field("valor", "decimal", "Valor")),
                    display="cliente", dedupe="cliente")
    rows = [("x", "ACME", "1", "nada", "x"), ("x", "acme", "1", "7", "x"), ("x", "ACME", "1", "8", "x")]
    done = plan_import(Model((strict,)), trips(spark, rows))
    records = done.records("clientes").collect()
    assert [(r.cliente, int(r.valor), r[SOURCE].row) for r in records] == [("acme", 7, 3)]
    assert done.failures().count() == 1


def test_required_relation(spark):
    needed = Entity("viajes", "viajes",
                    (Field("cliente", "relation", "RUC", required=True, target="clientes"),
                     Field("fecha", source="Fecha"), Field("sin", required=True)), display="fecha")
    rows = [("01/09/26", "ACME", "ACME", "1", "x"), ("01/09/26", "ACME", "OTRO", "1", "x")]
    done = plan_import(Model((CLIENTS, needed)), trips(spark, rows))
    reasons = [r.reason for r in done.failures().orderBy("row_number").collect()]
    assert reasons == ["Falta un dato obligatorio en esta fila.",
                       'No encontramos "OTRO" entre los registros de cliente.']


def test_append_skips_known_keys(spark):
    def batch(rows):
        return E.kept(E.import_entity(
            spark.createDataFrame(rows, "row int, Cliente string, RUC string"), CLIENTS, "row"))

    existing = batch([(2, "ACME", "1")])
    fresh = E.append_new(existing, batch([(2, "acmé", "9"), (3, "NORTE", "2"), (4, "norte", "3")]))
    assert [(r.cliente, r.ruc) for r in fresh.collect()] == [("NORTE", "2")]


def test_hot_and_blank_keys_resolve(spark):
    """A third of the rows share a key, a third have none."""
    rows = spark.range(9000).select(
        (F.col("id") + 2).cast("int").alias("row"), F.lit("01/09/26").alias("Fecha"),
        F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 3 == 1, " ")
        .otherwise(F.concat(F.lit("C"), (F.col("id") % 500).cast("string"))).alias("Cliente"),
        F.lit("1").alias("RUC"), F.lit("1").alias("Valor"), F.lit("Abierto").alias("Estado"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = plan_import(Model((CLIENTS, TRIPS)), {"viajes": Table(rows, "row")})
        linked = done.records("viajes").groupBy(F.col("cliente").isNull().alias("none")).count()
        assert {r.none: r["count"] for r in linked.collect()} == {True: 3000, False: 6000}
        assert done.records("clientes").count() == 501
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_model_rules():
    import pytest

    with pytest.raises(ValueError):
        Entity("a", "t", (Field("x"),), display="x", dedupe="x")
    with pytest.raises(ValueError):
        Field("x", "relation")
    with pytest.raises(KeyError):
        Entity("a", "t", (Field("x"),), display="y")
    ordered = [e.name for e in Model((TRIPS, CLIENTS)).ordered()]
    assert ordered == ["clientes", "viajes"]


def test_the_text_of_a_sheet_cell_is_built_once(spark):
    cell = "struct<kind:string,s:string,n:double,b:boolean,t:timestamp_ntz>"
    rows = [
        (1, ("text", " Ánfora ", None, None, None), ("number", None, 1234.5, None, None), ("boolean", None, None, True, None)),
        (2, ("number", None, 7.0, None, None), ("text", "1 234,5", None, None, None), ("text", " Sí ", None, None, None)),
        (3, None, ("boolean", None, None, True, None), ("number", None, 0.0, None, None)),
    ]
    df = spark.createDataFrame(rows, f"row long, name {cell}, amount {cell}, paid {cell}")
    entity = Entity("things", "t", (Field("name", source="name"), Field("amount", "decimal", "amount"),
                                    Field("paid", "boolean", "paid")), display="name", dedupe="name")
    outcome = E.import_entity(df, entity, "row")
    got = {r["__source"]["row"]: (r["name"], r["amount"] and float(r["amount"]), r["paid"], r["__dedupe_key"], r["__status"], r["__raw"])
           for r in outcome.collect()}
    assert got == {
        1: ("Ánfora", 1234.5, True, "anfora", "kept", None),
        2: ("7", 1234.5, True, "7", "kept", None),
        3: (None, None, False, None, "failed", ["", "true", "0"]),
    }
    # The text of a number has one such cast.
    plan = E.import_entity(df, replace(entity, dedupe=None), "row")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("decimal(38,22)") <= len(entity.fields)


def test_an_import_is_compiled_in_small_methods_and_leaves_the_session_as_it_was(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        with pytest.raises(KeyError), small_methods(spark):
            assert spark.conf.get(name) == "8000"
            raise KeyError
        assert spark.conf.get(name, None) is None
        spark.conf.set(name, "9000")
        with small_methods(spark):
            assert spark.conf.get(name) == "9000"
        assert spark.conf.get(name) == "9000"
    finally:
        spark.conf.set(name, before)


def test_full_dates_and_others(spark):
    written = ["15/09/2026", "15/9/26", "31/02/2026", "01.02.0026", "01-02-026", "01-02-0126", "1/2/2026x", "", None]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in written], "w string").select(day_first(F.col("w")).cast("string")).collect()]
    assert got == ["2026-09-15", "2026-09-15", None, "2026-02-01", "0026-02-01", "0126-02-01", None, None, None]
