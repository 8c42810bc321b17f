"""Whole imports from workbook files, with the numbers that they must give."""

from datetime import datetime

from pyspark.sql import functions as F

from gridloom.catalog.xlsx_writer import workbook_bytes
from gridloom.operators import headers as H
from gridloom.plans.importer import Table, run_import
from gridloom.plans.model import Entity, Field, Model
from gridloom.sources import workbook as W

PEOPLE = [("Puerto Azul", "1790000000001", "Loja"), ("Casa Verde", "0990000000002", "Ambato"),
          ("Monte Claro", "0190000000003", "Ibarra"), ("Faro Largo", "1390000000004", "Machala")]
CARS = ["AAA-1111", "BBB-2222", "CCC-3333", "DDD-4444"]
DRIVERS = ["Eva Sol", "Ivo Luz", "Noa Mar", "Leo Paz"]


def demo_workbook():
    """122 trips in messy spellings, two of them bad; four clients; an empty sheet."""
    trips = [["Fecha", "Cliente", "RUC", "Vehiculo", "Conductor", "Valor", "Estado"]]
    for i in range(120):
        name, ruc, _ = PEOPLE[i % 4]
        shown = name.upper() if i % 4 == 0 else f"  {name}  " if i % 7 == 0 else name
        trips.append([f"{i % 28 + 1:02d}/09/26", shown, ruc, CARS[i % 4], DRIVERS[i % 4], 200 + i % 45 * 10, ("Abierto", "Cerrado")[i % 2]])
    trips.append(["pendiente", PEOPLE[0][0], PEOPLE[0][1], CARS[0], DRIVERS[0], 300, "Abierto"])
    trips.append(["29/09/26", PEOPLE[1][0], PEOPLE[1][1], CARS[1], DRIVERS[1], "por definir", "Cerrado"])
    people = [["Cliente", "RUC", "Ciudad"], *map(list, PEOPLE)]
    return {"Viajes": trips, "Clientes": people, "Notas": []}


def tables_of(spark, path):
    """The sheets of a workbook with a header, as tables by name."""
    grid = W.sheet_rows(W.read_workbooks(spark, path))
    named = H.headers(grid, H.sheet_facts(grid))
    rows = H.data_rows(grid, named)
    found = named.join(grid.select(*H.SHEET, "sheet_name").distinct(), H.SHEET).collect()
    return {
        r.sheet_name: Table(H.sheet_table(rows, r.names, r.file, r.sheet_index), "row_number", r.sheet_name, r.sheet_index) for r in found
    }


def test_golden_import(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "demo.xlsx").write_bytes(workbook_bytes(demo_workbook()))
    model = Model((
        Entity("clientes", "Clientes", (Field("cliente", source="Cliente"), Field("ruc", source="RUC"), Field("ciudad", source="Ciudad")),
               display="cliente", dedupe="cliente"),
        Entity("vehiculos", "Viajes", (Field("placa", source="Vehiculo"),), display="placa", dedupe="placa", derived=True),
        Entity("conductores", "Viajes", (Field("nombre", source="Conductor"),), display="nombre", dedupe="nombre", derived=True),
        Entity("viajes", "Viajes",
               (Field("fecha", "date", "Fecha", required=True), Field("cliente", "relation", "Cliente", target="clientes"),
                Field("vehiculo", "relation", "Vehiculo", target="vehiculos"),
                Field("conductor", "relation", "Conductor", target="conductores"), Field("valor", "decimal", "Valor"),
                Field("estado", "select", "Estado", options=("Abierto", "Cerrado"))), display="fecha"),
    ))
    tables = tables_of(spark, str(tmp_path / "in"))
    assert set(tables) == {"Viajes", "Clientes"}
    done = run_import(spark, model, tables, str(tmp_path / "out"), datetime(2026, 1, 1))
    assert done.summary().first().asDict() == {
        "modules": 4, "records": 132, "relations": 3, "failed_rows": 2, "blank_key_rows": 0}
    assert {e.name: done.records(e.name).count() for e in model.entities} == {
        "clientes": 4, "vehiculos": 4, "conductores": 4, "viajes": 120}
    failed = done.failures().orderBy("row_number").collect()
    assert [(r.sheet, r.row_number) for r in failed] == [("Viajes", 122), ("Viajes", 123)]
    assert "fecha" in failed[0].reason and "numero" in failed[1].reason
    trips = done.records("viajes").join(
        done.records("clientes").select(F.col("id").alias("cliente"), "ruc", "ciudad"), "cliente"
    ).orderBy("__source.row").collect()
    assert [(r.ruc, r.ciudad) for r in trips] == [PEOPLE[i % 4][1:] for i in range(120)]


def test_volume_import(spark, tmp_path):
    """50,000 rows and 400 clients: every row finds its client."""
    rows = [["Fecha", "Cliente", "Vehiculo", "Valor"]]
    for i in range(50_000):
        rows.append([f"{i % 28 + 1:02d}/09/26", f"{'CLIENTE' if i % 3 == 0 else 'Cliente'} {i % 400}", f"V-{i % 50}", i % 100 * 10])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "grande.xlsx").write_bytes(workbook_bytes({"Viajes": rows}))
    model = Model((
        Entity("clientes", "Viajes", (Field("nombre", source="Cliente"),), display="nombre", dedupe="nombre", derived=True),
        Entity("viajes", "Viajes", (Field("fecha", "date", "Fecha"), Field("cliente", "relation", "Cliente", target="clientes"),
                                    Field("valor", "decimal", "Valor")), display="fecha"),
    ))
    done = run_import(spark, model, tables_of(spark, str(tmp_path / "in")), str(tmp_path / "out"), datetime(2026, 1, 1))
    assert done.summary().first().asDict() == {
        "modules": 2, "records": 50_400, "relations": 1, "failed_rows": 0, "blank_key_rows": 0}
    trips, clients = done.records("viajes"), done.records("clientes")
    assert trips.where("cliente is null").count() == 0
    assert trips.join(clients.select(F.col("id").alias("cliente")), "cliente", "left_semi").count() == 50_000
