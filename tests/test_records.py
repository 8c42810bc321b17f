"""Lists and batches of changes, against plain Python."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.functions.strict import with_strict
from gridloom.operators import changes as C
from gridloom.operators import listing as L
from gridloom.plans.model import Entity, Field

THING = Entity("cosas", "t", (Field("nombre", required=True), Field("n", "integer"),
                              Field("padre", "relation", target="cosas")), display="nombre")


@pytest.fixture(scope="module")
def things(spark):
    return spark.createDataFrame(
        [(f"{i:04d}", None if i % 7 == 0 else f"n{i % 13}", i % 5, f"{i % 3:04d}") for i in range(500)],
        "id string, nombre string, n bigint, padre string").persist()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("offset", [0, 77, 490])
def test_pages_match_a_full_sort(spark, things, descending, offset):
    rows = sorted(things.collect(), key=lambda r: r.id)
    rows.sort(key=lambda r: r.nombre or "", reverse=descending)
    rows.sort(key=lambda r: r.nombre is None)
    expected = [r.id for r in rows[offset:offset + 25]]
    targets = {"cosas": (THING, things)}
    for deep in (L.DEEP, 0):
        page = L.list_page(things, THING, targets, None, descending, 25, offset, deep).collect()
        assert [r.id for r in page] == expected
    names = {r.id: r.nombre for r in rows}
    assert all(r.__getitem__("__rel_padre") == names[r.padre] for r in page)


def test_sort_by_relation_uses_the_label(spark, things):
    page = L.list_page(things, THING, {"cosas": (THING, things)}, "padre", limit=100).collect()
    labels = [r["__rel_padre"] for r in page]
    assert labels == sorted(labels)


def test_page_limits(things):
    with pytest.raises(ValueError):
        L.list_page(things, THING, limit=101)
    with pytest.raises(ValueError):
        L.picker_options(things, THING, limit=51)


def test_search_wildcards_and_accents(spark):
    df = spark.createDataFrame([("1", "Café"), ("2", "cafe"), ("3", "100%"), ("4", "1000")],
                               "id string, nombre string")
    entity = Entity("x", "t", (Field("nombre"),), display="nombre")

    def ids(text):
        return sorted(r.id for r in L.search(df, entity, text).collect())

    assert ids("CAFÉ") == ["1"] and ids("caf_") == ["1", "2"]
    assert ids("100%") == ["3", "4"] and ids(r"100\%") == ["3"]
    assert ids(r"c\afe") == ["2"] and ids("") == ["1", "2", "3", "4"]


def test_search_reads_all_text_columns():
    fields = tuple(Field(f"f{i}") for i in range(12)) + (Field("n", "integer"),)
    assert L.search_columns(Entity("x", "t", fields, display="n")) == ["n"] + [f"f{i}" for i in range(12)]


def strict(spark, field, value, schema="string"):
    df = spark.createDataFrame([(value,)], f"v {schema}")
    row = with_strict(df, [field]).first()
    return row[f"__value_{field.name}"], row[f"__reason_{field.name}"]


def test_strict_rules(spark):
    assert strict(spark, Field("v", "integer"), "1.234.567") == (1234567, None)
    assert strict(spark, Field("v", "integer"), "350.0") == (350, None)
    assert strict(spark, Field("v", "integer"), "350,7")[1] == '"v" debe ser un numero entero.'
    assert strict(spark, Field("v", "decimal"), "")[1] == '"v" debe ser un numero.'
    assert strict(spark, Field("v", "date"), "01/09/2026")[1] == '"v" debe tener el formato AAAA-MM-DD.'
    assert strict(spark, Field("v", "date"), "2026-02-31")[1] == "Uno de los valores no tiene el formato esperado."
    assert strict(spark, Field("v", "datetime"), "2026-09-15T10:00:00+02:00")[0] == datetime(2026, 9, 15, 8)
    assert strict(spark, Field("v", "datetime"), "2026-09-15T10:00:00")[1] == '"v" debe ser una fecha con hora.'
    assert strict(spark, Field("v", "email"), "a.b@c.org") == ("a.b@c.org", None)
    assert strict(spark, Field("v", "email"), "a@b")[1] == '"v" no parece un correo valido.'
    assert strict(spark, Field("v", "phone"), "1" * 41)[1] == '"v" es demasiado largo.'
    assert strict(spark, Field("v", "text"), 5, "int")[1] == '"v" debe ser texto.'
    assert strict(spark, Field("v", "boolean"), "si")[1] == '"v" debe ser si o no.'
    assert strict(spark, Field("v", "boolean"), False, "boolean") == (False, None)
    assert strict(spark, Field("v", "select", options=("A", "B")), "a")[1] == '"v" admite: A, B.'
    assert strict(spark, Field("v"), None) == (None, None)
    assert strict(spark, Field("v", required=True), None)[1] == '"v" debe ser texto.'


def test_unknown_fields_are_refused(spark):
    batch = spark.createDataFrame([(1, "x")], "request int, otro string")
    with pytest.raises(ValueError):
        C.create_records(batch, THING, "b")


def test_create_patch_delete(spark, things):
    now = datetime(2026, 1, 1)
    batch = spark.createDataFrame([(1, "nuevo", "0001"), (2, "otro", "9999"), (3, None, None)],
                                  "request int, nombre string, padre string")
    made = C.create_records(batch, THING, "b", {"cosas": things}, now)
    reasons = {r.request: r.reason for r in made.collect()}
    assert reasons == {1: None, 2: C.MISSING_TARGET, 3: '"nombre" debe ser texto.'}
    assert C.with_created(things, made).count() == 501

    patches = spark.createDataFrame(
        [(1, "0001", ["n"], "7", None), (2, "0001", ["n"], "8", None), (3, "0002", ["nombre"], None, None),
         (4, "nope", ["n"], "1", None), (5, "0003", ["n", "zzz"], "1", None), (6, "0004", ["n"], None, None)],
        "request int, id string, set array<string>, n string, nombre string")
    checked = C.patch_requests(patches, things, THING)
    accepted = {r.request: r.reason for r in checked.collect()}
    assert accepted[1] is None and accepted[2] is None and accepted[6] is None
    assert accepted[3] == '"nombre" debe ser texto.' and accepted[4] == C.NO_RECORD
    assert accepted[5] == "Campo desconocido: zzz"
    after = {r.id: r.n for r in C.with_patched(things, checked, THING, now).collect()}
    assert after["0001"] == 8 and after["0004"] is None and after["0003"] == 3 and len(after) == 500

    ids = spark.createDataFrame([("0000",), ("0010",), ("0010",), ("nope",)], "id string")
    child = Entity("hijos", "t", THING.fields, display="nombre", label="Hijos")
    checked = C.delete_requests(ids, things, THING, [(child, THING.field("padre"), things)])
    reasons = {r.id: r.reason for r in checked.collect()}
    assert reasons == {"0000": C.IN_USE % "Hijos", "0010": None, "nope": C.NO_RECORD}
    left = C.without_deleted(things, checked)
    assert left.count() == 499 and left.where(F.col("id") == "0010").count() == 0
