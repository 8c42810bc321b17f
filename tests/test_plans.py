"""What the plans of registered queries must hold, and steps that only large tables need."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridloom.catalog import REGISTERED
from gridloom.operators import changes as C
from gridloom.operators import entities as E
from gridloom.plans.model import ID, KEY, Entity, Field

FOLDER = Path("/root/testdata/sf0.001")
SOURCED = "id string, nombre string, codigo string, __dedupe_key string, __source struct<sheet:int,row:bigint>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["derive_entity", "derive_by_code", "derive_after_failures", "append_conflict", "batch_patch", "link_by_name_or_code"],
)
def test_first_rows_are_found_without_sorting(spark, name):
    if not FOLDER.exists():
        pytest.skip("no test data")
    plan = plan_of(REGISTERED[name][0](spark, str(FOLDER)))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_packed_orders_like_its_parts(spark):
    most = 2**E.PART - 1
    rows = [(a, b, c) for a in (0, 1) for b in (0, 7, most) for c in (0, 5, most)]
    frame = spark.createDataFrame(rows[::-1], "a int, b bigint, c bigint")
    got = frame.orderBy(E.packed(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == rows


def test_append_takes_the_first_of_rows_that_share_a_source_row(spark):
    records = [("a", "x", "1", "x", (0, 4)), ("b", "X", "2", "x", (0, 4)), ("c", "y", "3", "y", None), ("d", "Y", "4", "y", (0, 1)),
               ("e", "z", "5", "z", (0, 2)), ("f", "z", "6", None, (0, 3)), ("g", "z", "7", None, (0, 9))]
    batch = spark.createDataFrame(records, SOURCED)
    existing = spark.createDataFrame([("z",)], f"{KEY} string")
    got = {r[KEY]: r.id for r in E.append_new(existing, batch).collect()}
    assert got.pop("x") in ("a", "b") and got == {"y": "c", None: "f"}


def test_lookup_of_equal_rows_gives_one_id_per_key(spark):
    people = Entity("p", "t", (Field("nombre", source="N"), Field("codigo", source="C")), display="nombre", dedupe="codigo")
    records = [("i1", "Ana", "k1", "k1", None), ("i2", "ana", "k2", "k2", None), ("i3", "k1", "k3", "k3", (0, 9)), ("i4", None, "K2", None, (1, 1))]
    found = E.lookup(people, spark.createDataFrame(records, SOURCED)).collect()
    got = {r.key: r.id for r in found}
    assert len(got) == len(found) and got["ana"] in ("i1", "i2")
    # The display value wins over the code; of equal codes the lower row.
    assert got["k1"] == "i3" and got["k2"] == "i2" and got["k3"] == "i3"


def test_blank_relations_of_a_batch_are_spread(spark):
    thing = Entity("cosas", "t", (Field("nombre"), Field("padre", "relation", target="cosas")), display="nombre")
    rows = [(i, f"n{i}", None if i % 10 else "here" if i % 20 else "gone") for i in range(4000)]
    batch = spark.createDataFrame(rows, "request bigint, nombre string, padre string")
    records = spark.createDataFrame([("here", "x")], "id string, nombre string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        made = C.create_records(batch, thing, "lote", {"cosas": records}).select("request", "reason")
        largest = made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        reasons = {r.request: r.reason for r in made.collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert largest < 1500
    assert {k for k, v in reasons.items() if v == C.MISSING_TARGET} == set(range(0, 4000, 20))


def test_later_patches_of_a_field_win_and_clear(spark):
    thing = Entity("cosas", "t", (Field("nombre"), Field("n", "integer")), display="nombre")
    records = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], f"{ID} string, nombre string, n bigint")
    patches = spark.createDataFrame(
        [(3, "a", ["nombre"], None, "9"), (1, "a", ["nombre", "n"], "first", "5"), (2, "a", ["n"], "not set", None), (4, "b", [], "q", "7")],
        "request bigint, id string, set array<string>, nombre string, n string",
    )
    changed = C.with_patched(records, C.patch_requests(patches, records, thing), thing)
    assert {tuple(r) for r in changed.collect()} == {("a", None, None), ("b", "y", 2)}


def test_sorting_by_label_moves_numbers_only(spark):
    from gridloom.operators import listing as L

    thing = Entity("cosas", "t", (Field("nombre"), Field("nota"), Field("padre", "relation", target="cosas")), display="nombre")
    rows = [(f"{i:04d}", f"n{i % 17}" if i % 5 else None, "x" * 50, f"{i % 300:04d}" if i % 3 else None) for i in range(600)]
    records = spark.createDataFrame(rows, "id string, nombre string, nota string, padre string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        keyed = L._with_code(records.select("id", "padre"), "padre", thing, records)
        for line in plan_of(keyed).splitlines():
            assert "Exchange" not in line or "nota" not in line
        assert dict(keyed.dtypes)["__sort"] == "bigint"
        names = {r[0]: r[1] for r in rows}
        for descending in (False, True):
            expected = sorted(rows)
            expected.sort(key=lambda r: names.get(r[3]) or "", reverse=descending)
            expected.sort(key=lambda r: names.get(r[3]) is None)
            for offset, deep in ((0, L.DEEP), (250, L.DEEP), (250, 0)):
                page = L.list_page(records, thing, {"cosas": (thing, records)}, "padre", descending, 40, offset, deep)
                assert [r.id for r in page.collect()] == [r[0] for r in expected[offset : offset + 40]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
