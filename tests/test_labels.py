"""Column names that would break a query if they were ever part of one."""

from gridloom.functions.cells import column
from gridloom.operators import entities as E
from gridloom.operators.profile import profile_table, recovered_options
from gridloom.plans.autotype import auto_model

NAMES = [
    "a.b", "x`y", 'Robert"); DROP TABLE clientes; --', "select", "Año ñandú", "col*", "$1", "[0]",
    "c0", "position", "cell", "row number", "tab\there", "comilla'simple", "%s", "{x}", "back\\slash",
    "emoji 😀",
]


def test_hostile_names(spark):
    rows = [(i, *[f"v{i % 3}"] * len(NAMES)) for i in range(12)]
    df = spark.createDataFrame(rows, ["row", *NAMES])
    profile = profile_table(df, "t", "row")
    found = {r.column: (r.total, r.distinct, r.samples) for r in profile.collect()}
    assert found == {name: (12, 3, ["v0", "v1", "v2"]) for name in NAMES}
    assert recovered_options(df, "t", "row").count() == len(NAMES)
    entity = auto_model(profile, "t")
    assert [f.source for f in entity.fields] == NAMES
    records = E.kept(E.import_entity(df, entity, "row"))
    assert records.count() == 12
    assert df.select(column("a.b")).first()[0] == "v0"
