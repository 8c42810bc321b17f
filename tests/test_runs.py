"""Change logs, key indexes and sorted copies against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import entities as E
from gridloom.operators.runs import ChangeLog, KeyIndex
from gridloom.operators.sort_index import write_index
from gridloom.plans.model import ID, KEY, Entity, Field

SCHEMA = "id string, nombre string, n bigint"
SOURCED = "id string, nombre string, __dedupe_key string, __source struct<sheet:int,row:bigint>"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fanout", [2, 3, 9])
def test_change_log_equals_a_dictionary(spark, fanout):
    rng = random.Random(fanout)
    held = {f"r{i}": ("start", i) for i in range(60)}
    log = ChangeLog(spark.createDataFrame([(k, *v) for k, v in held.items()], SCHEMA), fanout, buckets=4)
    for step in range(7):
        if step % 3 == 1:
            gone = rng.sample([f"r{i}" for i in range(90)], 15)
            log.delete(spark.createDataFrame([(k,) for k in [*gone, gone[0]]], "id string"))
            held = {k: v for k, v in held.items() if k not in gone}
        else:
            new = {f"r{rng.randrange(90)}": (f"s{step}", rng.choice((None, step))) for _ in range(20)}
            log.put(spark.createDataFrame([(k, *v) for k, v in new.items()], SCHEMA))
            held |= new
        assert {r.id: tuple(r)[1:] for r in log.read().collect()} == held
    wanted = spark.createDataFrame([("r1",), ("r2",), ("r70",), ("none",)], "id string")
    found = {r.id: tuple(r)[1:] for r in log.find(wanted).collect()}
    assert found == {k: held[k] for k in ("r1", "r2", "r70") if k in held}
    before = log.read().collect()
    log.compact()
    assert sorted(log.read().collect()) == sorted(before) and len(log.newest_first()) == 1
    # No marker is left once nothing is older.
    assert log.newest_first()[0].count() == len(held)
    log.drop()


def test_reading_a_log_moves_no_run(spark, no_broadcast):
    log = ChangeLog(spark.createDataFrame([(f"r{i}", "a", i) for i in range(40)], SCHEMA))
    log.put(spark.createDataFrame([("r1", "b", 0)], SCHEMA))
    log.delete(spark.createDataFrame([("r2",)], "id string"))
    assert "Exchange" not in plan_of(log.read())
    log.drop()


def batches_of(rng, count):
    rows = [(f"i{i}", f"n{i}", f"k{rng.randrange(50)}" if rng.random() < 0.9 else None, (0, i)) for i in range(count)]
    return [rows[i : i + count // 4] for i in range(0, count, count // 4)]


def test_appends_by_index_equal_one_append(spark):
    parts = batches_of(random.Random(4), 160)
    parts = [[r for r in part if r[2] is not None] for part in parts]
    index, got = KeyIndex(spark, fanout=2, buckets=4), []
    for part in parts:
        got += index.append(spark.createDataFrame(part, SOURCED)).collect()
    nothing = spark.createDataFrame([], f"{KEY} string")
    whole = E.append_new(nothing, spark.createDataFrame([r for part in parts for r in part], SOURCED)).collect()
    assert sorted(got) == sorted(whole) and len({r[KEY] for r in got}) == len(got)
    index.drop()


def test_appends_do_not_move_stored_keys(spark, no_broadcast):
    index = KeyIndex(spark)
    index.append(spark.createDataFrame([(f"i{i}", "n", f"k{i}", (0, i)) for i in range(50)], SOURCED))
    batch = E.first_order(spark.createDataFrame([("x", "n", "k1", (0, 1)), ("y", "n", "new", (0, 2))], SOURCED))
    plan = plan_of(index._without(E.first_rows(batch, KEY, "__order"), index.newest_first()))
    before, _, stored = plan.partition("SortMergeJoin")[2].partition("Scan parquet")
    assert stored and plan.count("Exchange") == 1
    fresh = index.append(spark.createDataFrame([("z", "n", None, (0, 1)), ("y", "n", "new", (0, 2)), ("w", "n", "k3", None)], SOURCED))
    assert {(r.id, r[KEY]) for r in fresh.collect()} == {("z", None), ("y", "new")}
    index.drop()


THING = Entity("cosas", "t", (Field("nombre"), Field("n", "integer"), Field("padre", "relation", target="cosas")), display="nombre")


@pytest.mark.parametrize("sort", ["nombre", "n", "padre"])
@pytest.mark.parametrize("descending", [False, True])
def test_all_pages_equal_the_full_sort(spark, tmp_path, sort, descending):
    rng = random.Random(3)
    rows = [(f"{i:04d}", rng.choice((None, "a", "b", f"x{i}")), rng.choice((None, 1, 2, i)), f"{rng.randrange(400):04d}") for i in range(330)]
    records = spark.createDataFrame(rows, "id string, nombre string, n bigint, padre string")
    names = {r[0]: r[1] for r in rows}
    value = {"nombre": lambda r: r[1], "n": lambda r: r[2], "padre": lambda r: names.get(r[3])}[sort]
    expected = sorted(rows)
    expected.sort(key=lambda r: value(r) or type(value(r))() if value(r) is not None else "" if sort != "n" else 0, reverse=descending)
    expected.sort(key=lambda r: value(r) is None)
    expected = [r[0] for r in expected]
    index = write_index(records, THING, str(tmp_path / "index"), sort, descending, {"cosas": (THING, records)}, parts=5)
    assert index.total == 330
    got, cursor = [r.id for r in index.page(100).collect()], None
    by_id = {r[0]: r for r in rows}
    while len(got) < 330:
        cursor = by_id[got[-1]]
        page = [r.id for r in index.after(value(cursor), cursor[0], 100).collect()]
        assert page
        got += page
    assert got == expected
    assert index.after(value(by_id[got[-1]]), got[-1]).count() == 0
    assert [r.id for r in index.page(40, 200).collect()] == expected[200:240]
    plan = plan_of(index.scan(200, 40))
    assert "Sort" not in plan and "Exchange" not in plan and "PushedFilters" in plan
    with pytest.raises(ValueError):
        index.page(101)


def test_an_index_of_nothing(spark, tmp_path):
    records = spark.createDataFrame([], "id string, nombre string, n bigint, padre string")
    index = write_index(records, THING, str(tmp_path / "none"))
    assert index.total == 0 and index.page().count() == 0 and index.after("a", "b").count() == 0


def test_dependencies_match_counted_pairs(spark):
    from gridloom.operators.dependencies import dependencies

    rng = random.Random(6)
    rows = [(rng.choice((" A", "a", "B", "c", None, "")), rng.choice(("x", "X ", "y", None)), rng.randrange(3)) for _ in range(60)]
    rows = [(k, v, n, "same" if k is None else k.strip().upper()) for k, v, n in rows]
    got = {(r.key, r.column): tuple(r)[2:] for r in dependencies(spark.createDataFrame(rows, "k string, v string, n int, s string"), ["k", "n"]).collect()}
    norm = lambda x: None if x is None or not str(x).strip() else str(x).strip().lower()
    names = ["k", "v", "n", "s"]
    for k, c in got:
        seen = {}
        for row in rows:
            a, b = norm(row[names.index(k)]), norm(row[names.index(c)])
            if a is not None and b is not None:
                seen.setdefault(a, []).append(b)
        repeated = [set(v) for v in seen.values() if len(v) > 1]
        fine = sum(len(v) == 1 for v in repeated)
        assert got[k, c] == (len(seen), sum(len(set(v)) for v in seen.values()), len(repeated), fine, 0 < len(repeated) == fine)
    assert len(got) == 6 and got["k", "s"][-1] and not got["k", "v"][-1]


def test_merged_statistics_equal_those_of_all_rows(spark):
    from gridloom.operators.profile import long_cells, merge_stats, value_stats

    rng = random.Random(2)
    rows = [(i, rng.choice(("a", "A ", "b", None, "12", "x" * 400)), rng.choice((1, 2, None))) for i in range(90)]
    stats = lambda part: value_stats(long_cells(spark.createDataFrame(part, "row int, t string, n int"), "t", "row"), digest=True)
    merged = merge_stats(stats(rows[50:]), stats(rows[:20]), stats(rows[20:50]))
    whole = stats(rows)
    assert sorted(map(repr, merged.select(whole.columns).collect())) == sorted(map(repr, whole.collect()))


def test_search_by_index_equals_search_and_skips_parts(spark, tmp_path):
    from gridloom.operators.listing import search
    from gridloom.operators.search_index import write_search_index

    rng = random.Random(9)
    words = ["Árbol", "casa_uno", "100% lana", "İstanbul", "mesa", "ALTO", "bajo", "c\\d"]
    rows = [(f"{i:03d}", f"{chr(97 + i % 26)}{rng.choice(words)} {i}" if i % 9 else None, i, None) for i in range(260)]
    rows.append(("999", "only Quetzal here", 1, None))
    records = spark.createDataFrame(rows, "id string, nombre string, n bigint, padre string")
    index = write_search_index(records, THING, str(tmp_path / "s"), parts=6)
    for text in ("quetzal", "ÁRBOL", "casa_u", "100\\%", "a%7", "ist", "c\\\\d", "zz", "", None, "nothing like it", "sa 2", "_lto", "İST", "i̇st"):
        got = sorted(r.id for r in index.search(text).collect())
        assert got == sorted(r.id for r in search(records, THING, text).collect()), text
    assert len(index.parts_with("quetzal")) == 1 and index.parts_with("nothing like it") == [] and index.parts_with("a%b") is None
    assert "PartitionFilters: [isnotnull(__part" in plan_of(index.search("quetzal"))
    empty = write_search_index(records.limit(0), THING, str(tmp_path / "e"))
    assert empty.search("quetzal").count() == 0


def test_a_long_text_is_indexed_in_one_pass(spark, tmp_path):
    """Taking pieces out of a text by position walked it once per piece: minutes for this one."""
    import time

    from gridloom.operators.search_index import GRAM, SLICE, write_search_index

    text = "".join(chr(97 + i * i % 23) for i in range(4 * SLICE))
    # One word lies across two slices, one ends the text and is outside the basic plane.
    text = text[: SLICE - 4] + "QUETZAL" + text[SLICE + 3 :] + "😀Ñandú"
    records = spark.createDataFrame([("1", text, 1), ("2", "zzz short", 2), ("3", None, 3)], "id string, nombre string, n bigint")
    start = time.monotonic()
    index = write_search_index(records, THING, str(tmp_path / "s"), parts=2, columns=["nombre"])
    assert [len(index.parts_with(word)) for word in ("quetzal", "😀ña", "wxyzwxyz")] == [1, 1, 0]
    assert [r.id for w in ("quetzal", "😀ñan", "z s") for r in index.search(w).collect()] == ["1", "1", "2"]
    assert time.monotonic() - start < 60 and GRAM == 3
