"""Overlaps against brute force, with copies, shared values and hot keys."""

import random

from gridloom.operators import overlap


def brute(sets):
    out = set()
    for (lo, lp), left in sets.items():
        for (ro, rp), right in sets.items():
            if lo >= ro or len(left) < 2 or len(right) < 2:
                continue
            shared = len(left & right)
            if shared >= 2 and shared / min(len(left), len(right)) >= 0.7:
                out.add((lo, lp, ro, rp, shared, round(shared / len(left | right), 9),
                         round(shared / min(len(left), len(right)), 9)))
    return out


def test_overlaps_match_brute_force(spark):
    rng = random.Random(7)
    sets = {}
    for table in range(8):
        for position in range(6):
            if position == 0:
                values = {"0", "1"}  # the same two values in every table
            elif position == 1:
                values = {f"k{i}" for i in range(rng.choice([3, 10, 30]))}
            elif position == 2:
                values = {f"u{table}-{i}" for i in range(20)} | {"1"}
            else:
                values = {f"k{rng.randrange(60)}" for _ in range(rng.randrange(1, 60))} | {"hot"}
            sets[table, position] = values
    rows = [(f"t{t}", f"c{p}", p, t, v) for (t, p), values in sets.items() for v in values]
    df = spark.createDataFrame(rows, "table string, column string, position int, table_order int, key string")
    found = overlap.overlaps(df).collect()
    got = {(r.left_order, r.left_position, r.right_order, r.right_position, r.shared,
            round(r.jaccard, 9), round(r.containment, 9)) for r in found}
    assert len(found) == len(got) and got == brute(sets)
    top = overlap.ranked(overlap.overlaps(df)).first()
    assert top.containment == 1.0 and top.shared == max(g[4] for g in got if g[6] == 1.0)


def test_large_columns_are_compared_unless_a_limit_is_given(spark):
    keys = spark.range(30_000).selectExpr("cast(id as string) as key")
    df = keys.selectExpr("'a' as table", "'x' as column", "0 as position", "0 as table_order", "key")
    df = df.unionByName(
        keys.where("key <> '7'").selectExpr("'b' as table", "'x' as column", "0 as position", "1 as table_order", "key")
    )
    found = overlap.overlaps(df).collect()
    assert [(r.shared, round(r.containment, 6)) for r in found] == [(29_999, 1.0)]
    assert overlap.overlaps(df, max_distinct=overlap.INTERACTIVE_DISTINCT).count() == 0
