"""Columns of different tables that hold the same values.

Comparing every pair of columns that share some value would emit all pairs of a common value
such as ``1`` or ``si``. Instead, columns with equal value sets are folded into one class,
and a class looks for partners only through its rarest values: a set of ``s`` values that must
share at least ``r`` of them with a larger set shares at least one of any ``s - r + 1``. The
pairs found are then counted exactly, so nothing is missed.

Sets of any size are compared. A class is told by the number of its values and two hashes over
them, and its rare values are those below a spread that a histogram gives: no step gathers or
sorts the values of a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import stored

# Limits of the comparison.
MIN_DISTINCT = 2
MIN_SHARED = 2
MIN_CONTAINMENT = 0.7
#: The largest set that an interactive product compares; pass it as ``max_distinct`` for that.
INTERACTIVE_DISTINCT = 20_000

COLUMNS = ["table", "column", "position", "table_order"]


def _required(size: Column) -> Column:
    """Shared values below which a set of this size cannot qualify. The margin keeps rounding
    on the safe side; the exact test comes last."""
    return F.greatest(F.lit(MIN_SHARED), F.ceil(size * MIN_CONTAINMENT - 1e-6).cast("long"))


def column_classes(values: DataFrame, max_distinct: int | None = None) -> DataFrame:
    """One row per column with its size and the class of columns with the same value set.

    A class is the number of its first column in order of table and position.
    """
    hashes = (F.xxhash64("key"), F.xxhash64(F.lit(1), "key"))
    identity = [F.count(F.lit(1)).alias("size"), *(F.bit_xor(h).alias(f"x{i}") for i, h in enumerate(hashes))]
    sized = values.groupBy(*COLUMNS).agg(*identity).where(F.col("size") >= MIN_DISTINCT)
    if max_distinct is not None:
        sized = sized.where(F.col("size") <= max_distinct)
    numbered = stored(sized.withColumn("at", F.shiftleft(F.col("table_order").cast("long"), 32) + F.col("position")), "columns")
    same = ["size", "x0", "x1"]
    classes = numbered.groupBy(*same).agg(F.min("at").alias("class"))
    return numbered.join(classes, same).drop("x0", "x1")


def overlaps(values: DataFrame, max_distinct: int | None = None) -> DataFrame:
    """Pairs of columns of different tables with enough values in common.

    ``values`` holds the distinct keys of every column (``operators.profile.value_sets``) plus
    ``table_order``, the order in which pairs name their left side. With ``max_distinct``, columns
    of more values are left out.
    """
    # Both are read several times; the second has one row per column.
    values = stored(values.select(*COLUMNS, "key"), "values")
    members = stored(column_classes(values, max_distinct), "members")
    classes = members.groupBy("class").agg(
        F.max("size").alias("size"), F.min("table_order").alias("low"), F.max("table_order").alias("high")
    )
    # One column speaks for each class.
    speakers = members.where(F.col("at") == F.col("class")).select("table_order", "position", "class").join(classes, "class")
    keys = stored(values.select("table_order", "position", "key").join(speakers, ["table_order", "position"]).select(
        "class", "size", "low", "high", "key"
    ), "class-keys")
    pairs = _class_pairs(keys)
    same = classes.where("low < high").select(
        F.col("class").alias("a"), F.col("class").alias("b"), F.col("size").alias("shared")
    )
    return _between_columns(pairs.unionByName(same), members.drop("at"))


def _probes(keys: DataFrame) -> DataFrame:
    """Of each class all values up to the spread at which they are enough; ties included."""
    spread = keys.groupBy("key").agg(F.count(F.lit(1)).alias("spread"))
    spread_keys = keys.join(spread, "key")
    counts = spread_keys.groupBy("class", "spread").agg(
        F.count(F.lit(1)).alias("n"), F.max("size").alias("size")
    )
    # One row per class and spread; a value is in as many classes as there are at most.
    rising = Window.partitionBy("class").orderBy("spread").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(rising), F.lit(0))
    wanted = counts.withColumn("before", before).where(
        F.col("before") < F.col("size") - _required(F.col("size")) + 1
    )
    return spread_keys.join(wanted.select("class", "spread"), ["class", "spread"])


def _class_pairs(keys: DataFrame) -> DataFrame:
    """Shared counts of the class pairs that can qualify, each pair once."""
    small, large = _probes(keys).alias("s"), keys.alias("l")
    ordered = (F.col("s.size") < F.col("l.size")) | (
        (F.col("s.size") == F.col("l.size")) & (F.col("s.class") < F.col("l.class"))
    )
    one_table = (F.col("s.low") == F.col("l.high")) & (F.col("s.high") == F.col("l.low"))
    candidates = (
        small.join(large, F.col("s.key") == F.col("l.key"))
        .where(ordered & ~one_table)
        .select(F.col("s.class").alias("a"), F.col("l.class").alias("b"))
        .distinct()
    )
    of_small = keys.select(F.col("class").alias("a"), "size", "key")
    of_large = keys.select(F.col("class").alias("b"), "key")
    return (
        candidates.join(of_small, "a")
        .join(of_large, ["b", "key"])
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("shared"), F.max("size").alias("size"))
        .where(F.col("shared") >= _required(F.col("size")))
        .select("a", "b", "shared")
    )


def _between_columns(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Class pairs as column pairs of different tables, the earlier table on the left."""
    a = members.select(*[F.col(c).alias(f"a_{c}") for c in members.columns])
    b = members.select(*[F.col(c).alias(f"b_{c}") for c in members.columns])
    joined = (
        pairs.join(a, F.col("a") == F.col("a_class"))
        .join(b, F.col("b") == F.col("b_class"))
        .where(F.col("a_table_order") != F.col("b_table_order"))
        # Within one class both orders of a pair appear; keep one.
        .where((F.col("a") != F.col("b")) | (F.col("a_table_order") < F.col("b_table_order")))
    )
    first = F.col("a_table_order") < F.col("b_table_order")

    def side(name: str, left: bool) -> Column:
        one, other = F.col(f"a_{name}"), F.col(f"b_{name}")
        return F.when(first, one if left else other).otherwise(other if left else one)

    shared = F.col("shared")
    smaller = F.least("a_size", "b_size")
    return joined.select(
        side("table", True).alias("left_table"),
        side("column", True).alias("left_column"),
        side("table_order", True).alias("left_order"),
        side("position", True).alias("left_position"),
        side("table", False).alias("right_table"),
        side("column", False).alias("right_column"),
        side("table_order", False).alias("right_order"),
        side("position", False).alias("right_position"),
        shared.alias("shared"),
        (shared / (F.col("a_size") + F.col("b_size") - shared)).alias("jaccard"),
        (shared / smaller).alias("containment"),
    ).where((F.col("shared") >= MIN_SHARED) & (F.col("containment") >= MIN_CONTAINMENT))


def ranked(pairs: DataFrame) -> DataFrame:
    """Strongest signal first, then by position."""
    return pairs.orderBy(
        F.desc("containment"),
        F.desc("shared"),
        "left_order",
        "left_position",
        "right_order",
        "right_position",
    )


def shared_values(values: DataFrame, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """The values two columns have in common."""

    def one(side: tuple[str, str]) -> DataFrame:
        return values.where((F.col("table") == side[0]) & (F.col("column") == side[1])).select("key")

    return one(left).intersect(one(right))
