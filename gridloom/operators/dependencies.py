"""Which columns belong to an entity: those that have one value per key.

For every key column and every other one, rows are reduced to distinct (key, value) pairs of hashes,
counted per key and then per pair of columns, in one pass over the table and in numbers only. Keys that
occur once agree with anything, so only keys on several rows count as evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import cells_of


def dependencies(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """key, column, keys, pairs, repeated, consistent, belongs.

    ``keys`` are the values of the key column beside which the other one is filled, ``pairs`` the different
    pairs, ``repeated`` the keys on several such rows and ``consistent`` those of them with one value.
    A column belongs to a key if all repeated keys are consistent, and there are some. Values are
    compared normalized and told apart by 64 bits; blank keys and values say nothing.
    """
    columns = columns or df.columns
    cells = cells_of(df, list(dict.fromkeys([*keys, *columns])))
    hashed = df.select(
        *[F.when(cell.link_key.isNotNull(), F.xxhash64(cell.link_key)).alias(f"h{i}") for i, cell in enumerate(cells.values())]
    )
    place = {name: f"h{i}" for i, name in enumerate(cells)}
    tests = [(k, c) for k in keys for c in columns if c != k]
    if not tests:
        raise ValueError("a key needs another column to be compared with")
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("test"), F.col(place[k]).alias("key"), F.col(place[c]).alias("value"))
            for i, (k, c) in enumerate(tests)
        ]
    )
    counted = (
        hashed.select(F.inline(pairs)).where("key IS NOT NULL AND value IS NOT NULL")
        .groupBy("test", "key", "value").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("test", "key").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"))
        .groupBy("test").agg(
            F.count(F.lit(1)).alias("keys"), F.sum("values").alias("pairs"),
            F.count_if(F.col("n") > 1).alias("repeated"),
            F.count_if((F.col("n") > 1) & (F.col("values") == 1)).alias("consistent"),
        )
    )
    names = [F.array(*[F.lit(t[side]) for t in tests]) for side in (0, 1)]
    return counted.select(
        F.get(names[0], F.col("test")).alias("key"), F.get(names[1], F.col("test")).alias("column"),
        "keys", "pairs", "repeated", "consistent",
        ((F.col("repeated") > 0) & (F.col("repeated") == F.col("consistent"))).alias("belongs"),
    )
