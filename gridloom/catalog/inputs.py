"""Inputs of the registered queries: the given tables, and messy text derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the relational tables that profiles and overlaps read, with their row column.
TABLES = {
    "orders": (
        "o_orderkey",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    ),
    "customer": (
        "c_custkey",
        ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    ),
    "lineitem": (
        "__row",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
         "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    ),
    "part": (
        "p_partkey",
        ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    ),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]),
    "region": ("r_regionkey", ["r_regionkey", "r_name"]),
}
DOUBLES = {
    "o_totalprice", "c_acctbal", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "p_retailprice", "s_acctbal",
}
DATES = {"o_orderdate", "l_shipdate"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed_table(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, str]:
    """A table with a copy of its key as row number, so that the key can be profiled too."""
    row, columns = TABLES[name]
    df = table(spark, folder, name)
    if row == "__row":
        number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    else:
        number = F.col(row)
    return df.select(number.alias("__row"), *columns), "__row"


def sql_text(column: str) -> str:
    """DuckDB text of a column as the profile sees it."""
    if column in DATES:
        return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.000Z')"
    if column in DOUBLES:
        return (
            f"case when {column} = floor({column}) then cast(cast({column} as bigint) as varchar)"
            f" else cast({column} as varchar) end"
        )
    return f"trim(cast({column} as varchar))"


def sql_key(column: str) -> str:
    return rf"lower(trim(regexp_replace(strip_accents({sql_text(column)}), '\s+', ' ', 'g')))"


def by_key(key: Column, *choices: Column) -> Column:
    """One of several spellings, in turn by key."""
    turn = F.pmod(key, F.lit(len(choices)))
    chosen = choices[-1]
    for i, choice in reversed(list(enumerate(choices[:-1]))):
        chosen = F.when(turn == i, choice).otherwise(chosen)
    return chosen


def messy(text: Column, key: Column) -> Column:
    """Four spellings of the same value: as is, upper case, padded, and with accents."""
    return by_key(
        key,
        text,
        F.upper(text),
        F.concat(F.lit(" \t "), F.regexp_replace(text, " ", "  "), F.lit("  ")),
        F.translate(text, "aeiounAEIOUN", "áéíóúñÁÉÍÓÚÑ"),
    )


def flat_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer written out on every row, in messy spellings, as text.

    Every 50th amount is junk, every 70th date is impossible and every 90th customer blank.
    """
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    key = F.col("o_orderkey")
    return joined.select(
        key.alias("row"),
        F.when(key % 90 == 0, F.lit("   ")).otherwise(messy(F.col("c_name"), key)).alias("Cliente"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("Codigo"),
        messy(F.col("c_mktsegment"), key).alias("Segmento"),
        F.when(key % 70 == 0, F.lit("31/02/2026"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
        .alias("Fecha"),
        F.when(key % 50 == 0, F.lit("a convenir"))
        .otherwise(F.regexp_replace(F.format_number("o_totalprice", 2), ",", " "))
        .alias("Valor"),
        messy(F.col("o_orderpriority"), key).alias("Prioridad"),
    )
