"""Registered queries: value statistics, profiles, overlaps and checks of a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog.inputs import TABLES, keyed_table, messy, sql_key, sql_text, table
from gridloom.operators import overlap, profile, quality
from gridloom.plans.model import Entity, Field, Model
from gridloom.session import stored

# ---- inputs ---------------------------------------------------------------------------------


def _stats(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    parts = []
    for name in names:
        df, row = keyed_table(spark, folder, name)
        parts.append(profile.value_stats(profile.long_cells(df, name, row), digest=True))
    return reduce(DataFrame.unionByName, parts)


def _profiles(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    return profile.profiles(_stats(spark, folder, names))


def _value_sets(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    parts = []
    for order, name in enumerate(names):
        df, row = keyed_table(spark, folder, name)
        sets = profile.value_sets(profile.long_cells(df, name, row))
        parts.append(sets.withColumn("table_order", F.lit(order)))
    return reduce(DataFrame.unionByName, parts)


def _sql_values(names: list[str]) -> str:
    """All (table, column, position, key) of the given tables, in DuckDB."""
    return " union all ".join(
        f"select '{t}' as tbl, '{c}' as col, {o} as ord, {i} as pos, {sql_key(c)} as key from {t}"
        for o, t in enumerate(names)
        for i, c in enumerate(TABLES[t][1])
    )


def _sql_profiles(names: list[str]) -> str:
    return f"""select tbl, col, ord, pos, count(*) as total, count(distinct key) as dist,
                      count(distinct key) / count(*) as ratio
               from ({_sql_values(names)}) group by all"""


# ---- queries --------------------------------------------------------------------------------

SMALL = ["orders", "customer", "part", "supplier", "nation", "region"]
ALL = ["orders", "customer", "lineitem", "part", "supplier", "nation", "region"]


def value_statistics(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row"),
        messy(F.col("o_orderpriority"), F.col("o_orderkey")).alias("priority"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("status"),
    )
    stats = profile.value_stats(profile.long_cells(orders, "orders", "row"))
    return stats.select(
        "column", "key", "n", "first_row", "max_len", "n_date", "n_boolean", "n_integer", "n_phone"
    )


def profile_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _profiles(spark, folder, ["orders"]).select(
        "column", "position", "total", "empty", "distinct", "ratio", "max_len", "type"
    )


def profile_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return _profiles(spark, folder, ["lineitem"]).select(
        "column", "total", "empty", "distinct", "max_len", "type", "repeats", "identifying"
    )


def profile_documents(spark: SparkSession, folder: str) -> DataFrame:
    # The id is profiled like any column, so the row number is a copy of it.
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("__row"), "*")
    return profile.profiles(
        profile.value_stats(profile.long_cells(docs, "documents", "__row"), digest=True)
    ).select("column", "total", "empty", "distinct", "max_len", "repeats", "identifying")


def profile_flags(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("part", "p_partkey")):
        df, row = keyed_table(spark, folder, name)
        df = df.withColumnRenamed(key, "Código")
        parts.append(profile.value_stats(profile.long_cells(df, name, row), digest=True))
    signals = profile.profiles(reduce(DataFrame.unionByName, parts))
    return signals.select(
        "table", "header_key", "repeats", "identifying", "identity_candidate"
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    df, row = keyed_table(spark, folder, "orders")
    stats = profile.value_stats(profile.long_cells(df, "orders", row), digest=True)
    listed = profile.spellings(profile.first_values(stats, profile.MAX_SAMPLES), df, row)
    return listed.select("column", F.array_join("samples", "|").alias("samples"))


def whole_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics, type and samples of every column of orders at once."""
    df, row = keyed_table(spark, folder, "orders")
    return profile.profile_table(df, "orders", row).select(
        "column", "position", "total", "distinct", "type", F.array_join("samples", "|").alias("samples")
    )


def options_recovered(spark: SparkSession, folder: str) -> DataFrame:
    df, row = keyed_table(spark, folder, "orders")
    options = profile.recovered_options(df, "orders", row)
    return options.select("column", F.array_join("options", "|").alias("options"))


def value_sets(spark: SparkSession, folder: str) -> DataFrame:
    return _value_sets(spark, folder, ["orders", "customer"]).select("table", "column", "key")


def overlaps(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.overlaps(_value_sets(spark, folder, ALL))
    return overlap.ranked(pairs).select(
        "left_table", "left_column", "right_table", "right_column", "shared",
        F.round("jaccard", 9).alias("jaccard"), F.round("containment", 9).alias("containment"),
    )


def shared_values(spark: SparkSession, folder: str) -> DataFrame:
    """Only the two columns asked for are read."""
    sets = []
    for name, wanted in (("orders", "o_custkey"), ("customer", "c_custkey")):
        df, row = keyed_table(spark, folder, name)
        sets.append(profile.value_sets(profile.long_cells(df, name, row, [wanted])))
    shared = overlap.shared_values(sets[0].unionByName(sets[1]), ("orders", "o_custkey"), ("customer", "c_custkey"))
    return shared.agg(F.count(F.lit(1)).alias("shared"))


def relation_candidates(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.overlaps(_value_sets(spark, folder, ALL))
    found = quality.relation_candidates(pairs, stored(_profiles(spark, folder, ALL), "profiles"))
    return found.withColumn("containment", F.round("containment", 9))


def entity_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return quality.entity_candidates(_profiles(spark, folder, ALL)).select(
        "table", "column", "distinct"
    )


def _model() -> Model:
    customers = Entity(
        "clientes", "orders",
        (Field("codigo", "integer", "o_custkey"), Field("estado", source="o_orderstatus")),
        display="codigo", dedupe="codigo", derived=True,
    )
    amounts = Entity(
        "importes", "orders", (Field("importe", "decimal", "o_totalprice"),),
        display="importe", derived=True,
    )
    keys = Entity(
        "pedidos", "orders",
        (Field("numero", "integer", "o_orderkey"), Field("fantasma", source="o_ghost")),
        display="numero", dedupe="numero", derived=True,
    )
    parts = Entity("piezas", "part", (Field("nombre", source="p_name"),), display="nombre")
    return Model((customers, amounts, keys, parts))


def _columns(spark: SparkSession, names: list[str]) -> DataFrame:
    return profile.columns_of(spark, {name: TABLES[name][1] for name in names})


def unmapped_columns(spark: SparkSession, folder: str) -> DataFrame:
    listed = _columns(spark, ["orders", "part"])
    return quality.unmapped_columns(listed, quality.mapping(spark, _model())).select(
        "table", "column"
    )


def unknown_sources(spark: SparkSession, folder: str) -> DataFrame:
    listed = _columns(spark, ["orders", "part"])
    return quality.unknown_sources(listed, quality.mapping(spark, _model())).select(
        "entity", "field", "table", "column"
    )


def excluded_sources(spark: SparkSession, folder: str) -> DataFrame:
    """A table without rows is left out, and so is one that a person excludes."""
    filled = [
        table(spark, folder, name).limit(1).select(F.lit(name).alias("table")) for name in ("orders", "part")
    ]
    included = reduce(DataFrame.unionByName, filled).where(F.col("table") != "part")
    return quality.excluded_sources(quality.mapping(spark, _model()), included).select(
        "entity", "field", "table"
    )


def identifying_refused(spark: SparkSession, folder: str) -> DataFrame:
    profiled = _profiles(spark, folder, ["orders", "part"])
    return quality.refused_entities(profiled, quality.mapping(spark, _model())).select(
        "entity", "field", F.round("ratio", 9).alias("ratio")
    )


def merge_warning(spark: SparkSession, folder: str) -> DataFrame:
    return quality.merge_warnings(_profiles(spark, folder, SMALL)).select(
        "table", "column", "fused_rows"
    )


def display_column(spark: SparkSession, folder: str) -> DataFrame:
    return profile.display_column(_profiles(spark, folder, SMALL))


_ORDERS_PROFILE = " union all ".join(
    f"""select '{c}' as "column", {i} as position, count(*) as total, 0::bigint as empty,
               count(distinct {sql_key(c)}) as "distinct",
               count(distinct {sql_key(c)}) / count(*) as ratio,
               max(length({sql_text(c)}))::int as max_len, '{t}' as type from orders"""
    for i, (c, t) in enumerate(
        zip(TABLES["orders"][1], ("integer", "integer", "text", "decimal", "date", "text"))
    )
)
_LINEITEM_PROFILE = " union all ".join(
    f"""select '{c}' as "column", count(*) as total, 0::bigint as empty,
               count(distinct {sql_key(c)}) as "distinct",
               max(length({sql_text(c)}))::int as max_len, '{t}' as type,
               count(*) >= 10 and count(distinct {sql_key(c)}) >= 2
                 and count(distinct {sql_key(c)}) / count(*) <= 0.5 as repeats,
               count(distinct {sql_key(c)}) / count(*) >= 0.95 as identifying from lineitem"""
    for c, t in zip(
        TABLES["lineitem"][1],
        (*["integer"] * 5, *["decimal"] * 3, "text", "text", "date"),
    )
)
_DOCUMENTS_PROFILE = " union all ".join(
    f"""select '{c}' as "column", count(*) as total, 0::bigint as empty,
               count(distinct {sql_key(c)}) as "distinct",
               max(length(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')))::int as max_len,
               count(*) >= 10 and count(distinct {sql_key(c)}) >= 2
                 and count(distinct {sql_key(c)}) / count(*) <= 0.5 as repeats,
               count(distinct {sql_key(c)}) / count(*) >= 0.95 as identifying from documents"""
    for c, x in (("doc_id", "cast(doc_id as varchar)"), ("text", "text"), ("lang", "lang"),
                 ("source", "source"), ("n_chars", "cast(n_chars as varchar)"))
)
_FLAGS = f"""
    select tbl as "table",
           case when col in ('o_orderkey', 'c_custkey', 'p_partkey') then 'codigo' else col end
             as header_key,
           total >= 10 and dist >= 2 and ratio <= 0.5 as repeats, ratio >= 0.95 as identifying,
           ratio >= 0.95 and col in ('o_orderkey', 'c_custkey', 'p_partkey') as identity_candidate
    from ({_sql_profiles(["orders", "customer", "part"])})"""


def _first_seen(columns: list[str], name: str, having: str = "true", limit: int = 20) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", string_agg(v, '|' order by f) as {name}
            from (select {sql_text(c)} as v, min(o_orderkey) as f from orders group by 1
                  order by f limit {limit}) having {having}"""
        for c in columns
    )


_OVERLAPS = f"""
    with v as (select distinct tbl, col, ord, pos, key from ({_sql_values(ALL)}) where key <> ''),
    s as (select tbl, col, ord, pos, count(*) as size from v group by all
          having count(*) >= 2),
    k as (select v.*, size from v join s using (tbl, col, ord, pos)),
    p as (select a.tbl as left_table, a.col as left_column, b.tbl as right_table,
                 b.col as right_column, count(*) as shared, any_value(a.size) as ls,
                 any_value(b.size) as rs
          from k a join k b on a.key = b.key and a.ord < b.ord group by all)
    select left_table, left_column, right_table, right_column, shared,
           round(shared / (ls + rs - shared), 9) as jaccard,
           round(shared / least(ls, rs), 9) as containment
    from p where shared >= 2 and shared / least(ls, rs) >= 0.7"""

_CANDIDATES = f"""
    with o as ({_OVERLAPS}),
    f as (select *, total >= 10 and dist >= 2 and ratio <= 0.5 as repeats, ratio >= 0.95 as ident
          from ({_sql_profiles(ALL)})),
    b as (select left_table as from_table, left_column as from_column, right_table as to_table,
                 right_column as to_column, containment, shared from o
          union all
          select right_table, right_column, left_table, left_column, containment, shared from o)
    select b.* from b
    join f x on x.tbl = from_table and x.col = from_column and x.repeats
    join f y on y.tbl = to_table and y.col = to_column and y.ident"""

QUERIES = {
    "value_stats": (
        value_statistics,
        """with p as (
             select 'priority' as "column", lower(o_orderpriority) as key, o_orderkey as r,
                    length(o_orderpriority) + case when o_orderkey % 4 = 2
                      then length(o_orderpriority) - length(replace(o_orderpriority, ' ', ''))
                      else 0 end as len, o_orderpriority as raw from orders
             union all
             select 'status', case when o_orderkey % 6 <> 0 then lower(o_orderstatus) end,
                    o_orderkey, case when o_orderkey % 6 <> 0 then 1 end, o_orderstatus from orders)
           select "column", key, count(*) as n, min(r) as first_row, max(len)::int as max_len,
                  0::bigint as n_date, 0::bigint as n_boolean, 0::bigint as n_integer,
                  0::bigint as n_phone
           from p group by 1, 2""",
    ),
    "profile_orders": (profile_orders, _ORDERS_PROFILE),
    "profile_lineitem": (profile_lineitem, _LINEITEM_PROFILE),
    "profile_documents": (profile_documents, _DOCUMENTS_PROFILE),
    "profile_flags": (profile_flags, _FLAGS),
    "whole_profile": (
        whole_profile,
        f"""select p."column", position, total, "distinct", type, samples from ({_ORDERS_PROFILE}) p
            join ({_first_seen(TABLES["orders"][1], "samples")}) s on p."column" = s."column" """,
    ),
    "samples": (samples, _first_seen(TABLES["orders"][1], "samples")),
    "options_recovered": (
        options_recovered,
        _first_seen(TABLES["orders"][1], "options", "count(*) <= 50", 51),
    ),
    "value_sets": (
        value_sets,
        f"""select distinct tbl as "table", col as "column", key
            from ({_sql_values(["orders", "customer"])}) where key <> ''""",
    ),
    "overlaps": (overlaps, _OVERLAPS),
    "shared_values": (
        shared_values,
        """select count(*) as shared from
           (select o_custkey from orders intersect select c_custkey from customer)""",
    ),
    "relation_candidates": (relation_candidates, _CANDIDATES),
    "entity_candidates": (
        entity_candidates,
        f"""select tbl as "table", col as "column", dist as "distinct"
            from ({_sql_profiles(ALL)}) where total >= 10 and dist >= 2 and ratio <= 0.5""",
    ),
    "unmapped_columns": (
        unmapped_columns,
        " union all ".join(
            f"""select '{t}' as "table", '{c}' as "column" """
            for t in ("orders", "part")
            for c in TABLES[t][1]
            if c not in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "p_name")
        ),
    ),
    "unknown_sources": (
        unknown_sources,
        """select 'pedidos' as entity, 'fantasma' as field, 'orders' as "table",
                  'o_ghost' as "column" """,
    ),
    "excluded_sources": (
        excluded_sources,
        """select 'piezas' as entity, 'nombre' as field, 'part' as "table" """,
    ),
    "identifying_refused": (
        identifying_refused,
        f"""select e as entity, f as field, round(ratio, 9) as ratio
            from ({_sql_profiles(["orders"])})
            join (values ('clientes', 'codigo', 'o_custkey'), ('importes', 'importe', 'o_totalprice'),
                         ('pedidos', 'numero', 'o_orderkey')) as m(e, f, col) using (col)
            where ratio >= 0.95""",
    ),
    "merge_warning": (
        merge_warning,
        f"""select tbl as "table", col as "column", total - dist as fused_rows
            from ({_sql_profiles(SMALL)}) where ratio < 0.99""",
    ),
    "display_column": (
        display_column,
        """select * from (values ('orders', 'o_orderstatus'), ('customer', 'c_name'),
             ('part', 'p_name'), ('supplier', 's_name'), ('nation', 'n_name'), ('region', 'r_name'))
           as t("table", display)""",
    ),
}
