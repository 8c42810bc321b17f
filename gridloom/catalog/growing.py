"""Registered queries: tables that grow by batches, pages of a sorted copy, and what belongs together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog.inputs import keyed_table, messy, sql_key, table
from gridloom.catalog.profiling import _ORDERS_PROFILE
from gridloom.catalog.records import CUSTOMER, ORDER, _customers, _orders
from gridloom.functions.cells import cells_of
from gridloom.operators import changes as C
from gridloom.operators import profile, quality
from gridloom.operators.dependencies import dependencies
from gridloom.operators.runs import ChangeLog, KeyIndex
from gridloom.operators.search_index import write_search_index
from gridloom.operators.sort_index import write_index
from gridloom.plans.model import ID, KEY, SOURCE, Entity, Field
from gridloom.session import scratch_folder, stored


def change_log(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches on customers: patched balances, deletions, and records put. Read before and after
    the log is compacted."""
    supplier = table(spark, folder, "supplier")
    key = F.col("s_suppkey")
    log = ChangeLog(_customers(spark, folder), fanout=3)
    patches = supplier.select(
        key.alias("request"), key.cast("string").alias(ID), F.array(F.lit("saldo")).alias("set"),
        F.col("s_acctbal").cast("string").alias("saldo"),
    )
    met = stored(log.find(patches), "met")
    outcome = C.patch_requests(patches, met, CUSTOMER)
    log.put(C.with_patched(met, outcome, CUSTOMER))
    asked = supplier.select((key * 3).cast("string").alias(ID))
    log.delete(C.delete_requests(asked, log.find(asked), CUSTOMER).where(C.ACCEPTED))
    again = supplier.where(key % 5 == 0).select(
        F.explode(F.array((key * 3).cast("string"), F.concat(F.lit("n-"), key.cast("string")))).alias(ID),
        F.col("s_name").alias("nombre"), F.lit(None).cast("decimal(18,4)").alias("saldo"),
        F.lit("BUILDING").alias("segmento"), F.col("s_nationkey").cast("string").alias("pais"),
    )
    log.put(again)
    before = stored(log.read(), "before")
    log.compact()
    states = [before.withColumn("state", F.lit("runs")), log.read().withColumn("state", F.lit("compacted"))]
    return states[0].unionByName(states[1]).select("state", ID, "nombre", F.col("saldo").cast("double").alias("saldo"), "segmento", "pais")


def append_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in two spellings, appended in four batches: a key stays with the batch that brought it."""
    names = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    twice = names.select("k", F.col("k").alias("row"), "c_name").unionByName(
        names.select((F.col("k") + 1).alias("k"), (F.col("k") + 1_000_000_000).alias("row"), F.upper("c_name").alias("c_name"))
    )
    cells = cells_of(twice, ["c_name"])
    batch = twice.select(
        (F.col("k") % 4).alias("turn"), F.col("row").cast("string").alias(ID), F.col("c_name").alias("nombre"),
        cells["c_name"].link_key.alias(KEY), F.struct(F.lit(0).alias("sheet"), F.col("row").cast("bigint").alias("row")).alias(SOURCE),
    )
    index = KeyIndex(spark, fanout=3)
    fresh = [index.append(batch.where(F.col("turn") == turn)) for turn in range(4)]
    return reduce(DataFrame.unionByName, fresh).select("turn", "nombre", F.col(KEY).alias("dedupe_key"), F.col(f"{SOURCE}.row").alias("row"))


def list_by_cursor(spark: SparkSession, folder: str) -> DataFrame:
    """A page by offset and the two that follow its last row, by amount, largest first."""
    orders = _orders(spark, folder)
    index = write_index(orders, ORDER, scratch_folder(spark, "sorted"), "valor", True)
    pages = [index.page(100, 1000)]
    for _ in range(2):
        # A page has at most 100 rows.
        last = pages[-1].select("valor", ID).collect()[-1]
        pages.append(index.after(last.valor, last.id, 100))
    numbered = [page.select(F.lit(i).alias("page"), ID, "valor", "prioridad") for i, page in enumerate(pages)]
    return reduce(DataFrame.unionByName, numbered)


def search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by what their text holds, from the parts that may hold it."""
    entity = Entity("textos", "documents", (Field("texto", source="text"),), display="texto")
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias(ID), F.col("text").alias("texto"))
    index = write_search_index(docs, entity, scratch_folder(spark, "search"))
    found = [index.search(text).select(F.lit(text).alias("looked_for"), ID) for text in ("LICENSE", "password%=", "ing the th", "zz")]
    return reduce(DataFrame.unionByName, found)


def profile_appended(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of all orders from the statistics of three batches of them."""
    df, row = keyed_table(spark, folder, "orders")
    parts = []
    for i in range(3):
        batch = df.where(F.pmod(F.col(row), F.lit(3)) == i)
        parts.append(stored(profile.value_stats(profile.long_cells(batch, "orders", row), digest=True), "stats"))
    return profile.profiles(profile.merge_stats(*parts)).select(
        "column", "position", "total", "empty", "distinct", "ratio", "max_len", "type"
    )


def fused_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The values that would fuse most orders if their column were a key."""
    df, row = keyed_table(spark, folder, "orders")
    return quality.fused_keys(profile.value_stats(profile.long_cells(df, "orders", row))).select("column", "rank", "key", "rows")


def entity_attributes(spark: SparkSession, folder: str) -> DataFrame:
    """Which columns of flat orders belong to the customer, which to the nation."""
    orders, customer, nation = (table(spark, folder, n) for n in ("orders", "customer", "nation"))
    key = F.col("o_orderkey")
    flat = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lpad("c_custkey", 8, "0").alias("Codigo"), messy(F.col("c_name"), key).alias("Cliente"),
        messy(F.col("c_mktsegment"), key).alias("Segmento"), F.when(key % 7 != 0, F.col("n_name")).alias("Pais"),
        F.col("n_regionkey").alias("Region"), F.col("o_orderpriority").alias("Prioridad"), F.col("o_totalprice").alias("Valor"),
    )
    return dependencies(flat, ["Codigo", "Pais"])


_PATCHED = """
    select c_custkey::varchar as id, c_name as nombre, case when s_suppkey is not null then s_acctbal else c_acctbal end as saldo,
           c_mktsegment as segmento, c_nationkey::varchar as pais
    from customer left join supplier on s_suppkey = c_custkey
    where c_custkey not in (select s_suppkey * 3 from supplier)
    union all
    select unnest([(s_suppkey * 3)::varchar, 'n-' || s_suppkey]), s_name, null, 'BUILDING', s_nationkey::varchar
    from supplier where s_suppkey % 5 = 0"""
_ATTRIBUTES = {"Codigo": "c_custkey::varchar", "Cliente": "c_name", "Segmento": "c_mktsegment",
               "Pais": "case when o_orderkey % 7 <> 0 then n_name end", "Region": "n_regionkey::varchar",
               "Prioridad": "o_orderpriority", "Valor": "o_totalprice::varchar"}


def _attributes_sql() -> str:
    tests = " union all ".join(
        f"select '{k}' as key, '{c}' as col, {_ATTRIBUTES[k]} as k, {_ATTRIBUTES[c]} as v from o"
        for k in ("Codigo", "Pais") for c in _ATTRIBUTES if c != k
    )
    return f"""with o as (select * from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
        t as ({tests}),
        g as (select key, col, k, count(*) as n, count(distinct v) as vs from t where k is not null and v is not null group by key, col, k)
        select key, col as "column", count(*) as keys, sum(vs)::bigint as pairs, count(*) filter (n > 1) as repeated,
               count(*) filter (n > 1 and vs = 1) as consistent,
               count(*) filter (n > 1) > 0 and count(*) filter (n > 1) = count(*) filter (n > 1 and vs = 1) as belongs
        from g group by key, col"""


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

QUERIES = {
    "change_log": (
        change_log,
        f"select state, p.* from ({_PATCHED}) p, (values ('runs'), ('compacted')) as s(state)",
    ),
    "append_batches": (
        append_batches,
        """select case when c_custkey % 4 = 3 then 0 else c_custkey % 4 end as turn,
                  case when c_custkey % 4 = 3 then upper(c_name) else c_name end as nombre, lower(c_name) as dedupe_key,
                  case when c_custkey % 4 = 3 then c_custkey + 1000000000 else c_custkey end as row
           from customer""",
    ),
    "list_by_cursor": (
        list_by_cursor,
        """with o as (select lpad(o_orderkey::varchar, 12, '0') as id, case when o_orderkey % 40 <> 0 then o_totalprice end as valor,
                             o_orderpriority as prioridad from orders),
                n as (select *, row_number() over (order by valor desc nulls last, id) - 1 as pos from o)
           select ((pos - 1000) // 100)::int as page, id, valor, prioridad from n where pos >= 1000 and pos < 1300""",
    ),
    "search_indexed": (
        search_indexed,
        """select t as looked_for, doc_id::varchar as id
           from documents, (values ('LICENSE'), ('password%='), ('ing the th'), ('zz')) as l(t) where text ilike '%' || t || '%'""",
    ),
    "profile_appended": (profile_appended, _ORDERS_PROFILE),
    "fused_keys": (
        fused_keys,
        "with v as ("
        + " union all ".join(f"select '{c}' as col, {sql_key(c)} as key from orders" for c in _ORDER_COLUMNS)
        + """), n as (select col, key, count(*) as n from v group by col, key having count(*) > 1),
              r as (select *, row_number() over (partition by col order by n desc, key) as rank from n)
           select col as "column", rank::int as rank, key, n as rows from r where rank <= 20""",
    ),
    "entity_attributes": (entity_attributes, _attributes_sql()),
}
