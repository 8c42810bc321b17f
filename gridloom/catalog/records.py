"""Registered queries: lists, searches, pickers and batches of changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog.inputs import messy, table
from gridloom.operators import changes as C
from gridloom.operators import listing as L
from gridloom.plans.model import ID, Entity, Field
from gridloom.session import stored

NOW = datetime(2026, 1, 1)

CUSTOMER = Entity(
    "clientes", "customer",
    (Field("nombre", source="c_name", required=True), Field("saldo", "decimal", "c_acctbal"),
     Field("segmento", "select", "c_mktsegment",
           options=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
     Field("pais", "relation", "c_nationkey", target="paises")),
    display="nombre", label="Clientes",
)
ORDER = Entity(
    "pedidos", "orders",
    (Field("cliente", "relation", "o_custkey", target="clientes"),
     Field("valor", "decimal", "o_totalprice"), Field("fecha", "date", "o_orderdate"),
     Field("prioridad", source="o_orderpriority")),
    display="prioridad", label="Pedidos",
)
PART = Entity(
    "piezas", "part",
    (Field("nombre", source="p_name"), Field("marca", source="p_brand"),
     Field("tipo", source="p_type"), Field("precio", "decimal", "p_retailprice")),
    display="nombre",
)
COUNTRY = Entity("paises", "nation", (Field("nombre", source="n_name"),), display="nombre")


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias(ID), F.col("c_name").alias("nombre"),
        F.col("c_acctbal").cast("decimal(18,4)").alias("saldo"),
        F.col("c_mktsegment").alias("segmento"), F.col("c_nationkey").cast("string").alias("pais"),
    )


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with zero-padded ids; every 40th amount and every 45th customer is missing."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.lpad(key.cast("string"), 12, "0").alias(ID),
        F.when(key % 45 != 0, F.col("o_custkey").cast("string")).alias("cliente"),
        F.when(key % 40 != 0, F.col("o_totalprice")).alias("valor"),
        F.col("o_orderdate").cast("date").alias("fecha"),
        F.col("o_orderpriority").alias("prioridad"),
    )


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.cast("string").alias(ID), F.col("p_name").alias("nombre"),
        F.col("p_brand").alias("marca"), F.col("p_type").alias("tipo"),
        F.col("p_retailprice").alias("precio"),
    )


def _countries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("string").alias(ID), F.col("n_name").alias("nombre")
    )


def list_page(spark: SparkSession, folder: str) -> DataFrame:
    targets = {"clientes": (CUSTOMER, _customers(spark, folder))}
    page = L.list_page(_orders(spark, folder), ORDER, targets, sort="fecha", limit=25, offset=50)
    return page.select(ID, "fecha", "valor", "prioridad", "__rel_cliente")


def list_desc_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """The last page by amount, descending: the missing amounts come last."""
    orders = _orders(spark, folder)
    targets = {"clientes": (CUSTOMER, _customers(spark, folder))}
    missing = table(spark, folder, "orders").where(F.col("o_orderkey") % 40 == 0).count()
    offset = max(table(spark, folder, "orders").count() - missing - 50, 0)
    page = L.list_page(orders, ORDER, targets, "valor", True, limit=100, offset=offset)
    return page.select(ID, "valor", "__rel_cliente")


def list_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """A relation sorts by the label it shows."""
    targets = {"clientes": (CUSTOMER, _customers(spark, folder))}
    page = L.list_page(_orders(spark, folder), ORDER, targets, "cliente", True, limit=60)
    return page.select(ID, "__rel_cliente")


def list_deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page far into a long list, found by row position."""
    lines = table(spark, folder, "lineitem").select(
        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber",
                    F.lpad(F.col("l_partkey").cast("string"), 9, "0"),
                    F.lpad(F.col("l_suppkey").cast("string"), 9, "0"),
                    (F.col("l_extendedprice") * 100).cast("bigint").cast("string")).alias(ID),
        F.col("l_extendedprice").alias("importe"),
    )
    entity = Entity("lineas", "lineitem", (Field("importe", "decimal", "l_extendedprice"),), display="importe")
    offset = lines.count() // 3 * 2
    page = L.list_page(lines, entity, descending=True, limit=100, offset=offset, deep=0)
    return page.select(ID, "importe").withColumn("entity", F.lit(entity.name))


def search(spark: SparkSession, folder: str) -> DataFrame:
    found = L.search(_parts(spark, folder), PART, "d_W")
    return found.select(ID, "nombre", "marca", "tipo")


def search_count(spark: SparkSession, folder: str) -> DataFrame:
    return L.count_records(L.search(_parts(spark, folder), PART, "brand#1%"))


def search_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Free text over whole documents, counted by source."""
    entity = Entity("textos", "documents", (Field("texto", source="text"),), display="texto")
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias(ID), F.col("text").alias("texto"), "source"
    )
    found = L.search(docs, entity, "license")
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def picker_options(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier")
    entity = Entity("proveedores", "supplier", (Field("nombre", source="s_name"),), display="nombre")
    records = supplier.select(F.col("s_suppkey").cast("string").alias(ID), F.col("s_name").alias("nombre"))
    return L.picker_options(records, entity, "supplier#00", 20)


def picker_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that are not text: amounts in their shortest form, a name for the missing."""
    records = _orders(spark, folder).select(ID, "valor")
    shown = L.label_text(F.col("valor"), records.schema["valor"].dataType)
    return records.select(ID, F.coalesce(shown, F.lit(L.NO_NAME)).alias("label"))


def find_records(spark: SparkSession, folder: str) -> DataFrame:
    """The customers that open orders refer to, with the name of their country."""
    ids = table(spark, folder, "orders").where("o_orderstatus = 'O'").select(
        F.col("o_custkey").cast("string").alias(ID)
    )
    targets = {"paises": (COUNTRY, _countries(spark, folder))}
    found = L.find_records(_customers(spark, folder), CUSTOMER, ids, targets)
    return found.select(ID, "nombre", F.col("saldo").cast("double").alias("saldo"), "__rel_pais")


def strict_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts typed by hand: human notation is read, nothing is rounded."""
    price, key = F.col("p_retailprice"), F.col("p_partkey")
    batch = table(spark, folder, "part").select(
        key.alias("request"),
        F.translate(F.format_number(price, 2), ",.", ".,").alias("precio"),
        F.when(key % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(",5")))
        .when(key % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".0")))
        .otherwise(F.col("p_size").cast("string"))
        .alias("medida"),
    )
    entity = Entity("piezas", "part", (Field("precio", "decimal", "x"), Field("medida", "integer", "x")), display="precio")
    outcome = C.create_records(batch, entity, "lote", now=NOW)
    return outcome.select("request", F.col("precio").cast("double").alias("precio"), "medida", "reason")


def batch_create(spark: SparkSession, folder: str) -> DataFrame:
    """New customers, one per supplier, some with a bad option, a missing name or no country."""
    key = F.col("s_suppkey")
    batch = table(spark, folder, "supplier").select(
        key.alias("request"),
        F.when(key % 11 != 0, F.col("s_name")).alias("nombre"),
        F.col("s_acctbal").alias("saldo"),
        F.when(key % 7 == 0, F.lit("building")).otherwise(F.lit("BUILDING")).alias("segmento"),
        F.when(key % 5 == 0, F.lit("999")).otherwise(F.col("s_nationkey").cast("string")).alias("pais"),
    )
    outcome = C.create_records(batch, CUSTOMER, "lote 1", {"paises": _countries(spark, folder)}, NOW)
    grown = C.with_created(_customers(spark, folder), outcome)
    refused = outcome.where(~F.col(C.ACCEPTED)).select(
        F.col("request").cast("string").alias("who"), F.col("reason")
    )
    return grown.select(F.col("nombre").alias("who"), F.lit(None).cast("string").alias("reason")).unionByName(refused)


def batch_patch(spark: SparkSession, folder: str) -> DataFrame:
    """Two rounds of patches by supplier key onto customers: balances, and cleared segments."""
    key = F.col("s_suppkey")
    supplier = table(spark, folder, "supplier")
    first = supplier.select(
        key.alias("request"), key.cast("string").alias(ID), F.array(F.lit("saldo")).alias("set"),
        F.col("s_acctbal").cast("string").alias("saldo"), F.lit(None).cast("string").alias("segmento"),
        F.lit(None).cast("string").alias("nombre"),
    )
    second = supplier.select(
        (key + 1_000_000).alias("request"),
        # Beyond the last customer there is nothing to change.
        F.when(key % 9 == 0, F.lit("nobody")).otherwise((key * 2).cast("string")).alias(ID),
        F.array(F.lit("saldo"), F.lit("segmento")).alias("set"),
        F.when(key % 4 == 0, F.lit("mucho")).otherwise(F.lit("1.234,5")).alias("saldo"),
        F.lit(None).cast("string").alias("segmento"), F.lit(None).cast("string").alias("nombre"),
    )
    third = supplier.select(
        (key + 2_000_000).alias("request"), key.cast("string").alias(ID),
        F.array(F.lit("nombre")).alias("set"), F.lit(None).cast("string").alias("saldo"),
        F.lit(None).cast("string").alias("segmento"),
        F.when(key % 2 == 0, F.col("s_name")).alias("nombre"),
    )
    records = _customers(spark, folder).withColumns(
        {"created_at": F.lit(datetime(2025, 1, 1)), "updated_at": F.lit(datetime(2025, 1, 1))}
    )
    patches = first.unionByName(second).unionByName(third)
    outcome = stored(C.patch_requests(patches, records, CUSTOMER), "outcome")
    changed = C.with_patched(records, outcome, CUSTOMER, NOW)
    rows = changed.select(
        F.col(ID).alias("who"), "nombre", F.col("saldo").cast("double").alias("saldo"), "segmento",
        (F.year("updated_at") == 2026).alias("touched"), F.lit(None).cast("string").alias("reason"),
    )
    refused = outcome.where(~F.col(C.ACCEPTED)).select(
        F.col("request").cast("string").alias("who"), F.lit(None).cast("string").alias("nombre"),
        F.lit(None).cast("double").alias("saldo"), F.lit(None).cast("string").alias("segmento"),
        F.lit(None).cast("boolean").alias("touched"), "reason",
    )
    return rows.unionByName(refused)


def restricted_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Ask to delete every part: those that large order lines refer to stay."""
    parts = _parts(spark, folder)
    line = Entity("lineas", "lineitem", (Field("pieza", "relation", "l_partkey", target="piezas"),),
                  display="pieza", label="Lineas")
    # Every part has lines; only lines of large orders refer to their part here.
    lines = table(spark, folder, "lineitem").select(
        F.when(F.col("l_quantity") > 48, F.col("l_partkey").cast("string")).alias("pieza")
    )
    ids = parts.select(ID).unionByName(
        table(spark, folder, "region").select(F.concat(F.lit("no-"), F.col("r_name")).alias(ID))
    )
    outcome = stored(C.delete_requests(ids, parts, PART, [(line, line.field("pieza"), lines)]), "outcome")
    left = C.without_deleted(parts, outcome).select(F.col(ID).alias("who"), F.lit("left").alias("what"))
    refused = outcome.where(~F.col(C.ACCEPTED)).select(F.col(ID).alias("who"), F.col("reason").alias("what"))
    return left.unionByName(refused)


def reference_check(spark: SparkSession, folder: str) -> DataFrame:
    """New orders must name a customer that exists; here only those in credit do."""
    customers = _customers(spark, folder).where(F.col("saldo") > 0)
    batch = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request"), F.col("o_custkey").cast("string").alias("cliente"),
        messy(F.col("o_orderpriority"), F.col("o_orderkey")).alias("prioridad"),
    )
    outcome = C.create_records(batch, ORDER, "lote 2", {"clientes": customers}, NOW)
    return outcome.select("request", C.ACCEPTED, "reason")


_ORDERS = """select lpad(o_orderkey::varchar, 12, '0') as id,
                    case when o_orderkey % 45 <> 0 then o_custkey end as cliente,
                    case when o_orderkey % 40 <> 0 then o_totalprice end as valor,
                    o_orderdate::date as fecha, o_orderpriority as prioridad from orders"""
_NAMED = f"""select o.*, c_name as __rel_cliente from ({_ORDERS}) o
             left join customer on c_custkey = cliente"""

QUERIES = {
    "list_page": (
        list_page,
        f"""select id, fecha, valor, prioridad, __rel_cliente from ({_NAMED})
            order by fecha nulls last, id limit 25 offset 50""",
    ),
    "list_desc_nulls": (
        list_desc_nulls,
        f"""select id, valor, __rel_cliente from ({_NAMED}) order by valor desc nulls last, id
            limit 100 offset (select greatest(count(*) filter (o_orderkey % 40 <> 0) - 50, 0)
                              from orders)""",
    ),
    "list_by_label": (
        list_by_label,
        f"""select id, __rel_cliente from ({_NAMED})
            order by __rel_cliente desc nulls last, id limit 60""",
    ),
    "list_deep_page": (
        list_deep_page,
        """select lpad(l_orderkey::varchar, 12, '0') || '-' || l_linenumber || '-' ||
                  lpad(l_partkey::varchar, 9, '0') || '-' || lpad(l_suppkey::varchar, 9, '0') || '-'
                  || trunc(l_extendedprice * 100)::bigint as id,
                  l_extendedprice as importe, 'lineas' as entity
           from lineitem order by importe desc nulls last, id
           limit 100 offset (select count(*) // 3 * 2 from lineitem)""",
    ),
    "search": (
        search,
        """select p_partkey::varchar as id, p_name as nombre, p_brand as marca, p_type as tipo
           from part where p_name ilike '%d_W%' or p_brand ilike '%d_W%' or p_type ilike '%d_W%'""",
    ),
    "search_count": (
        search_count,
        """select count(*) as total from part
           where p_name ilike '%brand#1%%' or p_brand ilike '%brand#1%%' or p_type ilike '%brand#1%%'""",
    ),
    "search_documents": (
        search_documents,
        "select source, count(*) as n from documents where text ilike '%license%' group by 1",
    ),
    "picker_options": (
        picker_options,
        """select s_suppkey::varchar as id, s_name as label from supplier
           where s_name ilike '%supplier#00%' order by s_name nulls last, id limit 20""",
    ),
    "picker_labels": (
        picker_labels,
        f"""select id, case when valor is null then '(sin nombre)'
                            when valor = floor(valor) then valor::bigint::varchar
                            else valor::varchar end as label from ({_ORDERS})""",
    ),
    "find_records": (
        find_records,
        """select c_custkey::varchar as id, c_name as nombre, c_acctbal as saldo, n_name as __rel_pais
           from customer left join nation on n_nationkey = c_nationkey
           where c_custkey in (select o_custkey from orders where o_orderstatus = 'O')""",
    ),
    "strict_numbers": (
        strict_numbers,
        """select p_partkey as request,
                  case when p_partkey % 3 <> 0 then round(p_retailprice, 2)
                       else round(p_retailprice, 2) end as precio,
                  case when p_partkey % 3 <> 0 then p_size::bigint end as medida,
                  case when p_partkey % 3 = 0 then '"medida" debe ser un numero entero.' end as reason
           from part""",
    ),
    "batch_create": (
        batch_create,
        """with b as (select s_suppkey as k, s_name, s_suppkey % 11 = 0 as no_name,
                             s_suppkey % 7 = 0 as bad_option, s_suppkey % 5 = 0 as no_country
                      from supplier)
           select c_name as who, null::varchar as reason from customer
           union all
           select s_name, null from b where not (no_name or bad_option or no_country)
           union all
           select k::varchar, case when no_name then '"nombre" debe ser texto.'
             when bad_option then
               '"segmento" admite: AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY.'
             else 'Este registro apunta a otro que ya no existe. Elige uno de la lista.' end
           from b where no_name or bad_option or no_country""",
    ),
    "batch_patch": (
        batch_patch,
        """with n as (select count(*) as customers from customer),
           two as (select s_suppkey as k, s_suppkey * 2 as target, s_suppkey % 4 = 0 as bad,
                          s_suppkey % 9 = 0 or s_suppkey * 2 >= customers as nobody
                   from supplier, n),
           hit as (select target from two where not bad and not nobody)
           select c_custkey::varchar as who,
                  case when c_custkey % 2 = 0 and s_name is not null then s_name else c_name end
                    as nombre,
                  case when target is not null then 1234.5 else coalesce(s_acctbal, c_acctbal) end
                    as saldo,
                  case when target is null then c_mktsegment end as segmento,
                  s_suppkey is not null or target is not null as touched, null::varchar as reason
           from customer left join supplier on s_suppkey = c_custkey
                         left join hit on target = c_custkey
           union all
           select (k + 1000000)::varchar, null, null, null, null,
                  case when bad then '"saldo" debe ser un numero.'
                       else 'No encontramos ese registro.' end
           from two where bad or nobody
           union all
           select (s_suppkey + 2000000)::varchar, null, null, null, null,
                  '"nombre" debe ser texto.' from supplier where s_suppkey % 2 = 1""",
    ),
    "restricted_delete": (
        restricted_delete,
        """with used as (select distinct l_partkey from lineitem where l_quantity > 48)
           select p_partkey::varchar as who, unnest(['left',
                  'No se puede eliminar este registro porque Lineas depende de el.']) as what
           from part where p_partkey in (select l_partkey from used)
           union all select 'no-' || r_name, 'No encontramos ese registro.' from region""",
    ),
    "reference_check": (
        reference_check,
        """select o_orderkey as request, c_custkey is not null as accepted,
                  case when c_custkey is null then
                    'Este registro apunta a otro que ya no existe. Elige uno de la lista.' end
                    as reason
           from orders left join customer on c_custkey = o_custkey and c_acctbal > 0""",
    ),
}
