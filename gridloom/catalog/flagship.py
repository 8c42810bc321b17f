"""The flagship query: from a messy flat table to a page of linked records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog.importing import _FLAT, CUSTOMERS, MODEL, ORDERS
from gridloom.catalog.inputs import flat_orders
from gridloom.operators.listing import list_page
from gridloom.plans.importer import Table, plan_import
from gridloom.plans.model import SOURCE


def customers_page(spark: SparkSession, folder: str) -> DataFrame:
    """Derive customers, link orders to them, and list the largest orders with their customer."""
    tables = {"pedidos": Table(flat_orders(spark, folder), "row", "Pedidos")}
    done = plan_import(MODEL, tables)
    targets = {"clientes": (CUSTOMERS, done.records("clientes"))}
    page = list_page(done.records("pedidos"), ORDERS, targets, "valor", descending=True)
    return page.select(
        F.col(f"{SOURCE}.row").alias("source_row"),
        "fecha",
        F.col("valor").cast("double").alias("valor"),
        "prioridad",
        F.lower("__rel_cliente").alias("customer"),
    )


QUERIES = {
    "customers_page": (
        customers_page,
        f"""with f as ({_FLAT}), c as (select c_name, arg_min(shown, r) as shown from f
                                       where not blank group by 1)
            select r as source_row, o_orderdate::date as fecha, o_totalprice as valor,
                   o_orderpriority as prioridad,
                   lower(case when not blank then c.shown end) as customer
            from f left join c using (c_name) where not bad_date and not bad_value
            order by valor desc, sha256('pedidos' || chr(31) || '0' || chr(31) || r) limit 25""",
    ),
}
