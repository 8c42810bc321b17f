"""Registered queries: entities, links, failures and import summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog.inputs import flat_orders, table
from gridloom.functions.cells import cells_of
from gridloom.operators import entities as E
from gridloom.operators import profile
from gridloom.plans.autotype import auto_model
from gridloom.plans.importer import Imported, Table, plan_import, run_import
from gridloom.plans.model import ID, KEY, SOURCE, Entity, Field, Model
from gridloom.session import scratch_folder
from gridloom.sources import report

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

CUSTOMERS = Entity(
    "clientes", "pedidos",
    (Field("cliente", source="Cliente"), Field("codigo", source="Codigo"),
     Field("segmento", source="Segmento")),
    display="cliente", dedupe="cliente", label="Clientes", derived=True,
)
ORDERS = Entity(
    "pedidos", "pedidos",
    (
        Field("cliente", "relation", "Cliente", target="clientes"),
        Field("fecha", "date", "Fecha", required=True),
        Field("valor", "decimal", "Valor"),
        Field("prioridad", "select", "Prioridad", options=PRIORITIES),
    ),
    display="fecha", label="Pedidos",
)
MODEL = Model((CUSTOMERS, ORDERS))


def _import(spark: SparkSession, folder: str, model: Model = MODEL) -> Imported:
    return plan_import(model, {"pedidos": Table(flat_orders(spark, folder), "row", "Pedidos")})


def derive_entity(spark: SparkSession, folder: str) -> DataFrame:
    """First spelling and first attributes of each customer, by normalized name."""
    customers = _import(spark, folder, Model((CUSTOMERS,))).records("clientes")
    return customers.select(
        ID, "cliente", "codigo", "segmento", F.col(KEY).alias("dedupe_key"),
        F.col(f"{SOURCE}.row").alias("source_row"),
    )


def derive_by_code(spark: SparkSession, folder: str) -> DataFrame:
    """Customers that share a name stay apart when the code is the key."""
    by_code = Entity(
        "clientes", "pedidos",
        (Field("cliente", source="Segmento"), Field("codigo", source="Codigo")),
        display="cliente", dedupe="codigo", derived=True,
    )
    records = _import(spark, folder, Model((by_code,))).records("clientes")
    return records.select("codigo", f"{SOURCE}.row")


def derive_after_failures(spark: SparkSession, folder: str) -> DataFrame:
    """A bad first row does not claim its key."""
    strict = Entity(
        "prioridades", "pedidos",
        (Field("prioridad", source="Prioridad"), Field("fecha", "date", "Fecha", required=True),
         Field("valor", "decimal", "Valor", required=True)),
        display="prioridad", dedupe="prioridad", derived=True,
    )
    records = _import(spark, folder, Model((strict,))).records("prioridades")
    return records.select(
        F.col(KEY).alias("dedupe_key"), "fecha", F.col("valor").cast("double").alias("valor"),
        F.col(f"{SOURCE}.row").alias("source_row"),
    )


def link_facts(spark: SparkSession, folder: str) -> DataFrame:
    orders = _import(spark, folder).records("pedidos")
    return orders.select(
        F.col(f"{SOURCE}.row").alias("source_row"), "cliente", "fecha",
        F.col("valor").cast("double").alias("valor"), "prioridad",
    )


def link_by_name_or_code(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that name their customer by display value or by code; the display value wins."""
    customer = table(spark, folder, "customer")
    key = F.col("c_custkey")
    people = customer.select(
        (key + 1).alias("row"),
        # The name of one customer is the code of the next.
        F.concat(F.lit("C-"), (key + 1).cast("string")).alias("Nombre"),
        F.concat(F.lit("c-"), key.cast("string")).alias("Codigo"),
    )
    orders = table(spark, folder, "orders")
    facts = orders.select(
        F.col("o_orderkey").alias("row"),
        F.concat(F.lit(" C-"), F.col("o_custkey").cast("string")).alias("Quien"),
    )
    model = Model(
        (
            Entity("personas", "personas",
                   (Field("nombre", source="Nombre"), Field("codigo", source="Codigo")),
                   display="nombre", dedupe="codigo"),
            Entity("ventas", "ventas", (Field("quien", "relation", "Quien", target="personas"),
                                        Field("texto", source="Quien")), display="texto"),
        )
    )
    done = plan_import(model, {"personas": Table(people, "row"), "ventas": Table(facts, "row")})
    people_ids = done.records("personas").select(F.col(ID).alias("quien"), "codigo")
    return done.records("ventas").join(people_ids, "quien", "left").select(
        F.col(f"{SOURCE}.row").alias("source_row"), F.col("codigo").alias("found_code")
    )


def required_links(spark: SparkSession, folder: str) -> DataFrame:
    """Facts whose required customer is not found are refused."""
    needed = Entity(
        "pedidos", "pedidos",
        (Field("cliente", "relation", "Cliente", required=True, target="clientes"),
         Field("codigo", source="Codigo")),
        display="codigo", label="Pedidos",
    )
    failed = _import(spark, folder, Model((CUSTOMERS, needed))).failures()
    return failed.where(F.col("entity") == "Pedidos").select("row_number", "reason")


def row_failures(spark: SparkSession, folder: str) -> DataFrame:
    failed = _import(spark, folder).failures()
    return failed.select(
        "entity", "sheet", "row_number", "reason", F.size("raw").alias("raw_cells"),
        F.col("raw")[4].alias("raw_value"),
    )


def failure_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report people read: at most 500 rows by sheet and row."""
    return report.report(_import(spark, folder).failures()).select(
        "sheet", "row_number", "entity", "reason"
    )


def import_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _import(spark, folder).summary()


def written_import(spark: SparkSession, folder: str) -> DataFrame:
    """The import written to tables in one pass per entity, then counted by status."""
    tables = {"pedidos": Table(flat_orders(spark, folder), "row", "Pedidos")}
    path = scratch_folder(spark, "import")
    done = run_import(spark, MODEL, tables, path, datetime(2026, 1, 1))
    return done.counts()


def _customers(df: DataFrame) -> DataFrame:
    entity = Entity("clientes", "customer", (Field("nombre", source="c_name"),
                                             Field("saldo", "decimal", "c_acctbal")),
                    display="nombre", dedupe="nombre")
    return E.kept(E.import_entity(df, entity, "row"))


def append_conflict(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in credit are there already; all customers are appended, twice each."""
    names = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("row"), "c_name", "c_acctbal"
    )
    existing = _customers(names.where(F.col("c_acctbal") > 0))
    twice = names.unionByName(
        names.select((F.col("row") + 1_000_000_000).alias("row"), F.upper("c_name").alias("c_name"),
                     "c_acctbal")
    )
    entity = Entity("clientes", "customer", (Field("nombre", source="c_name"),
                                             Field("saldo", "decimal", "c_acctbal")),
                    display="nombre")
    cells = cells_of(twice, ["c_name"])
    batch = E.kept(E.import_entity(twice, entity, "row")).join(
        twice.select(F.col("row"), cells["c_name"].link_key.alias(KEY)),
        F.col(f"{SOURCE}.row") == F.col("row"),
    ).drop("row")
    fresh = E.append_new(existing, batch)
    return fresh.select(F.col(KEY).alias("dedupe_key"), "nombre", F.col(f"{SOURCE}.row").alias("row"))


def _supplier_text(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as untyped text, the way a sheet holds them."""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("row"),
        F.col("s_suppkey").cast("string").alias("Número"),
        F.col("s_name").alias("Razón Social"),
        F.translate(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), ".", ",").alias("Saldo"),
        F.when(F.col("s_acctbal") > 0, F.lit("sí")).otherwise(F.lit("no")).alias("Al día"),
        F.date_format(F.date_add(F.lit("2020-01-01"), F.col("s_suppkey").cast("int")), "dd/MM/yyyy").alias("Alta"),
    )


def auto_typed(spark: SparkSession, folder: str) -> DataFrame:
    df = _supplier_text(spark, folder)
    stats = profile.value_stats(profile.long_cells(df, "proveedores", "row"), digest=True)
    entity = auto_model(profile.profiles(stats), "proveedores")
    outcome = E.import_entity(df, entity, "row")
    kinds = F.lit(",".join(f"{f.name}:{f.type}" for f in entity.fields) + f" by {entity.display}")
    records = E.kept(outcome).select(*[f.name for f in entity.fields], kinds.alias("model"))
    return records.withColumn("saldo", F.col("saldo").cast("double"))


def entity_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Write typed customers and read them back; amounts over the range are refused first."""
    customer = table(spark, folder, "customer")
    source = customer.select(
        F.col("c_custkey").alias("row"), "c_name",
        # Beyond 14 integer digits the amount does not fit its column.
        F.when(F.col("c_custkey") % 10 == 0, F.lit("123456789012345")).otherwise(
            F.col("c_acctbal").cast("string")
        ).alias("c_acctbal"),
    )
    entity = Entity("clientes", "customer", (Field("nombre", source="c_name", required=True),
                                             Field("saldo", "decimal", "c_acctbal")),
                    display="nombre", dedupe="nombre")
    outcome = E.import_entity(source, entity, "row")
    path = scratch_folder(spark, "round-trip")
    report.write_entity(report.stamped(E.kept(outcome), datetime(2026, 1, 1)), entity, path)
    stored = report.read_entity(spark, path)
    good = stored.select("nombre", F.col("saldo").cast("double").alias("saldo"), F.lit(None).cast("string").alias("reason"))
    bad = E.failures(outcome, entity).select(F.col("raw")[0].alias("nombre"), F.lit(None).cast("double").alias("saldo"), "reason")
    return good.unionByName(bad)


_US = "chr(31)"
_FLAT = """
    select o_orderkey as r, o_orderkey % 90 = 0 as blank, c_name,
           case o_orderkey % 4 when 1 then upper(c_name) when 3 then translate(c_name, 'aeiounAEIOUN', 'áéíóúñÁÉÍÓÚÑ')
                else c_name end as shown,
           case o_orderkey % 4 when 3 then translate(c_mktsegment, 'AEIOUN', 'ÁÉÍÓÚÑ')
                else c_mktsegment end as segment,
           c_custkey, o_orderdate, o_totalprice, o_orderpriority,
           o_orderkey % 70 = 0 as bad_date, o_orderkey % 50 = 0 as bad_value
    from orders join customer on o_custkey = c_custkey"""
_DATE_REASON = """'"fecha" tiene una fecha que no existe: "31/02/2026".'"""
_VALUE_REASON = """'"valor" deberia ser un numero, y trae "a convenir".'"""
_ID = f"sha256('clientes' || {_US} || lower(c_name))"
_FAILURES = f"""
    select 'Pedidos' as entity, 'Pedidos' as sheet, r as row_number,
           case when bad_date then {_DATE_REASON} else {_VALUE_REASON} end as reason,
           6 as raw_cells, case when bad_value then 'a convenir'
             else replace(format('{{:,.2f}}', o_totalprice), ',', ' ') end as raw_value
    from ({_FLAT}) where bad_date or bad_value"""

QUERIES = {
    "derive_entity": (
        derive_entity,
        f"""select {_ID} as id, arg_min(shown, r) as cliente,
                   arg_min(lpad(c_custkey::varchar, 8, '0'), r) as codigo,
                   arg_min(segment, r) as segmento, lower(c_name) as dedupe_key,
                   min(r) as source_row
            from ({_FLAT}) where not blank group by c_name""",
    ),
    "derive_by_code": (
        derive_by_code,
        "select lpad(o_custkey::varchar, 8, '0') as codigo, min(o_orderkey) as row from orders group by 1",
    ),
    "derive_after_failures": (
        derive_after_failures,
        f"""select lower(o_orderpriority) as dedupe_key, arg_min(o_orderdate::date, r) as fecha,
                   arg_min(o_totalprice, r) as valor, min(r) as source_row
            from ({_FLAT}) where not bad_date and not bad_value group by 1""",
    ),
    "link_facts": (
        link_facts,
        f"""select r as source_row, case when not blank and exists (
                     select 1 from ({_FLAT}) x where x.c_name = f.c_name and not x.blank)
                   then {_ID} end as cliente,
                   o_orderdate::date as fecha, o_totalprice as valor, o_orderpriority as prioridad
            from ({_FLAT}) f where not bad_date and not bad_value""",
    ),
    "link_by_name_or_code": (
        link_by_name_or_code,
        """select o_orderkey as source_row,
                  'c-' || case when o_custkey > 0 then o_custkey - 1 else 0 end as found_code
           from orders""",
    ),
    "required_links": (
        required_links,
        f"""select r as row_number,
                   'No encontramos "' || '" entre los registros de cliente.' as reason
            from ({_FLAT}) where blank""",
    ),
    "row_failures": (row_failures, _FAILURES),
    "failure_report": (
        failure_report,
        f"""select sheet, row_number, entity, reason from ({_FAILURES})
            order by sheet, row_number limit 500""",
    ),
    "import_summary": (
        import_summary,
        f"""select 2 as modules,
                   (select count(distinct c_name) from ({_FLAT}) where not blank)
                   + (select count(*) from ({_FLAT}) where not bad_date and not bad_value) as records,
                   1 as relations,
                   (select count(*) from ({_FLAT}) where bad_date or bad_value) as failed_rows,
                   (select count(*) from ({_FLAT}) where blank) as blank_key_rows""",
    ),
    "written_import": (
        written_import,
        f"""with f as ({_FLAT})
            select 'clientes' as entity, 'kept' as status, count(distinct c_name) as groups,
                   count(*) as rows from f where not blank
            union all select 'clientes', 'blank', 1, count(*) from f where blank
            union all select 'pedidos', 'kept', count(*), count(*) from f
                      where not bad_date and not bad_value
            union all select 'pedidos', 'failed', count(*), count(*) from f
                      where bad_date or bad_value""",
    ),
    "append_conflict": (
        append_conflict,
        """select lower(c_name) as dedupe_key, c_name as nombre, c_custkey as row from customer
           where c_acctbal <= 0""",
    ),
    "auto_typed": (
        auto_typed,
        """select s_suppkey as numero, s_name as razon_social, s_acctbal as saldo,
                  s_acctbal > 0 as al_dia, date '2020-01-01' + s_suppkey::int as alta,
                  'numero:integer,razon_social:text,saldo:decimal,al_dia:boolean,alta:date by '
                  || 'razon_social' as model
           from supplier""",
    ),
    "entity_round_trip": (
        entity_round_trip,
        """select c_name as nombre, case when c_custkey % 10 <> 0 then c_acctbal end as saldo,
                  case when c_custkey % 10 = 0 then 'No pudimos guardar esta fila.' end as reason
           from customer""",
    ),
}
