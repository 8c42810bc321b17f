"""Registered queries: untyped grids, header rows, sheets and workbooks."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog import xlsx_writer
from gridloom.catalog.inputs import table
from gridloom.functions.cells import BOOLEAN, CELL_TYPE, DATETIME, NUMBER, TEXT, cell_of
from gridloom.operators import headers as H
from gridloom.operators import profile
from gridloom.plans.importer import Table, run_import
from gridloom.plans.model import Entity, Field, Model
from gridloom.session import scratch_folder, stored
from gridloom.sources.workbook import (
    Limits,
    capped,
    cells,
    parse_workbooks,
    read_workbooks,
    register,
    sheet_rows,
    unreadable_files,
)

cloudpickle.register_pickle_by_value(xlsx_writer)

HEADER = ["Cliente", None, "Saldo", "Saldo", "Saldo (2)", " Segmento "]


def _cell(kind: str, value: Column) -> Column:
    payload = {TEXT: "s", NUMBER: "n", BOOLEAN: "b", DATETIME: "t"}[kind]
    types = {f.name: f.dataType for f in CELL_TYPE}
    parts = [
        (value if f == payload else F.lit(None)).cast(types[f]).alias(f) for f in ("s", "n", "b", "t")
    ]
    return F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), *parts))


def customer_grid(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet per nation, in a file per region, with the customers of the nation as rows.

    Every fourth sheet has its header on top; the others have a title, a blank row and a note
    above it. Every seventh has numbers where the names should be. Each region also has an
    empty sheet. Rows keep gaps where other nations' customers are.
    """
    nation = table(spark, folder, "nation")
    place = [
        F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("file"),
        F.col("n_nationkey").alias("sheet_index"),
        F.col("n_name").alias("sheet_name"),
    ]
    top = F.when(F.col("n_nationkey") % 4 == 0, 0).otherwise(3)

    def row(index: Column, *values: Column) -> DataFrame:
        return nation.select(
            *place, index.cast("bigint").alias("row_index"), F.array(*values).alias("cells")
        )

    title = row(F.lit(0), _cell(TEXT, F.concat(F.lit("Clientes de "), "n_name")))
    note = row(F.lit(2), _cell(TEXT, F.lit("Generado automáticamente")))
    blank = row(F.lit(1), _cell(TEXT, F.lit("  ")), _cell(TEXT, F.lit(None).cast("string")))
    below = F.col("sheet_index") % 4 != 0
    named = row(top, *[_cell(TEXT, F.lit(h).cast("string")) for h in HEADER])
    numbered = row(top, *[_cell(NUMBER, F.lit(float(i))) for i in range(6)])
    numbers = F.col("sheet_index") % 7 == 6
    heads = named.where(~numbers).unionByName(numbered.where(numbers))
    people = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    data = people.select(
        *place,
        (F.col("c_custkey") + 4).alias("row_index"),
        F.array(
            _cell(TEXT, F.concat(F.lit(" "), "c_name")),
            _cell(TEXT, F.lit(None).cast("string")),
            _cell(NUMBER, F.col("c_acctbal")),
            _cell(TEXT, F.translate(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), ".", ",")),
            _cell(BOOLEAN, F.col("c_acctbal") > 0),
            _cell(TEXT, F.col("c_mktsegment")),
        ).alias("cells"),
    )
    empty = table(spark, folder, "region").select(
        F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("file"),
        (F.col("r_regionkey") + 100).cast("int").alias("sheet_index"),
        F.lit("Notas").alias("sheet_name"),
        F.lit(-1).cast("bigint").alias("row_index"),
        F.array().cast(data.schema["cells"].dataType).alias("cells"),
    )
    above = title.unionByName(blank).unionByName(note).where(below)
    return above.unionByName(heads).unionByName(data).unionByName(empty)


def header_row(spark: SparkSession, folder: str) -> DataFrame:
    return H.sheet_facts(customer_grid(spark, folder)).select(
        "file", "sheet_index", "sheet_name", "header_row", "last_row"
    )


def header_names(spark: SparkSession, folder: str) -> DataFrame:
    named = _named(stored(customer_grid(spark, folder), "grid"))
    return named.select("file", "sheet_index", F.posexplode("names").alias("position", "header"))


def forced_header(spark: SparkSession, folder: str) -> DataFrame:
    """A person says where the header is: on the numbers, on a blank row, or out of the sheet."""
    grid = stored(customer_grid(spark, folder), "grid")
    nation = table(spark, folder, "nation")
    key = F.col("n_nationkey")
    forced = nation.select(
        F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("file"),
        key.alias("sheet_index"),
        F.when(key % 7 == 6, F.when(key % 4 == 0, 0).otherwise(3))
        .when(key % 4 == 1, 1)
        .when(key % 4 == 2, 1_000_000_000)
        .otherwise(0)
        .cast("bigint")
        .alias("header_row"),
    )
    facts = stored(H.force_headers(H.sheet_facts(grid), grid, forced), "facts")
    named = H.headers(grid, facts)
    return facts.join(named.select(*H.SHEET, F.array_join("names", "|").alias("names")), H.SHEET, "left").select(
        "file", "sheet_index", "header_row", "out_of_bounds", "names"
    )


def _named(grid: DataFrame) -> DataFrame:
    """Header names of the sheets; a row per sheet, read by several steps."""
    return stored(H.headers(grid, H.sheet_facts(grid)), "headers")


def _profiled(grid: DataFrame) -> DataFrame:
    named = _named(grid)
    return profile.profiles(profile.value_stats(H.long_rows(H.data_rows(grid, named), named), digest=True))


def grid_to_rows(spark: SparkSession, folder: str) -> DataFrame:
    grid = stored(customer_grid(spark, folder), "grid")
    rows = H.data_rows(grid, _named(grid))
    texts = F.transform("cells", lambda c: F.coalesce(cell_of(c, CELL_TYPE).text, F.lit("")))
    return rows.select("file", "sheet_index", "row_index", F.array_join(texts, "|").alias("line"))


def sheet_profile(spark: SparkSession, folder: str) -> DataFrame:
    grid = stored(customer_grid(spark, folder), "grid")
    return _profiled(grid).select("table", "column", "total", "empty", "distinct", "type")


def sheet_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Sheets with their issue; a person leaves out the sheets of one region."""
    grid, cut = capped(stored(customer_grid(spark, folder), "grid"), Limits(sheets=200, rows=1000))
    facts = stored(H.sheet_facts(grid), "facts")
    named = stored(H.headers(grid, facts), "headers")
    rows = H.data_rows(grid, named)
    chosen = facts.select(*H.SHEET, (F.col("file") != "region-2").alias("included"))
    return H.classify(facts, named, rows, cut, chosen).select(
        "file", "sheet_index", "row_count", "issue", "searched", "included"
    )


def read_caps(spark: SparkSession, folder: str) -> DataFrame:
    """What the caps leave of every sheet: rows, widest row, and whether it was cut."""
    grid, cut = capped(customer_grid(spark, folder), Limits(sheets=20, rows=1000, columns=4))
    sizes = grid.groupBy(*H.SHEET).agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("cells")).alias("widest")
    )
    flags = cut.withColumn("truncated", F.lit(True))
    return sizes.join(flags, H.SHEET, "left").select(
        *H.SHEET, "rows", "widest", F.coalesce("truncated", F.lit(False)).alias("truncated")
    )


# ---- workbooks --------------------------------------------------------------------------------

#: Orders per workbook.
_PER_BOOK = 1000


def _order_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Orders packed into workbooks of at most a thousand consecutive keys each."""
    orders = table(spark, folder, "orders").select(
        F.floor(F.col("o_orderkey") / _PER_BOOK).cast("bigint").alias("book"),
        "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus",
    )

    def pack(book: pd.DataFrame) -> pd.DataFrame:
        rows = [["Pedido", "Valor", "Prioridad", "Pagado"]]
        for o in book.sort_values("o_orderkey").itertuples():
            rows.append([int(o.o_orderkey), float(o.o_totalprice), f" {o.o_orderpriority} & más", o.o_orderstatus == "F"])
        content = xlsx_writer.workbook_bytes({"Pedidos": rows, "Notas": []})
        return pd.DataFrame({"path": [f"book-{book.book.iloc[0]}"], "content": [content]})

    return orders.groupBy("book").applyInPandas(pack, "path string, content binary")


def _order_grid(spark: SparkSession, folder: str) -> DataFrame:
    return stored(parse_workbooks(_order_workbooks(spark, folder)), "grid")


def workbook_cells(spark: SparkSession, folder: str) -> DataFrame:
    grid = sheet_rows(_order_grid(spark, folder))
    return cells(grid).groupBy("file", "sheet_index", "col_index", "kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("row_index").alias("last_row"),
        F.round(F.sum("n"), 2).alias("total"),
        F.sum(F.col("b").cast("int")).alias("trues"),
        F.max("s").alias("greatest"),
    )


#: Unzipped bytes beyond which a workbook of the error query is refused.
_MOST_BYTES = 5_000_000


def workbook_errors(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of damaged workbooks: some end within a sheet, are no archives, or are too large."""
    limit = _MOST_BYTES

    def damage(batches):
        for batch in batches:
            batch = batch.copy()
            batch["content"] = [
                xlsx_writer.damaged(content, int(path.partition("-")[2]) % 5, limit)
                for path, content in zip(batch["path"], batch["content"])
            ]
            yield batch

    books = _order_workbooks(spark, folder).mapInPandas(damage, "path string, content binary")
    grid = stored(parse_workbooks(books, Limits(unzipped_bytes=limit)), "grid")
    rows = sheet_rows(grid).where("row_index > 0").groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(
        unreadable_files(grid).withColumn("rows", F.lit(0).cast("bigint"))
    )


def _customer_books(spark: SparkSession, folder: str) -> str:
    """A folder below the shared one with books of customers, a sheet per nation."""
    customer = table(spark, folder, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    path = scratch_folder(spark, "books")
    target = path if ":/" in path else f"file:{path}"

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        sheets = {
            f"n{nation}": [["Clave", "Saldo"], *([int(k), float(b)] for k, b in zip(part.c_custkey, part.c_acctbal))]
            for nation, part in rows.sort_values("c_custkey").groupby("c_nationkey")
        }
        system, base = fs.FileSystem.from_uri(target)
        system.create_dir(base)
        with system.open_output_stream(f"{base}/libro-{rows.part.iloc[0]}.xlsx") as out:
            out.write(xlsx_writer.workbook_bytes(sheets))
        return pd.DataFrame({"sheets": [len(sheets)]})

    # A book holds as many customers as a person might put in one.
    parts = customer.withColumn("part", F.floor(F.col("c_custkey") / 20_000).cast("bigint"))
    parts.groupBy("part").applyInPandas(pack, "sheets long").write.format("noop").mode("overwrite").save()
    return target


def _sums(grid: DataFrame) -> DataFrame:
    return cells(sheet_rows(grid)).where("row_index > 0").groupBy("sheet_name", "col_index").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("n"), 2).alias("total")
    )


def workbook_by_sheet(spark: SparkSession, folder: str) -> DataFrame:
    """Large books read sheet by sheet through the registered source."""
    register(spark)
    return _sums(stored(spark.read.format("workbook").load(_customer_books(spark, folder)), "grid"))


def workbook_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The same books through the binary file source."""
    return _sums(read_workbooks(spark, _customer_books(spark, folder)))


def workbook_import(spark: SparkSession, folder: str) -> DataFrame:
    """From workbooks to entities: read, find headers, import, count by status."""
    grid = sheet_rows(_order_grid(spark, folder))
    named = _named(grid)
    rows = H.data_rows(grid, named).where("sheet_index = 0")
    # All books have one header; a row is told by its book and place.
    number = F.substring_index("file", "-", -1).cast("bigint") * (1 << 20) + F.col("row_index")
    flat = rows.select(
        number.alias("row"), *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("Pedido", "Valor", "Prioridad", "Pagado"))]
    )
    priorities = Entity("prioridades", "pedidos", (Field("prioridad", source="Prioridad"),), display="prioridad", dedupe="prioridad")
    orders = Entity(
        "pedidos", "pedidos",
        (Field("numero", "integer", "Pedido", required=True), Field("valor", "decimal", "Valor"), Field("pagado", "boolean", "Pagado"),
         Field("prioridad", "relation", "Prioridad", required=True, target="prioridades")),
        display="numero",
    )
    done = run_import(spark, Model((priorities, orders)), {"pedidos": Table(flat, "row")}, scratch_folder(spark, "import"), datetime(2026, 1, 1))
    linked = done.records("pedidos").join(
        done.records("prioridades").select(F.col("id").alias("prioridad"), F.col("prioridad").alias("nombre")), "prioridad"
    )
    return linked.groupBy("nombre").agg(
        F.count(F.lit(1)).alias("pedidos"), F.round(F.sum(F.col("valor").cast("double")), 2).alias("valor"),
        F.count_if("pagado").alias("pagados"), F.max("numero").cast("bigint").alias("ultimo"),
    )


def workbook_profile(spark: SparkSession, folder: str) -> DataFrame:
    """From workbooks to typed column profiles: read, find headers, profile."""
    grid = sheet_rows(_order_grid(spark, folder))
    return _profiled(grid).select("table", "column", "total", "distinct", "type")


_PLACE = "'region-' || n_regionkey as file, n_nationkey as sheet_index"
_TOP = "case when n_nationkey % 4 = 0 then 0 else 3 end"
_ROWS = f"""
    select {_PLACE}, c_custkey + 4 as row_index, c_name, c_mktsegment, c_acctbal
    from customer join nation on c_nationkey = n_nationkey where n_nationkey % 7 <> 6"""
_BOOK_SUMS = """select 'n' || c_nationkey as sheet_name, 0 as col_index, count(*) as n, sum(c_custkey)::double as total
    from customer group by c_nationkey
    union all
    select 'n' || c_nationkey, 1, count(*), round(sum(c_acctbal), 2) from customer group by c_nationkey"""
QUERIES = {
    "header_row": (
        header_row,
        f"""select {_PLACE}, n_name as sheet_name,
                   case when n_nationkey % 7 <> 6 then ({_TOP})::bigint end as header_row,
                   (select max(c_custkey) + 4 from customer where c_nationkey = n_nationkey) as last_row
            from nation
            union all
            select 'region-' || r_regionkey, r_regionkey + 100, 'Notas', null, null from region""",
    ),
    "header_names": (
        header_names,
        f"""select {_PLACE}, position, header from nation,
              (values (0, 'Cliente'), (1, 'Columna 2'), (2, 'Saldo'), (3, 'Saldo (3)'),
                      (4, 'Saldo (2)'), (5, 'Segmento')) as h(position, header)
            where n_nationkey % 7 <> 6""",
    ),
    "forced_header": (
        forced_header,
        f"""select {_PLACE},
              case when n_nationkey % 7 = 6 then {_TOP}
                   when n_nationkey % 4 = 1 or n_nationkey % 4 = 2 then null else 0 end::bigint
                as header_row,
              n_nationkey % 7 <> 6 and n_nationkey % 4 = 2 as out_of_bounds,
              case when n_nationkey % 7 = 6 then '0|1|2|3|4|5'
                   when n_nationkey % 4 in (1, 2) then null
                   when n_nationkey % 4 = 0 then 'Cliente|Columna 2|Saldo|Saldo (3)|Saldo (2)|Segmento'
                   else 'Clientes de ' || n_name end as names
            from nation
            union all select 'region-' || r_regionkey, r_regionkey + 100, null, false, null from region""",
    ),
    "grid_to_rows": (
        grid_to_rows,
        f"""select file, sheet_index, row_index, c_name || '||' ||
                   case when c_acctbal = floor(c_acctbal) then c_acctbal::bigint::varchar
                        else c_acctbal::varchar end || '|' ||
                   replace(format('{{:.2f}}', c_acctbal), '.', ',') || '|' ||
                   case when c_acctbal > 0 then 'true' else 'false' end || '|' || c_mktsegment as line
            from ({_ROWS})""",
    ),
    "sheet_profile": (
        sheet_profile,
        f"""with r as ({_ROWS})
            select file || '/' || sheet_index as "table", h as "column", count(*) as total,
                   case when h = 'Columna 2' then count(*) else 0 end as empty,
                   case h when 'Cliente' then count(distinct c_name) when 'Columna 2' then 0
                          when 'Saldo' then count(distinct c_acctbal)
                          when 'Saldo (3)' then count(distinct c_acctbal)
                          when 'Saldo (2)' then count(distinct c_acctbal > 0)
                          else count(distinct c_mktsegment) end as "distinct",
                   case h when 'Saldo' then 'decimal' when 'Saldo (3)' then 'decimal'
                          when 'Saldo (2)' then 'boolean' else 'text' end as type
            from r, (select unnest(['Cliente', 'Columna 2', 'Saldo', 'Saldo (3)', 'Saldo (2)',
                                    'Segmento']) as h)
            group by file, sheet_index, h""",
    ),
    "sheet_issues": (
        sheet_issues,
        f"""with n as (select count(*) filter (c_custkey + 4 < 1000) as kept,
                             max(c_custkey) + 4 >= 1000 as cut, c_nationkey as k,
                             max(case when c_custkey + 4 < 1000 then c_custkey + 4 end) >= 25 as deep
                      from customer group by c_nationkey)
            select {_PLACE}, case when n_nationkey % 7 = 6 then 0 else kept end as row_count,
                   case when n_nationkey % 7 = 6 and deep then 'no_headers_within_depth'
                        when n_nationkey % 7 = 6 then 'no_headers' when cut then 'truncated' end as issue,
                   case when n_nationkey % 7 = 6 and deep then 25 end as searched,
                   n_nationkey % 7 <> 6 and n_regionkey <> 2 as included
            from nation join n on k = n_nationkey
            union all
            select 'region-' || r_regionkey, r_regionkey + 100, 0, 'empty', null, false from region""",
    ),
    "read_caps": (
        read_caps,
        f"""with n as (select count(*) filter (c_custkey + 4 < 1000) as kept,
                             max(c_custkey) + 4 >= 1000 as cut, c_nationkey as k
                      from customer group by c_nationkey)
            select {_PLACE}, kept + 1 + case when n_nationkey % 4 = 0 then 0 else 3 end as rows,
                   4 as widest, true as truncated -- every sheet has more columns than the cap
            from nation join n on k = n_nationkey where n_nationkey < 20""",
    ),
    "workbook_cells": (
        workbook_cells,
        """with o as (select 'book-' || o_orderkey // 1000 as file, o_orderkey - (o_orderkey // 1000) * 1000 + 1 as r,
                             o_orderkey, o_totalprice, o_orderpriority, o_orderstatus from orders)
           select file, 0 as sheet_index, 0 as col_index, 'number' as kind, count(*) as n,
                  max(r) as last_row, sum(o_orderkey)::double as total, null::bigint as trues,
                  null::varchar as greatest from o group by file
           union all select file, 0, 1, 'number', count(*), max(r), round(sum(o_totalprice), 2), null, null
             from o group by file
           union all select file, 0, 2, 'text', count(*) + 1, max(r), null, null, 'Prioridad'
             from o group by file
           union all select file, 0, 3, 'boolean', count(*), max(r), null,
                            count(*) filter (o_orderstatus = 'F'), null from o group by file
           union all select file, 0, i, 'text', 1, 0, null, null, h
             from (select distinct file from o),
                  (values (0, 'Pedido'), (1, 'Valor'), (3, 'Pagado')) as t(i, h)""",
    ),
    "workbook_errors": (
        workbook_errors,
        """with o as (select o_orderkey // 1000 as book, count(*) as n from orders group by 1)
           select 'book-' || book as file, case when book % 5 < 2 then n else 0 end as rows,
                  case when book % 5 in (2, 3) then 'No pudimos leer este archivo.'
                       when book % 5 = 4 then 'Este archivo contiene demasiada informacion para procesarlo.'
                  end as error
           from o""",
    ),
    "workbook_by_sheet": (workbook_by_sheet, _BOOK_SUMS),
    "workbook_folder": (workbook_folder, _BOOK_SUMS),
    "workbook_import": (
        workbook_import,
        """select o_orderpriority || ' & más' as nombre, count(*) as pedidos, round(sum(o_totalprice), 2) as valor,
                  count(*) filter (o_orderstatus = 'F') as pagados, max(o_orderkey) as ultimo
           from orders group by 1""",
    ),
    "workbook_profile": (
        workbook_profile,
        """with o as (select 'book-' || o_orderkey // 1000 || '/0' as f, * from orders)
           select f as "table", h as "column", count(*) as total,
                  case h when 'Pedido' then count(distinct o_orderkey)
                         when 'Valor' then count(distinct o_totalprice)
                         when 'Prioridad' then count(distinct o_orderpriority)
                         else count(distinct o_orderstatus = 'F') end as "distinct",
                  case h when 'Pedido' then 'integer' when 'Valor' then 'decimal'
                         when 'Prioridad' then 'text' else 'boolean' end as type
           from o, (select unnest(['Pedido', 'Valor', 'Prioridad', 'Pagado']) as h) group by f, h""",
    ),
}
