"""Registered queries: normalization, blanks, types and cell coercion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog.inputs import by_key, flat_orders, messy, table
from gridloom.functions.cells import cells_of
from gridloom.functions.coerce import Target, coerce
from gridloom.functions.text import header_key, normalize_text
from gridloom.operators.profile import long_cells, profiles, value_stats

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def normalize_distinct(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # Whole texts are normalized; only their digests are compared across tasks.
    keyed = docs.select("source", F.sha2(normalize_text(F.col("text")), 256).alias("key"))
    return (
        keyed.groupBy("source", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("source")
        .agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("distinct_texts"))
    )


def normalize_variants(spark: SparkSession, folder: str) -> DataFrame:
    orders = flat_orders(spark, folder).select("Segmento", "Prioridad")
    return (
        orders.select(
            normalize_text(F.col("Segmento")).alias("segment"),
            normalize_text(F.col("Prioridad")).alias("priority"),
        )
        .groupBy("segment", "priority")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def header_keys(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select(
        "p_partkey", F.concat(F.lit("  Número de "), messy(F.col("p_name"), F.col("p_partkey")),
                              F.lit(" / "), F.col("p_brand"), F.lit(" ")).alias("header")
    )
    return names.select(header_key(F.col("header")).alias("header_key")).groupBy("header_key").agg(
        F.count(F.lit(1)).alias("n")
    )


def blank_rows(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    df = table(spark, folder, "customer").select(
        F.when(key % 3 != 0, F.col("c_name")).alias("name"),
        F.when(key % 5 == 0, F.lit(" \t  ")).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(key % 2 == 0, F.lit(0.0)).alias("zero"),
        F.when(key % 7 != 0, F.lit(False)).alias("flag"),
    )
    width = sum((F.when(c.blank, 0).otherwise(1) for c in cells_of(df).values()), F.lit(0))
    return df.groupBy(width.alias("width")).agg(F.count(F.lit(1)).alias("n"))


def canonical_text(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_shipdate",
        (F.col("l_quantity") > 25).alias("large"),
    )
    cells = cells_of(df, ["l_quantity", "l_discount", "l_extendedprice", "l_shipdate", "large"])
    return df.select(
        "l_orderkey", "l_linenumber", *[c.text.alias(f"{n}_text") for n, c in cells.items()]
    )


def _cleaned(df: DataFrame, name: str, target: Target) -> DataFrame:
    """The key columns of ``df`` with the cleaned value and the reason."""
    rows, names = coerce(df, {name: target})
    keep = [c for c in df.columns if c != target.source]
    return rows.select(
        *keep, F.col(names[name].value).alias(name), F.col(names[name].reason).alias("reason")
    )


def clean_number(spark: SparkSession, folder: str) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    english = F.format_number(price, 2)
    spanish = F.translate(english, ",.", ".,")
    df = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(key % 50 == 0, F.lit("pendiente"))
        .otherwise(
            by_key(key, english, spanish, F.concat(F.lit("$ "), spanish, F.lit(" USD")),
                   F.translate(english, ",", ""))
        )
        .alias("written"),
    )
    cleaned = _cleaned(df, "amount", Target("written", "decimal", "Valor"))
    return cleaned.withColumn("amount", F.col("amount").cast("double"))


def clean_integer(spark: SparkSession, folder: str) -> DataFrame:
    half = F.col("l_linenumber") - F.lit(4) + F.lit(0.5)
    df = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") / 2).alias("number"),
        F.translate(half.cast("string"), ".", ",").alias("written"),
    )
    rows, names = coerce(
        df,
        {"a": Target("written", "integer", "n"), "b": Target("number", "integer", "n")},
    )
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        F.col(names["a"].value).alias("from_text"),
        F.col(names["b"].value).alias("from_number"),
        F.coalesce(names["a"].reason, names["b"].reason).alias("reason"),
    )


def clean_date(spark: SparkSession, folder: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    df = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(key % 60 == 0, F.lit("31/02/2026"))
        .when(key % 61 == 0, F.lit("proximamente"))
        .otherwise(
            by_key(key, F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd/MM/yyyy"),
                   F.date_format(day, "d-M-yyyy"), F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"))
        )
        .alias("written"),
    )
    return _cleaned(df, "day", Target("written", "date", "Fecha"))


def clean_datetime(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("event_id")
    df = table(spark, folder, "events").select(
        "event_id",
        F.when(key % 40 == 0, F.lit("2024-13-01 10:00"))
        .otherwise(
            by_key(key, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                   F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        )
        .alias("written"),
    )
    cleaned = _cleaned(df, "at", Target("written", "datetime", "Registrado"))
    # Seconds since the epoch compare the same in every session zone.
    return cleaned.withColumn("at", F.unix_timestamp("at"))


def clean_bool(spark: SparkSession, folder: str) -> DataFrame:
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    yes = by_key(key, F.lit("Sí"), F.lit(" TRUE "), F.lit("x"), F.lit("Verdadero"))
    no = by_key(key, F.lit("no"), F.lit("FALSE"), F.lit("0"), F.lit("falso"))
    df = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(status == "F", yes).when(status == "O", no).otherwise(F.lit("quiza")).alias("written"),
    )
    return _cleaned(df, "flag", Target("written", "boolean", "Pagado"))


def clean_select(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    df = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(key % 33 == 0, F.lit("Inventado")).otherwise(messy(F.col("c_mktsegment"), key)).alias("written"),
    )
    return _cleaned(df, "segment", Target("written", "select", "Segmento", options=SEGMENTS))


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id")
    df = table(spark, folder, "documents").select(
        "doc_id",
        F.when(key % 17 == 0, F.lit("  \n "))
        .otherwise(F.concat(F.lit("  \n"), F.col("text"), F.lit("\t ")))
        .alias("written"),
    )
    cleaned = _cleaned(df, "digest", Target("written", "text", "Texto", required=True))
    return cleaned.withColumn("digest", F.md5("digest"))


def _apparent(spark: SparkSession, folder: str) -> DataFrame:
    """One text column per type, from orders."""
    key = F.col("o_orderkey")
    number = key.cast("string")
    return table(spark, folder, "orders").select(
        key.alias("row"),
        number.alias("entero"),
        F.translate(F.format_number("o_totalprice", 2), ",.", " ,").alias("importe_texto"),
        F.regexp_replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), r"\.", ",").alias("importe"),
        by_key(key, F.lit("Sí"), F.lit("no"), F.lit("X")).alias("pagado"),
        F.date_format("o_orderdate", "d/M/yy").alias("emitido"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("registrado"),
        F.concat(F.lit("user"), number, F.lit("@Example.COM")).alias("buzon"),
        F.concat(F.lit("+593 (99) "), F.lpad(number, 7, "0")).alias("linea"),
        F.concat(F.lit("nota "), number).alias("nota"),
        F.lpad(number, 10, "0").alias("cedula"),
        # One value in twenty is text, which the vote tolerates; one in five it does not.
        F.when(key % 20 == 0, F.lit("n/d")).otherwise(number).alias("casi"),
        F.when(key % 5 == 0, F.lit("n/d")).otherwise(number).alias("mezcla"),
        # The header settles a tie: these are dates and datetimes alike, and bare numbers.
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha_envio"),
        F.when(key % 4 != 0, F.lit(" ")).otherwise(number).alias("huecos"),
        F.lit(None).cast("string").alias("vacia"),
    )


def infer_types(spark: SparkSession, folder: str) -> DataFrame:
    df = _apparent(spark, folder)
    stats = value_stats(long_cells(df, "orders", "row"), digest=True)
    return profiles(stats).select(
        "column", "type", F.round("confidence", 6).alias("confidence"), "total", "empty"
    )


def leading_zero_guard(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    padded = F.lpad(key.cast("string"), 10, "0")
    df = table(spark, folder, "customer").select(
        key.alias("row"),
        padded.alias("cedula"),
        F.concat(F.lit("-"), padded).alias("con_signo"),
        F.concat(F.lit("0."), key.cast("string")).alias("fraccion"),
        # A few padded values do not change the vote; the flag reports them.
        F.when(key % 25 == 0, padded).otherwise(key.cast("string")).alias("pocos"),
    )
    stats = value_stats(long_cells(df, "customer", "row"))
    return profiles(stats).select("column", "type", "has_leading_zero")


def header_hints(spark: SparkSession, folder: str) -> DataFrame:
    """The header settles what its cells leave open: a signed number may be a phone."""
    key = F.col("c_custkey")
    number = F.concat(F.lit("+12345"), F.lpad((key % 10_000).cast("string"), 4, "0"))
    headers = ("Contacto", "valor", "Tel. móvil", "telefonos", "Celular", "Teléfono")
    df = table(spark, folder, "customer").select(
        key.alias("row"), *[number.alias(h) for h in headers],
        # The hint does not make phones of what too few cells could be.
        F.when(key % 5 == 0, F.lit("sin número")).otherwise(number).alias("Whatsapp"),
        F.concat(F.lit("nota "), key.cast("string")).alias("Fecha"),
    )
    stats = value_stats(long_cells(df, "customer", "row"), digest=True)
    return profiles(stats).select("column", "type", F.round("confidence", 6).alias("confidence"))


QUERIES = {
    "header_hints": (
        header_hints,
        """select "column", type, case when "column" = 'Whatsapp' then 1.0 else confidence end as confidence
           from (values ('Contacto', 'phone', 1.0), ('valor', 'integer', 1.0), ('Tel. móvil', 'phone', 1.0),
                 ('telefonos', 'integer', 1.0), ('Celular', 'phone', 1.0), ('Teléfono', 'phone', 1.0),
                 ('Whatsapp', 'text', 1.0), ('Fecha', 'text', 1.0)) as t("column", type, confidence)
           where exists (select 1 from customer)""",
    ),
    "normalize_distinct": (
        normalize_distinct,
        r"""select source, count(*) as documents,
                   count(distinct lower(trim(regexp_replace(strip_accents(text), '\s+', ' ', 'g'))))
                     as distinct_texts
            from documents group by source""",
    ),
    "normalize_variants": (
        normalize_variants,
        """select lower(c_mktsegment) as segment, lower(o_orderpriority) as priority, count(*) as n
           from orders join customer on o_custkey = c_custkey group by all""",
    ),
    "header_keys": (
        header_keys,
        r"""select 'numero_de_' || regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') || '_' ||
                   regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') as header_key,
                   count(*) as n
            from part group by 1""",
    ),
    "blank_rows": (
        blank_rows,
        """select (c_custkey % 3 <> 0)::int + (c_custkey % 5 <> 0)::int + (c_custkey % 2 = 0)::int
                  + (c_custkey % 7 <> 0)::int as width, count(*) as n
           from customer group by 1""",
    ),
    "canonical_text": (
        canonical_text,
        """select l_orderkey, l_linenumber,
                  cast(cast(l_quantity as bigint) as varchar) as l_quantity_text,
                  case when l_discount = 0 then '0' else cast(l_discount as varchar) end
                    as l_discount_text,
                  case when l_extendedprice = floor(l_extendedprice)
                       then cast(cast(l_extendedprice as bigint) as varchar)
                       else cast(l_extendedprice as varchar) end as l_extendedprice_text,
                  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.000Z') as l_shipdate_text,
                  case when l_quantity > 25 then 'true' else 'false' end as large_text
           from lineitem""",
    ),
    "clean_number": (
        clean_number,
        """select o_orderkey,
                  case when o_orderkey % 50 <> 0 then round(o_totalprice, 2) end as amount,
                  case when o_orderkey % 50 = 0
                       then '"Valor" deberia ser un numero, y trae "pendiente".' end as reason
           from orders""",
    ),
    "clean_integer": (
        clean_integer,
        """select l_orderkey, l_linenumber,
                  cast(floor(l_linenumber - 4 + 0.5 + 0.5) as bigint) as from_text,
                  cast(floor(l_quantity / 2 + 0.5) as bigint) as from_number,
                  cast(null as varchar) as reason
           from lineitem""",
    ),
    "clean_date": (
        clean_date,
        """select o_orderkey,
                  case when o_orderkey % 60 <> 0 and o_orderkey % 61 <> 0
                       then cast(o_orderdate as date) end as day,
                  case when o_orderkey % 60 = 0
                       then '"Fecha" tiene una fecha que no existe: "31/02/2026".'
                       when o_orderkey % 61 = 0
                       then '"Fecha" deberia ser una fecha, y trae "proximamente".' end as reason
           from orders""",
    ),
    "clean_datetime": (
        clean_datetime,
        """select event_id,
                  case when event_id % 40 <> 0 then cast(floor(epoch(ts)) as bigint) end as at,
                  case when event_id % 40 = 0
                       then '"Registrado" deberia ser una fecha, y trae "2024-13-01 10:00".' end
                    as reason
           from events""",
    ),
    "clean_bool": (
        clean_bool,
        """select o_orderkey, case o_orderstatus when 'F' then true when 'O' then false end as flag,
                  case when o_orderstatus not in ('F', 'O')
                       then '"Pagado" deberia ser si o no, y trae "quiza".' end as reason
           from orders""",
    ),
    "clean_select": (
        clean_select,
        """select c_custkey, case when c_custkey % 33 <> 0 then c_mktsegment end as segment,
                  case when c_custkey % 33 = 0 then
                    '"Segmento" no admite el valor "Inventado". Valores posibles: '
                    || 'AUTOMOBILE, BUILDING, FURNITURE, HOUSEHOLD, MACHINERY.' end as reason
           from customer""",
    ),
    "clean_text": (
        clean_text,
        r"""select doc_id,
                   case when doc_id % 17 <> 0
                        then md5(regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g')) end as digest,
                   case when doc_id % 17 = 0 then 'Falta "Texto", que es obligatorio.' end as reason
            from documents""",
    ),
    "infer_types": (
        infer_types,
        """with n as (select count(*) as total, count(*) filter (o_orderkey % 20 = 0) as twentieth,
                             count(*) filter (o_orderkey % 4 <> 0) as gaps from orders)
           select * from (
             select unnest(['entero', 'importe_texto', 'importe', 'pagado', 'emitido', 'registrado',
                            'buzon', 'linea', 'nota', 'cedula', 'mezcla', 'fecha_envio']) as "column",
                    unnest(['integer', 'text', 'decimal', 'boolean', 'date', 'datetime', 'email',
                            'phone', 'text', 'text', 'text', 'date']) as type,
                    1.0::double as confidence, total, 0::bigint as empty from n
             union all
             select 'casi', 'integer', round((total - twentieth) / total, 6), total, 0 from n
             union all select 'huecos', 'integer', 1.0, total, gaps from n
             union all select 'vacia', 'text', 0.0, total, total from n)""",
    ),
    "leading_zero_guard": (
        leading_zero_guard,
        """select * from (values ('cedula', 'text', true), ('con_signo', 'text', true),
                                 ('fraccion', 'decimal', false), ('pocos', 'integer', true))
           as t("column", type, has_leading_zero)""",
    ),
}
