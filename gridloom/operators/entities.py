"""Entities from flat tables: coerce, resolve relations, deduplicate, keep the reasons.

The outcome of an import is one DataFrame in which every source row is accounted for: kept,
failed with a reason, or dropped for a blank key. One pass over the source gives all three.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import cells_of, column, trimmed
from gridloom.functions.coerce import SPARK_TYPES, Target, coerce
from gridloom.functions.stages import staged
from gridloom.plans.model import ID, KEY, SOURCE, TEXT_LIKE, Entity, Field
from gridloom.session import checkpointed

STATUS, REASON, RAW, ROWS = "__status", "__reason", "__raw", "__rows"
KEPT, FAILED, BLANK = "kept", "failed", "blank"
# Fixed value: the reason for a required relation that is not found. %s is the cell, the field.
NOT_FOUND = 'No encontramos "%s" entre los registros de %s.'
# Fixed value: the reason for a required field that no source column fills.
STORE_MISSING = "Falta un dato obligatorio en esta fila."
#: Rows with a blank link are spread over this many join partitions.
BLANK_SPREAD = 1024


def record_id(entity: str, *parts: Column) -> Column:
    """The same record gets the same id on every run."""
    return F.sha2(F.concat_ws("\x1f", F.lit(entity), *[p.cast("string") for p in parts]), 256)


#: Bits of each part of a packed order.
PART = 62


def packed(*parts: Column) -> Column:
    """One number that orders like the parts, which are integers from 0 to below ``2 ** 62``.

    A struct would do, but its minimum is not a buffer of fixed width, so Spark would sort the
    whole table to find it. At most two parts, and a bit more before them.
    """
    order = parts[0].cast("decimal(38,0)")
    for part in parts[1:]:
        order = order * F.lit(2**PART).cast("decimal(19,0)") + part.cast("decimal(19,0)")
    return order.cast("decimal(38,0)")


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in ``__first``, and how many rows the key has.

    Only the key and a number are aggregated, by hash and before the shuffle, so a key that holds most of
    the table sends one row per task. The other columns are joined to the first rows alone.
    """
    return df.groupBy(key).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias(ROWS))


def lookup(entity: Entity, records: DataFrame) -> DataFrame:
    """``key -> id`` of an imported entity, by display value and then by deduplication value.

    Display values win over deduplication values; among equals the lowest source row wins.
    """
    cells = cells_of(records, [f.name for f in entity.fields])
    if entity.display == entity.dedupe and entity.field(entity.display).type in TEXT_LIKE:
        return records.select(F.col(KEY).alias("key"), F.col(ID).alias("id"))
    by = [entity.display]
    if entity.dedupe and entity.dedupe != entity.display:
        by.append(entity.dedupe)
    candidates = F.array(
        *[
            F.struct(cells[name].link_key.alias("key"), F.lit(rank).alias("rank"))
            for rank, name in enumerate(by)
        ]
    )
    # Records without a source row come first; the id tells equals apart.
    row = F.coalesce(F.col(f"{SOURCE}.row") + 1, F.lit(0))
    tie = F.shiftrightunsigned(F.xxhash64(ID), 2)
    keyed = (
        records.select(ID, row.alias("row"), tie.alias("tie"), F.explode(candidates).alias("c"))
        .where(F.col("c.key").isNotNull())
        .select(
            F.col("c.key").alias("key"), F.col(ID).alias("id"), packed(F.col("c.rank"), F.col("row"), F.col("tie")).alias("order")
        )
    )
    firsts = first_rows(keyed, "key", "order").select(F.col("key").alias("__key"), "__first")
    matched = (F.col("key") == F.col("__key")) & (F.col("order") == F.col("__first"))
    return keyed.join(firsts, matched, "left_semi").select("key", "id")


def resolve(df: DataFrame, key: str, found: DataFrame, into: str, row: str) -> DataFrame:
    """Left join of a normalized key to the ``key -> id`` pairs.

    Keys of the pairs are unique, so no row multiplies. Spark broadcasts the pairs when they
    are small; otherwise both sides are shuffled by key, hot keys are split at run time by
    the adaptive skew join, and blank keys, which match nothing, are spread by row here.
    """
    spread = F.when(
        F.col(key).isNull(), F.pmod(F.xxhash64(column(row)), F.lit(BLANK_SPREAD))
    ).otherwise(F.lit(0))
    pairs = found.select(
        F.col("key").alias("__k"), F.lit(0).cast("bigint").alias("__s"), F.col("id").alias(into)
    )
    left = df.withColumn("__spread", spread.cast("bigint"))
    joined = left.join(
        pairs, (F.col(key) == F.col("__k")) & (F.col("__spread") == F.col("__s")), "left"
    )
    return joined.drop("__k", "__s", "__spread")


def import_entity(
    source: DataFrame,
    entity: Entity,
    row: str,
    lookups: Mapping[str, DataFrame] | None = None,
    sheet: int = 0,
) -> DataFrame:
    """Every source row as a kept record, a failure or a dropped blank key.

    ``row`` is a column of ``source`` with the row number people see, unique in it. Bad rows are
    rejected before keys are compared, so a bad first row does not claim its key.
    """
    lookups = lookups or {}
    linked, cells = trimmed(source)
    del cells[row]
    for field in entity.relations:
        if field.source is None or field.target not in lookups:
            continue
        linked = resolve(
            linked.withColumn(f"__key_{field.name}", cells[field.source].link_key),
            f"__key_{field.name}",
            lookups[field.target],
            f"__ref_{field.name}",
            row,
        )

    texts = {name: cell.text for name, cell in cells.items()}
    plain = [f for f in entity.mapped if f.type != "relation"]
    coerced_rows, coerced = coerce(
        linked,
        {f.name: Target(f.source, f.type, f.name, f.required, f.options) for f in plain},
        cells,
    )
    values, reasons = [], []
    for field in entity.fields:
        if field.name in coerced:
            names_of = coerced[field.name]
            values.append(F.col(names_of.value).alias(field.name))
            reasons.append(F.col(names_of.reason))
            continue
        value = F.lit(None).cast(SPARK_TYPES[field.type])
        if field.type == "relation" and f"__ref_{field.name}" in linked.columns:
            value = F.col(f"__ref_{field.name}")
        values.append(value.alias(field.name))
        if field.required:
            reasons.append(F.when(value.isNull(), _missing(field, texts.get(field.source))))
    reason = F.coalesce(*reasons) if reasons else F.lit(None).cast("string")
    raw = F.array(*texts.values())

    rows = staged(
        coerced_rows.select(
            column(row).cast("bigint").alias("__row"),
            *values,
            F.struct(F.lit(sheet).alias("sheet"), column(row).cast("bigint").alias("row")).alias(SOURCE),
            reason.alias(REASON),
            F.when(reason.isNotNull(), raw).alias(RAW),
            *([cells[entity.field(entity.dedupe).source].link_key.alias(KEY)] if entity.dedupe else []),
        )
    )
    fields = [f.name for f in entity.fields]
    good = F.col(REASON).isNull()
    if not entity.dedupe:
        return rows.select(
            record_id(entity.name, F.lit(sheet), F.col("__row")).alias(ID),
            *fields,
            SOURCE,
            REASON,
            RAW,
            F.lit(1).cast("bigint").alias(ROWS),
            F.when(good, KEPT).otherwise(FAILED).alias(STATUS),
        )

    # A failed row stands for itself, a good row for its key if it is the first of it.
    good_rows = rows.where(good)
    firsts = first_rows(good_rows, KEY, "__row").select("__first", ROWS)
    outcome = rows.join(firsts, good & (F.col("__row") == F.col("__first")), "left").where(
        ~good | F.col("__first").isNotNull()
    )
    return outcome.select(
        record_id(
            entity.name, F.when(good & F.col(KEY).isNotNull(), F.col(KEY)).otherwise(F.concat(F.lit("row "), "__row"))
        ).alias(ID),
        *fields,
        SOURCE,
        F.when(good, F.col(KEY)).alias(KEY),
        REASON,
        RAW,
        F.coalesce(ROWS, F.lit(1)).alias(ROWS),
        F.when(~good, FAILED).when(F.col(KEY).isNull(), BLANK).otherwise(KEPT).alias(STATUS),
    )


def _missing(field: Field, text: Column | None) -> Column:
    """Why a required field without a value is refused."""
    if field.source is None or text is None:
        return F.lit(STORE_MISSING)
    before, between, after = NOT_FOUND.split("%s")
    return F.concat(F.lit(before), text, F.lit(between + field.name + after))


def kept(outcome: DataFrame) -> DataFrame:
    """The records of an entity."""
    return outcome.where(F.col(STATUS) == KEPT).drop(STATUS, REASON, RAW, ROWS)


def failures(outcome: DataFrame, entity: Entity, sheet: str | None = None) -> DataFrame:
    """The rejected rows: where they are, why, and what they held."""
    return outcome.where(F.col(STATUS) == FAILED).select(
        F.lit(entity.title).alias("entity"),
        F.lit(sheet or entity.table).alias("sheet"),
        F.col(f"{SOURCE}.row").alias("row_number"),
        F.col(REASON).alias("reason"),
        F.col(RAW).alias("raw"),
    )


def first_order(batch: DataFrame) -> DataFrame:
    """``batch``, written, with ``__order``: unique, by source row, records without one first."""
    row = F.coalesce(F.col(f"{SOURCE}.row") + 1, F.lit(0))
    # Numbered once, so that rows that repeat a source row are told apart.
    return checkpointed(batch.withColumn("__order", packed(row, F.monotonically_increasing_id())))


def append_new(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The records of ``batch`` whose key is not in ``existing``, one per key: the first by source row.

    Records without a source row come first.
    """
    numbered = first_order(batch)
    firsts = first_rows(numbered, KEY, "__order").join(existing.select(KEY), KEY, "left_anti")
    return numbered.join(firsts.select("__first"), F.col("__order") == F.col("__first"), "left_semi").select(
        *batch.columns
    )
