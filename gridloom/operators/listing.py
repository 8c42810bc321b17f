"""Lists over the built tables: search, count, pages, pickers, lookups and labels."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.cells import as_ntz, cell_of
from gridloom.plans.model import ID, TEXT_LIKE, Entity
from gridloom.session import checkpointed

# Sizes of pages and pickers.
PAGE, MAX_PAGE = 25, 100
PICKER, MAX_PICKER = 20, 50
# How labels are named and shown.
LABEL_PREFIX = "__rel_"
NO_NAME = "(sin nombre)"
#: Pages that end beyond this row are found by position instead of by a top-k.
DEEP = 1_000


def label_text(column: Column, data_type: T.DataType) -> Column:
    """A value as it is shown: dates without time, numbers in their shortest form."""
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return as_ntz(column, data_type).cast("date").cast("string")
    if isinstance(data_type, T.StringType):
        return column
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return F.when(column.isNotNull(), cell_of(column, data_type).text)
    return F.lit(None).cast("string")


def search_columns(entity: Entity) -> list[str]:
    """Text columns of the entity, led by the display column when it is not one of them."""
    names = [f.name for f in entity.fields if f.type in TEXT_LIKE]
    if entity.display not in names:
        names.insert(0, entity.display)
    return names


def _contains(columns: list[Column], text: str) -> Column:
    # A backslash quotes the character after it; Spark only allows it before a wildcard.
    pattern = "%" + re.sub(r"\\(.)", lambda m: m[0] if m[1] in "%_\\" else m[1], text, flags=re.DOTALL) + "%"
    return reduce(or_, [c.ilike(pattern) for c in columns])


def search(
    records: DataFrame,
    entity: Entity,
    text: str | None,
    targets: Mapping[str, tuple[Entity, DataFrame]] | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Records with ``text`` somewhere in their text columns, or in the ``columns`` named.

    ``%`` and ``_`` are wildcards. A relation is searched by the label it shows, when its target
    is given.
    """
    if not text:
        return records
    names = search_columns(entity) if columns is None else columns
    if not names:
        return records
    labels = {}
    if entity.field(entity.display).type == "relation" and targets:
        field = entity.field(entity.display)
        records = _with_label(records, field.name, *targets[field.target], "__label")
        labels[field.name] = F.col("__label")
    searched = [labels.get(n, F.col(n)).cast("string") for n in names]
    return records.where(_contains(searched, text)).drop("__label")


def count_records(records: DataFrame) -> DataFrame:
    """The total of a list; taken before labels are joined."""
    return records.agg(F.count(F.lit(1)).alias("total"))


def _with_label(
    records: DataFrame, field: str, target: Entity, target_records: DataFrame, into: str
) -> DataFrame:
    shown = target_records.schema[target.display].dataType
    labels = target_records.select(
        F.col(ID).alias("__target"), label_text(F.col(target.display), shown).alias(into)
    )
    # Blank relations match nothing; keys of their own keep them from meeting in one task.
    key = F.coalesce(F.col(field), F.concat(F.lit("\0"), F.col(ID)))
    return records.join(labels, key == F.col("__target"), "left").drop("__target")


def _with_code(records: DataFrame, field: str, target: Entity, target_records: DataFrame) -> DataFrame:
    """Add ``__sort``, a number that orders like the label that a relation shows.

    Labels are sorted and numbered among themselves, so that only a number per target record is joined.
    """
    shown = target_records.schema[target.display].dataType
    labels = target_records.select(F.col(ID).alias("__target"), label_text(F.col(target.display), shown).alias("__label"))
    different = labels.select("__label").where("__label IS NOT NULL").distinct()
    # Dealt by range and sorted, so that increasing ids increase with the labels. Written, as they are
    # taken once and for all.
    numbered = checkpointed(
        different.repartitionByRange("__label").sortWithinPartitions("__label")
        .select(F.col("__label").alias("__same"), F.monotonically_increasing_id().alias("__sort"))
    )
    codes = labels.join(numbered, F.col("__label") == F.col("__same")).select("__target", "__sort")
    key = F.coalesce(F.col(field), F.concat(F.lit("\0"), F.col(ID)))
    return records.join(codes, key == F.col("__target"), "left").drop("__target")


def with_labels(
    records: DataFrame, entity: Entity, targets: Mapping[str, tuple[Entity, DataFrame]]
) -> DataFrame:
    """Add the label of each related record: one left join per relation."""
    for field in entity.relations:
        if field.target in targets:
            records = _with_label(
                records, field.name, *targets[field.target], LABEL_PREFIX + field.name
            )
    return records


def sort_column(
    records: DataFrame, entity: Entity, name: str, targets: Mapping[str, tuple[Entity, DataFrame]], into: str
) -> DataFrame:
    """Add what a field sorts by: its value, or the label it shows."""
    field = entity.field(name)
    if field.type == "relation" and field.target in targets:
        return _with_label(records, field.name, *targets[field.target], into)
    return records.withColumn(into, F.col(field.name))


def list_page(
    records: DataFrame,
    entity: Entity,
    targets: Mapping[str, tuple[Entity, DataFrame]] | None = None,
    sort: str | None = None,
    descending: bool = False,
    limit: int = PAGE,
    offset: int = 0,
    deep: int = DEEP,
) -> DataFrame:
    """One page: sorted with nulls last and the id as tie-break, labels joined to the page only.

    A relation sorts by the label it shows, which is joined as a number. The first rows come from a
    top-k; a page that ends beyond ``deep`` rows is located by row position.
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"a page has 1 to {MAX_PAGE} records and starts at 0 or later")
    targets = targets or {}
    field = entity.field(sort or entity.display)
    by_label = field.type == "relation" and field.target in targets
    if by_label:
        keyed = _with_code(records.select(ID, field.name), field.name, *targets[field.target])
    else:
        keyed = records.withColumn("__sort", F.col(field.name))
    order = F.col("__sort").desc_nulls_last() if descending else F.col("__sort").asc_nulls_last()
    if offset + limit <= deep:
        page = keyed.orderBy(order, ID).offset(offset).limit(limit)
    else:
        page = _deep_page(keyed, order, offset, limit)
    if by_label:
        # At most MAX_PAGE ids and codes; the records were not moved to find them.
        page = records.join(F.broadcast(page.select(ID, "__sort")), ID).select(*records.columns, "__sort")
    if not any(f.target in targets for f in entity.relations):
        return page.orderBy(order, ID).drop("__sort")
    # At most MAX_PAGE rows: fetched once, so that each target table is only filtered by the
    # ids the page refers to and never shuffled.
    page = page.sparkSession.createDataFrame(page.toArrow(), page.schema)
    for relation in entity.relations:
        if relation.target in targets:
            target, rows = targets[relation.target]
            wanted = page.select(F.col(relation.name).alias(ID)).distinct()
            near = rows.join(F.broadcast(wanted), ID, "left_semi")
            page = _with_label(page, relation.name, target, near, LABEL_PREFIX + relation.name)
    return page.orderBy(order, ID).drop("__sort")


def _deep_page(keyed: DataFrame, order: Column, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the sorted table without gathering the rows
    before them: sort keys are range-partitioned and written once, partitions are counted, and
    only the partitions the page falls in are ranked."""
    keys = keyed.select("__sort", ID)
    ranged = checkpointed(
        keys.repartitionByRange(order, F.col(ID)).withColumn("__part", F.spark_partition_id())
    )
    # One row per partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(
        "__part", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    ).where((F.col("__start") < offset + limit) & (F.col("__start") + F.col("__n") > offset))
    within = Window.partitionBy("__part").orderBy(order, ID)
    position = F.col("__start") + F.row_number().over(within)
    page = (
        # At most one row per range partition.
        ranged.join(F.broadcast(starts), "__part")
        .withColumn("__at", position)
        .where((F.col("__at") > offset) & (F.col("__at") <= offset + limit))
        .select(ID)
    )
    return keyed.join(F.broadcast(page), ID, "left_semi")  # at most MAX_PAGE ids


def find_records(
    records: DataFrame,
    entity: Entity,
    ids: DataFrame,
    targets: Mapping[str, tuple[Entity, DataFrame]] | None = None,
) -> DataFrame:
    """The records with the given ids, labels joined."""
    found = records.join(ids.select(ID), ID, "left_semi")
    return with_labels(found, entity, targets or {})


def picker_options(
    records: DataFrame, entity: Entity, text: str | None = None, limit: int = PICKER
) -> DataFrame:
    """Id and label of the records to choose from, by label."""
    if not 1 <= limit <= MAX_PICKER:
        raise ValueError(f"a picker offers 1 to {MAX_PICKER} records")
    display = F.col(entity.display)
    if text:
        records = records.where(_contains([display.cast("string")], text))
    shown = label_text(display, records.schema[entity.display].dataType)
    return (
        records.orderBy(display.asc_nulls_last(), ID)
        .limit(limit)
        .select(ID, F.coalesce(shown, F.lit(NO_NAME)).alias("label"))
    )
