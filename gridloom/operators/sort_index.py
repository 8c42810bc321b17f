"""Pages from a sorted copy of a list.

:func:`write_index` sorts a list once: rows are dealt by range, sorted within their partition and numbered in
that order, and a small table has the number of rows and the last key of every partition. A page
is then a range of numbers in one or two partitions, which the file statistics find; nothing is sorted or
counted again. A page is asked for by offset, or by the last row seen, which also works after that
row is gone.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridloom.operators.listing import MAX_PAGE, sort_column
from gridloom.plans.model import ID, Entity

SORT, PART, AT = "__sort", "__part", "__at"
#: Bits of the place within a partition in Spark's increasing ids.
PLACE_BITS = 33


def _order(descending: bool) -> list[Column]:
    return [F.col(SORT).desc_nulls_last() if descending else F.col(SORT).asc_nulls_last(), F.col(ID).asc()]


def write_index(
    records: DataFrame, entity: Entity, path: str, sort: str | None = None, descending: bool = False,
    targets: Mapping[str, tuple[Entity, DataFrame]] | None = None, parts: int | None = None,
) -> SortIndex:
    """The records in the order of a field (nulls last, then by id), below ``path``.

    A relation sorts by the label it shows, when its target is given.
    """
    spark = records.sparkSession
    keyed = sort_column(records, entity, sort or entity.display, targets or {}, SORT)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, *_order(descending)).sortWithinPartitions(*_order(descending))
    number = F.monotonically_increasing_id()
    numbered = ordered.withColumn(AT, number).withColumn(PART, F.shiftright(AT, PLACE_BITS)).withColumn(
        AT, F.col(AT).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    )
    numbered.write.partitionBy(PART).parquet(f"{path}/rows")
    index = SortIndex(spark, path, numbered.schema, descending)
    rows = index.rows
    last = rows.groupBy(PART).agg(F.max(AT).alias("last"))
    # A row per partition.
    ends = rows.join(F.broadcast(last), PART).where(F.col(AT) == F.col("last")).select(PART, "last", SORT, ID)
    ends.write.parquet(f"{path}/fences")
    return index


@dataclass(frozen=True)
class SortIndex:
    spark: SparkSession
    path: str
    schema: StructType
    descending: bool = False

    @cached_property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    @cached_property
    def fences(self) -> list:
        """Partition, rows before it, its rows, and its last key: one entry per range partition."""
        start, out = 0, []
        fields = [f if f.name != AT else StructField("last", f.dataType) for f in self.schema if f.name in (PART, AT, SORT, ID)]
        ends = self.spark.read.schema(StructType(fields)).parquet(f"{self.path}/fences").collect()
        for r in sorted(ends, key=lambda r: r[PART]):
            out.append((r[PART], start, r["last"] + 1, r[SORT], r[ID]))
            start += r["last"] + 1
        return out

    @property
    def total(self) -> int:
        return sum(n for _, _, n, _, _ in self.fences)

    def scan(self, offset: int, limit: int) -> DataFrame:
        """The rows of a page, in no order: a filter on partitions and places."""
        wanted = F.lit(False)
        for part, start, n, _, _ in self.fences:
            low, high = max(offset - start, 0), min(offset + limit - start, n)
            if low < high:
                wanted = wanted | ((F.col(PART) == part) & F.col(AT).between(low, high - 1))
        return self.rows.where(wanted)

    def page(self, limit: int = 25, offset: int = 0) -> DataFrame:
        """Rows ``offset`` to ``offset + limit``, in order."""
        if not 1 <= limit <= MAX_PAGE or offset < 0:
            raise ValueError(f"a page has 1 to {MAX_PAGE} records and starts at 0 or later")
        # At most MAX_PAGE rows, which are put in order here.
        found = self.scan(offset, limit).toArrow().sort_by([(PART, "ascending"), (AT, "ascending")])
        schema = self.rows.drop(PART, AT, SORT).schema
        return self.spark.createDataFrame(found.select(schema.names), schema)

    def _beyond(self, value, row_id: str) -> Column:
        """Whether a row comes after the one with this value and id."""
        after = F.col(ID) > row_id
        if value is None:
            return F.col(SORT).isNull() & after
        further = F.col(SORT) < F.lit(value) if self.descending else F.col(SORT) > F.lit(value)
        return further | F.col(SORT).isNull() | ((F.col(SORT) == F.lit(value)) & after)

    def position_after(self, value, row_id: str) -> int:
        """How many rows come before the first one after this value and id."""
        for part, start, _, last, last_id in self.fences:
            if not self._passed(last, last_id, value, row_id):
                within = self.rows.where((F.col(PART) == part) & self._beyond(value, row_id))
                return start + within.agg(F.min(AT)).first()[0]
        return self.total

    def _passed(self, last, last_id: str, value, row_id: str) -> bool:
        """Whether all of a partition that ends with ``last`` is at or before the given row."""
        if (last is None) != (value is None):
            return last is not None
        if last == value:
            return last_id <= row_id
        return (last > value) if self.descending else (last < value)

    def after(self, value, row_id: str, limit: int = 25) -> DataFrame:
        """The page that follows the row with this sort value and id."""
        return self.page(limit, self.position_after(value, row_id))
