"""Substring search that skips files.

:func:`write_search_index` writes records in parts and keeps, for every part, which three-letter pieces its
searched texts hold, as hashes to a fixed number of bits. A search reads only the parts that hold all
pieces of what is looked for; the exact test comes last, so a shared bit costs time but never a
result. Text without three letters in a row between wildcards is looked for in all parts.

A text is hashed in one pass over its code points, a slice at a time: taking pieces out of it by
position would walk it from its start for every piece.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from gridloom.operators.listing import search, search_columns
from gridloom.plans.model import ID, Entity

GRAM, BITS, PART = 3, 1 << 16, "__part"
#: An odd number whose multiples spread over all bits.
MIX = 0x9E3779B97F4A7C15
#: Code points hashed at once.
SLICE = 1 << 18
#: Letters of a display value by which records are dealt to parts, so that no whole texts are sampled.
DEALT_BY = 64


def literal_runs(text: str) -> list[str]:
    """What a search text asks for literally: between wildcards, a backslash quoting the next character."""
    runs, at = [""], 0
    while at < len(text):
        if text[at] == "\\" and at + 1 < len(text):
            at += 1
            runs[-1] += text[at]
        elif text[at] in "%_":
            runs.append("")
        else:
            runs[-1] += text[at]
        at += 1
    return [run for run in runs if run]


def _numbers(text: str) -> Iterator[np.ndarray]:
    """The numbers of the pieces of a text, a slice of it at a time."""
    for at in range(0, len(text) - (GRAM - 1), SLICE):
        points = np.frombuffer(text[at : at + SLICE + GRAM - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
        mixed = points[: len(points) - (GRAM - 1)].copy()
        for i in range(1, GRAM):
            mixed = mixed * np.uint64(MIX) + points[i : len(points) - (GRAM - 1) + i]
        yield (mixed * np.uint64(MIX)) >> np.uint64(64 - BITS.bit_length() + 1)


def _part_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each number that a part holds, once per part and task: a task has few parts, and a part BITS numbers at most."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            bits = held.setdefault(part, np.zeros(BITS, bool))
            for numbers in _numbers(text.as_py()):
                bits[numbers] = True
    for part, bits in held.items():
        found = np.flatnonzero(bits).astype("i4")
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), part, "i4")), pa.array(found)], [PART, "bit"])


def write_search_index(
    records: DataFrame, entity: Entity, path: str, columns: list[str] | None = None, parts: int | None = None
) -> SearchIndex:
    """The records in parts by display value, with the pieces of each part, below ``path``.

    ``columns`` are those that may be searched; by default the text columns of the entity.
    """
    spark = records.sparkSession
    names = tuple(search_columns(entity) if columns is None else columns)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Neighbours share pieces, so that a rare one is in few parts.
    shown = F.col(entity.display)
    if isinstance(records.schema[entity.display].dataType, StringType):
        shown = F.substring(shown, 1, DEALT_BY)
    dealt = records.repartitionByRange(parts, shown, F.col(ID)).withColumn(PART, F.spark_partition_id())
    dealt.write.partitionBy(PART).parquet(f"{path}/rows")
    index = SearchIndex(spark, path, entity, names, dealt.schema)
    texts = F.array(*[F.lower(F.col(n).cast("string")) for n in names])
    lowered = index.rows.select(PART, F.explode(texts).alias("text")).where(F.length("text") >= GRAM)
    grams = lowered.mapInArrow(_part_numbers, f"{PART} int, bit int").distinct()
    # At most BITS numbers per part.
    grams.groupBy(PART).agg(F.sort_array(F.collect_list("bit")).alias("bits")).write.parquet(f"{path}/pieces")
    return index


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str
    entity: Entity
    columns: tuple[str, ...]
    schema: StructType

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def parts_with(self, text: str) -> list[int] | None:
        """The parts that may hold ``text``; None for all."""
        runs = [run for run in literal_runs(text) if len(run) >= GRAM]
        if not runs:
            return None
        # Lowered whole, as the test of the search does: a letter may depend on its neighbours.
        lowered = self.spark.range(1).select(*[F.lower(F.lit(run)).alias(f"run_{i}") for i, run in enumerate(runs)]).first()
        wanted = {int(n) for run in lowered for numbers in _numbers(run) for n in numbers}
        pieces = self.spark.read.schema(f"{PART} int, bits array<int>").parquet(f"{self.path}/pieces")
        if wanted:
            pieces = pieces.where(F.size(F.array_except(F.lit(sorted(wanted)), F.col("bits"))) == 0)
        # A number per part.
        found = pieces.select(PART).collect()
        return sorted(r[PART] for r in found)

    def search(self, text: str | None, targets: Mapping[str, tuple[Entity, DataFrame]] | None = None) -> DataFrame:
        """The records with ``text`` somewhere in the searched columns."""
        rows, parts = self.rows, self.parts_with(text) if text else None
        if parts is not None:
            rows = rows.where(F.col(PART).isin(parts))
        return search(rows, self.entity, text, targets, list(self.columns)).drop(PART)
