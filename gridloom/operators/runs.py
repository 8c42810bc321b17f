"""Tables that grow by runs: what is stored stays where it is, and a batch is merged with it when read.

A run is a table bucketed and sorted by one key. New rows become a run of level 0; when a level has
``fanout`` runs they are merged into one of the next. Newer runs win. Joins by the key read runs
bucket by bucket, so only the batch moves.

* :class:`ChangeLog` holds the records of an entity: after-images and, for deletions, markers.
* :class:`KeyIndex` holds the keys of an entity, so that an append finds which of its keys are new
  without reading the table.

Runs are tables of the session's catalog, in the shared warehouse. Merged runs stay until
:meth:`Runs.drop`, because frames that were read before still point to them.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.entities import first_order, first_rows
from gridloom.plans.model import ID, KEY
from gridloom.session import stored

GONE = "__gone"


class Runs:
    """Levelled runs by one key; subclasses say how runs are merged."""

    def __init__(self, spark: SparkSession, key: str, fanout: int = 4, buckets: int | None = None) -> None:
        if fanout < 2:
            raise ValueError("a level is merged when it has two runs at least")
        self.spark, self.key, self.fanout = spark, key, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self._tables: list[str] = []

    def newest_first(self) -> list[DataFrame]:
        return [run for level in self.levels for run in reversed(level)]

    def merged(self, runs: list[DataFrame], oldest: bool) -> DataFrame:
        """One row per key of ``runs``, newest first; ``oldest`` when no older run is left out."""
        raise NotImplementedError

    def _write(self, rows: DataFrame) -> DataFrame:
        name = f"run_{uuid4().hex}"
        # One file per bucket: a task holds what hashes to it.
        dealt = rows.repartition(self.buckets, self.key)
        dealt.write.bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(name)
        self._tables.append(name)
        return self.spark.table(name)

    def add(self, rows: DataFrame) -> None:
        """A new run, and the merges that it makes due."""
        self.levels[0].append(self._write(rows))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            below = any(self.levels[level + 1 :])
            run = self._write(self.merged(list(reversed(self.levels[level])), not below))
            self.levels[level] = []
            self.levels[level + 1].append(run)
            level += 1

    def compact(self) -> None:
        """All runs as one."""
        if self.newest_first():
            run = self._write(self.merged(self.newest_first(), True))
            self.levels = [[] for _ in self.levels]
            self.levels[-1].append(run)

    def drop(self) -> None:
        """Forget everything that was written."""
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self._tables = [[]], []

    def _without(self, rows: DataFrame, runs: list[DataFrame]) -> DataFrame:
        """``rows`` whose key is in none of ``runs``: a join each, without moving a run."""
        for run in runs:
            rows = rows.join(run.select(self.key), self.key, "left_anti")
        return rows


class ChangeLog(Runs):
    """Records under changes: a batch costs what it changes, not what is stored.

    Every key is in a run once. Defined results: a record that is put again replaces the older one whole;
    deleting an unknown id, or one twice, changes nothing; a deleted id may be put again. Rows of one
    batch must have different ids.
    """

    def __init__(self, records: DataFrame, fanout: int = 4, buckets: int | None = None) -> None:
        super().__init__(records.sparkSession, ID, fanout, buckets)
        self.columns = records.columns
        self._schema = records.schema
        self.put(records)

    def put(self, records: DataFrame) -> None:
        """New records and after-images of changed ones."""
        self.add(records.select(self.columns).withColumn(GONE, F.lit(False)))

    def delete(self, ids: DataFrame) -> None:
        marks = ids.select(ID).distinct()
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self._schema if f.name != ID]
        self.add(marks.select(ID, *empty, F.lit(True).alias(GONE)).select(*self.columns, GONE))

    def merged(self, runs: list[DataFrame], oldest: bool) -> DataFrame:
        """A marker is kept as long as an older run may hold its record."""
        parts = [self._without(run, runs[:i]) for i, run in enumerate(runs)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.where(~F.col(GONE)) if oldest else rows

    def read(self) -> DataFrame:
        """The records as of now."""
        return self.merged(self.newest_first(), True).select(self.columns)

    def find(self, ids: DataFrame) -> DataFrame:
        """The records with the given ids: each run is filtered by them before runs are merged."""
        wanted = ids.select(ID).distinct()
        runs = [run.join(wanted, ID, "left_semi") for run in self.newest_first()]
        return self.merged(runs, True).select(self.columns)


class KeyIndex(Runs):
    """The keys of the records of an entity.

    A null key is never in it: records without one are always new, one a batch.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None) -> None:
        super().__init__(spark, KEY, fanout, buckets)

    def merged(self, runs: list[DataFrame], oldest: bool) -> DataFrame:
        rows = runs[0].select(KEY)
        for run in runs[1:]:
            rows = rows.unionByName(run.select(KEY))
        return rows

    def append(self, batch: DataFrame) -> DataFrame:
        """The records of ``batch`` with new keys, one per key: the first by source row. Their keys are
        added, so records that are returned must be written."""
        numbered = first_order(batch)
        firsts = self._without(first_rows(numbered, KEY, "__order"), self.newest_first())
        fresh = numbered.join(firsts.select("__first"), F.col("__order") == F.col("__first"), "left_semi").select(*batch.columns)
        # Written before the index grows: it would find its own keys.
        fresh = stored(fresh, "fresh")
        self.add(fresh.select(KEY).where(F.col(KEY).isNotNull()))
        return fresh

