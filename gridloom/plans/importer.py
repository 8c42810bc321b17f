"""The import of a whole model: every entity, in dependency order, written in one pass each."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import entities as E
from gridloom.plans.model import Entity, Model
from gridloom.session import small_methods
from gridloom.sources.report import stamped


@dataclass(frozen=True)
class Table:
    """A source table: its rows, the column with the row number, and the name people see."""

    rows: DataFrame
    row: str
    label: str | None = None
    sheet: int = 0


@dataclass(frozen=True)
class Imported:
    """The outcomes of an import, by entity."""

    model: Model
    tables: Mapping[str, Table]
    outcomes: Mapping[str, DataFrame]

    def records(self, entity: str) -> DataFrame:
        return E.kept(self.outcomes[entity])

    def failures(self) -> DataFrame:
        parts = [
            E.failures(self.outcomes[e.name], e, self.tables[e.table].label)
            for e in self.model.entities
        ]
        return reduce(DataFrame.unionByName, parts)

    def counts(self) -> DataFrame:
        """Rows by entity and status."""
        parts = [
            self.outcomes[e.name]
            .groupBy(E.STATUS)
            .agg(F.count(F.lit(1)).alias("groups"), F.sum(E.ROWS).alias("rows"))
            .select(F.lit(e.name).alias("entity"), F.col(E.STATUS).alias("status"), "groups", "rows")
            for e in self.model.entities
        ]
        return reduce(DataFrame.unionByName, parts)

    def summary(self) -> DataFrame:
        """One row: entities, records, relations, failed rows and rows dropped for a blank key."""

        def total(status: str, what: str):
            return F.coalesce(
                F.sum(F.when(F.col("status") == status, F.col(what))), F.lit(0)
            ).cast("bigint")

        return self.counts().agg(
            F.lit(len(self.model.entities)).alias("modules"),
            total(E.KEPT, "groups").alias("records"),
            F.lit(self.model.relation_count).alias("relations"),
            total(E.FAILED, "rows").alias("failed_rows"),
            total(E.BLANK, "rows").alias("blank_key_rows"),
        )


def plan_import(model: Model, tables: Mapping[str, Table]) -> Imported:
    """The import as lazy DataFrames."""
    outcomes: dict[str, DataFrame] = {}
    for entity in model.ordered():
        table = tables[entity.table]
        outcomes[entity.name] = _outcome(entity, table, _lookups(model, entity, outcomes))
    return Imported(model, tables, outcomes)


def run_import(
    spark: SparkSession, model: Model, tables: Mapping[str, Table], path: str, now: datetime
) -> Imported:
    """Write every outcome below ``path``, partitioned by status.

    One pass over a source gives its records, failures and dropped rows together; lookups for
    later entities read the records just written.
    """
    outcomes: dict[str, DataFrame] = {}
    for entity in model.ordered():
        outcome = _outcome(entity, tables[entity.table], _lookups(model, entity, outcomes))
        where = f"{path}/{entity.name}"
        with small_methods(spark):
            stamped(outcome, now).write.partitionBy(E.STATUS).mode("overwrite").parquet(where)
        outcomes[entity.name] = spark.read.parquet(where)
    return Imported(model, tables, outcomes)


def _outcome(entity: Entity, table: Table, lookups: Mapping[str, DataFrame]) -> DataFrame:
    return E.import_entity(table.rows, entity, table.row, lookups, table.sheet)


def _lookups(model: Model, entity: Entity, outcomes: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    targets = {f.target for f in entity.relations}
    return {t: E.lookup(model.by_name[t], E.kept(outcomes[t])) for t in targets}
