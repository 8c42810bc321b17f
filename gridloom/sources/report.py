"""What an import leaves behind: entity tables, the failure report and the summary."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.coerce import SPARK_TYPES
from gridloom.plans.model import CREATED, ID, KEY, SOURCE, UPDATED, Entity

# Fixed value: failures kept in the report.
MAX_REPORTED = 500
# Columns of the report file.
REPORT_COLUMNS = {"sheet": "Hoja", "row_number": "Fila", "entity": "Modulo", "reason": "Motivo"}


def stamped(records: DataFrame, now: datetime) -> DataFrame:
    """Add the creation and change times, one instant for the whole job."""
    return records.withColumns({CREATED: F.lit(now), UPDATED: F.lit(now)})


def typed(records: DataFrame, entity: Entity) -> DataFrame:
    """The columns of an entity table, in order and with their declared types."""
    system = [c for c in (KEY, SOURCE, CREATED, UPDATED) if c in records.columns]
    return records.select(
        ID, *[F.col(f.name).cast(SPARK_TYPES[f.type]).alias(f.name) for f in entity.fields], *system
    )


def write_entity(records: DataFrame, entity: Entity, path: str, mode: str = "errorifexists") -> None:
    typed(records, entity).write.mode(mode).parquet(path)


def read_entity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def report(failures: DataFrame, limit: int = MAX_REPORTED) -> DataFrame:
    """The first failures by sheet and row, for people. The full table is kept elsewhere."""
    return failures.orderBy("sheet", "row_number", "entity").limit(limit)


def write_report(failures: DataFrame, path: str, limit: int = MAX_REPORTED) -> None:
    rows = report(failures, limit).select(
        *[F.col(name).alias(title) for name, title in REPORT_COLUMNS.items()]
    )
    # At most ``limit`` rows, in order: one file.
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
