"""Checks of a model against the profile, and what the profile suggests for a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.profile import COLUMN, IDENTIFYING
from gridloom.plans.model import Model

# Fixed value: a key with a lower ratio of distinct values fuses rows.
FUSES_BELOW = 0.99


def mapping(spark: SparkSession, model: Model) -> DataFrame:
    """Where each field of the model comes from. A few dozen rows."""
    rows = [
        (e.name, f.name, e.table, f.source, e.derived and f.name == (e.dedupe or e.display))
        for e in model.entities
        for f in e.mapped
    ]
    return spark.createDataFrame(
        rows, "entity string, field string, table string, column string, derived_key boolean"
    )


def unmapped_columns(profile: DataFrame, mapped: DataFrame) -> DataFrame:
    """Profiled columns that no field of the model uses."""
    return profile.select("table", "column", "position").join(
        mapped, ["table", "column"], "left_anti"
    )


def unknown_sources(profile: DataFrame, mapped: DataFrame) -> DataFrame:
    """Fields whose source column does not exist in the profiled tables."""
    return mapped.join(profile, ["table", "column"], "left_anti")


def excluded_sources(mapped: DataFrame, included_tables: DataFrame) -> DataFrame:
    """Fields that come from a table that was left out."""
    return mapped.join(included_tables.select("table"), "table", "left_anti")


def refused_entities(profile: DataFrame, mapped: DataFrame) -> DataFrame:
    """Derived entities whose key identifies every row and so groups nothing."""
    return mapped.where("derived_key").join(
        profile.where(F.col("ratio") >= IDENTIFYING), ["table", "column"]
    ).select("entity", "field", "table", "column", "ratio")


def merge_warnings(profile: DataFrame) -> DataFrame:
    """Columns that would fuse rows when used as a key, and how many."""
    return profile.where((F.col("distinct") > 0) & (F.col("ratio") < FUSES_BELOW)).select(
        "table",
        "column",
        "ratio",
        (F.col("total") - F.col("empty") - F.col("distinct")).alias("fused_rows"),
    )


def fused_keys(stats: DataFrame, limit: int = 20) -> DataFrame:
    """The values of each column that would fuse most rows as a key: key, rows and rank.

    The rank is bounded, so a task sends at most ``limit`` rows per column.
    """
    most = Window.partitionBy(*COLUMN).orderBy(F.desc("n"), "key")
    return (
        stats.where(F.col("key").isNotNull() & (F.col("n") > 1))
        .withColumn("rank", F.row_number().over(most))
        .where(F.col("rank") <= limit)
        .select("table", "column", "rank", "key", F.col("n").alias("rows"))
    )


def entity_candidates(profile: DataFrame) -> DataFrame:
    """Columns that repeat enough to be entities of their own."""
    return profile.where("repeats").select("table", "column", "distinct", "ratio")


def relation_candidates(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Overlaps from a column that repeats to a column that identifies its rows."""
    signals = profile.select("table", "column", "repeats", "identifying")

    def one_way(side_from: str, side_to: str) -> DataFrame:
        source = signals.where("repeats").select(
            F.col("table").alias(f"{side_from}_table"), F.col("column").alias(f"{side_from}_column")
        )
        target = signals.where("identifying").select(
            F.col("table").alias(f"{side_to}_table"), F.col("column").alias(f"{side_to}_column")
        )
        return (
            pairs.join(source, [f"{side_from}_table", f"{side_from}_column"])
            .join(target, [f"{side_to}_table", f"{side_to}_column"])
            .select(
                F.col(f"{side_from}_table").alias("from_table"),
                F.col(f"{side_from}_column").alias("from_column"),
                F.col(f"{side_to}_table").alias("to_table"),
                F.col(f"{side_to}_column").alias("to_column"),
                "containment",
                "shared",
            )
        )

    return one_way("left", "right").unionByName(one_way("right", "left"))
