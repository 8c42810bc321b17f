"""The model that needs no decisions: a table per sheet, every column with its voted type."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.plans.model import Entity, Field


def auto_model(profile: DataFrame, table: str) -> Entity:
    """An entity with all columns of a profiled table, none of them required.

    The profile of one table has a row per column, so it is read on the driver.
    """
    columns = (
        profile.where(profile["table"] == table)
        .select("column", "position", "header_key", "type")
        .orderBy("position")
        .collect()
    )
    used: set[str] = set()
    fields = []
    for column in columns:
        base = column.header_key or f"columna_{column.position + 1}"
        name, suffix = base, 2
        while name in used:
            name, suffix = f"{base}_{suffix}", suffix + 1
        used.add(name)
        fields.append(Field(name, column.type, source=column.column))
    return Entity(table, table, tuple(fields), display=display_field(fields))


def display_field(fields: list[Field]) -> str:
    """First text field, else first that is not a boolean, else the first."""
    ranked = sorted(fields, key=lambda f: (f.type != "text", f.type == "boolean"))
    return ranked[0].name
