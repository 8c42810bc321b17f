"""The model: entities, their fields and their references. Plain configuration."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from graphlib import TopologicalSorter

from gridloom.functions.coerce import SPARK_TYPES

# The system columns of an entity table.
ID, KEY, SOURCE = "id", "__dedupe_key", "__source"
CREATED, UPDATED = "created_at", "updated_at"
# Fixed value: options a closed list may have.
MAX_OPTIONS = 50

TEXT_LIKE = ("text", "email", "phone")


@dataclass(frozen=True)
class Field:
    """One column of an entity. ``source`` is a column of the source table; ``target`` is
    the entity a relation points to."""

    name: str
    type: str = "text"
    source: str | None = None
    required: bool = False
    options: tuple[str, ...] = ()
    target: str | None = None

    def __post_init__(self) -> None:
        if self.type not in SPARK_TYPES:
            raise ValueError(f"unknown field type {self.type!r}")
        if (self.type == "relation") != (self.target is not None):
            raise ValueError(f"field {self.name!r}: a relation, and only one, has a target")
        if len(self.options) > MAX_OPTIONS:
            raise ValueError(f"field {self.name!r} has more than {MAX_OPTIONS} options")


@dataclass(frozen=True)
class Entity:
    """A table to build. ``dedupe`` names the field whose normalized value identifies a
    record; without it every source row is a record."""

    name: str
    table: str
    fields: tuple[Field, ...]
    display: str
    dedupe: str | None = None
    label: str | None = None
    derived: bool = False

    def __post_init__(self) -> None:
        self.field(self.display)
        if self.dedupe is not None and self.field(self.dedupe).source is None:
            raise ValueError(f"{self.name}: the deduplication field has no source column")

    def field(self, name: str) -> Field:
        for field in self.fields:
            if field.name == name:
                return field
        raise KeyError(f"{self.name} has no field {name!r}")

    @property
    def title(self) -> str:
        return self.label or self.name

    @property
    def mapped(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.source is not None)

    @property
    def relations(self) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if f.type == "relation")


@dataclass(frozen=True)
class Model:
    entities: tuple[Entity, ...]

    @cached_property
    def by_name(self) -> dict[str, Entity]:
        return {entity.name: entity for entity in self.entities}

    def ordered(self) -> list[Entity]:
        """Entities with every target before the entities that point to it."""
        graph = {e.name: [f.target for f in e.relations] for e in self.entities}
        return [self.by_name[name] for name in TopologicalSorter(graph).static_order()]

    @property
    def relation_count(self) -> int:
        return sum(len(entity.relations) for entity in self.entities)
