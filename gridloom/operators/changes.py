"""Batches of changes to a built table: create, patch and delete under referential rules.

Tables are not updated in place: each function returns the new table and an outcome with one
row per request, so the caller writes a new version and reports what was refused.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.cells import cell_of
from gridloom.functions.stages import staged
from gridloom.functions.strict import with_strict
from gridloom.operators.entities import record_id
from gridloom.plans.model import CREATED, ID, KEY, SOURCE, UPDATED, Entity, Field

REQUEST, ACCEPTED, REASON = "request", "accepted", "reason"
# The reasons given.
NO_RECORD = "No encontramos ese registro."
MISSING_TARGET = "Este registro apunta a otro que ya no existe. Elige uno de la lista."
IN_USE = "No se puede eliminar este registro porque %s depende de el."


def _refuse_unknown(columns: Sequence[str], entity: Entity, known: Sequence[str]) -> None:
    unknown = set(columns) - {f.name for f in entity.fields} - set(known)
    if unknown:
        raise ValueError(f"{entity.name} has no fields {sorted(unknown)}")


def _check_references(
    df: DataFrame, entity: Entity, targets: Mapping[str, DataFrame], reason: Column
) -> DataFrame:
    """Add the reason: the one given, or that a relation points to no record.

    Each check looks up the ids the batch refers to, so the target is filtered and not joined
    whole; a batch that refers to one id many times asks for it once.
    """
    missing = F.lit(False)
    for field in entity.relations:
        if field.name not in df.columns or field.target not in targets:
            continue
        wanted = df.select(F.col(field.name).alias(ID)).where(F.col(ID).isNotNull()).distinct()
        found = targets[field.target].select(ID).join(wanted, ID, "left_semi")
        flag = f"__found_{field.name}"
        # Blank relations match nothing; keys of their own keep them from meeting in one task.
        key = F.coalesce(F.col(field.name), F.concat(F.lit("\0"), F.col(REQUEST).cast("string")))
        df = df.join(found.select(F.col(ID).alias(flag)), key == F.col(flag), "left")
        missing = missing | (F.col(field.name).isNotNull() & F.col(flag).isNull())
    checked = df.withColumn(REASON, F.coalesce(reason, F.when(missing, MISSING_TARGET)))
    return checked.drop(*[c for c in checked.columns if c.startswith("__found_")])


def create_records(
    batch: DataFrame,
    entity: Entity,
    batch_name: str,
    targets: Mapping[str, DataFrame] | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """Validate new records: one row per request with its values, id and reason.

    ``batch`` has a unique ``request`` column and the fields it sets; a field left out is
    null. Unknown fields are an error.
    """
    _refuse_unknown(batch.columns, entity, [REQUEST])
    given = set(batch.columns)
    for field in entity.fields:
        if field.name not in given:
            batch = batch.withColumn(field.name, F.lit(None).cast("string"))
    reasons = [F.col(f"__reason_{f.name}") for f in entity.fields]
    validated = with_strict(batch, entity.fields).select(
        REQUEST,
        *[F.col(f"__value_{f.name}").alias(f.name) for f in entity.fields],
        F.coalesce(*reasons).alias("__invalid"),
    )
    checked = _check_references(
        staged(validated),
        entity,
        targets or {},
        F.col("__invalid"),
    ).drop("__invalid")
    stamp = F.lit(now or datetime.now(timezone.utc))
    created = checked.withColumn(
        ID, record_id(entity.name, F.lit(batch_name), F.col(REQUEST))
    ).withColumn(ACCEPTED, F.col(REASON).isNull())
    if entity.dedupe:
        kind = created.schema[entity.dedupe].dataType
        created = created.withColumn(KEY, cell_of(F.col(entity.dedupe), kind).link_key)
    return created.withColumns(
        {
            SOURCE: F.lit(None).cast("struct<sheet:int,row:bigint>"),
            CREATED: stamp,
            UPDATED: stamp,
        }
    )


def with_created(records: DataFrame, outcome: DataFrame) -> DataFrame:
    """The table with the accepted new records."""
    new = outcome.where(ACCEPTED)
    return records.unionByName(new.select(*[c for c in records.columns if c in new.columns]))


def patch_requests(
    patches: DataFrame,
    records: DataFrame,
    entity: Entity,
    targets: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Validate patches: one row per request with the values it sets and its reason.

    A patch has a unique ``request`` number, the ``id`` it changes, ``set`` (the names of the
    fields present) and those fields. A present null clears an optional field.
    """
    _refuse_unknown(patches.columns, entity, [REQUEST, ID, "set"])
    fields = [f for f in entity.fields if f.name in patches.columns]
    names = F.array(*[F.lit(f.name) for f in fields]).cast("array<string>")
    values, reasons = [], []
    for field in fields:
        present = F.array_contains("set", field.name)
        values.append(F.when(present, F.col(f"__value_{field.name}")).alias(field.name))
        reasons.append(F.when(present, F.col(f"__reason_{field.name}")))
    unknown = F.array_except("set", names)
    reasons.append(F.when(F.size(unknown) > 0, F.concat(F.lit("Campo desconocido: "), unknown[0])))
    checked = with_strict(patches, fields)
    validated = staged(
        checked.select(REQUEST, ID, "set", *values, F.coalesce(*reasons).alias("__invalid"))
    )
    wanted = validated.select(ID).distinct()
    found = records.select(ID).join(wanted, ID, "left_semi").select(F.col(ID).alias("__id"))
    known = validated.join(found, F.col(ID) == F.col("__id"), "left")
    reason = F.coalesce(F.col("__invalid"), F.when(F.col("__id").isNull(), NO_RECORD))
    return (
        _check_references(known, entity, targets or {}, reason)
        .drop("__invalid", "__id")
        .withColumn(ACCEPTED, F.col(REASON).isNull())
    )


def with_patched(
    records: DataFrame, outcome: DataFrame, entity: Entity, now: datetime | None = None
) -> DataFrame:
    """The table with accepted patches applied in request order, later ones on top."""
    fields = [f.name for f in entity.fields if f.name in outcome.columns]
    accepted = outcome.where(F.col(ACCEPTED) & (F.size("set") > 0))

    # The last request that sets a field is a number per field; its value is joined afterwards.
    last = [F.max(F.when(F.array_contains("set", n), F.col(REQUEST))).alias(f"__last_{n}") for n in fields]
    folded = accepted.groupBy(F.col(ID).alias("__patched")).agg(*last)
    for name in fields:
        new = accepted.where(F.array_contains("set", name)).select(
            F.col(REQUEST).alias("__request"), F.struct(F.col(name).alias("value")).alias(f"__new_{name}")
        )
        folded = folded.join(new, F.col(f"__last_{name}") == F.col("__request"), "left").drop("__request")
    joined = records.join(folded, F.col(ID) == F.col("__patched"), "left")
    changed = {
        name: F.when(F.col(f"__new_{name}").isNotNull(), F.col(f"__new_{name}.value")).otherwise(
            F.col(name)
        )
        for name in fields
    }
    if UPDATED in records.columns:
        stamp = F.lit(now or datetime.now(timezone.utc))
        changed[UPDATED] = F.when(F.col("__patched").isNotNull(), stamp).otherwise(F.col(UPDATED))
    return joined.withColumns(changed).select(*records.columns)


def delete_requests(
    ids: DataFrame,
    records: DataFrame,
    entity: Entity,
    children: Sequence[tuple[Entity, Field, DataFrame]] = (),
) -> DataFrame:
    """Check ids to delete: refused when unknown or when another table refers to them.

    A referring table may be far larger than the batch, so it is filtered by the batch and
    reduced to the ids it uses before anything is joined back.
    """
    wanted = ids.select(ID).distinct()
    found = records.select(ID).join(wanted, ID, "left_semi").withColumn("__known", F.lit(True))
    checked = wanted.join(found, ID, "left")
    reasons = [F.when(F.col("__known").isNull(), NO_RECORD)]
    for n, (child, field, rows) in enumerate(children):
        used = (
            rows.select(F.col(field.name).alias(ID))
            .join(wanted, ID, "left_semi")
            .distinct()
            .withColumn(f"__used_{n}", F.lit(True))
        )
        checked = checked.join(used, ID, "left")
        reason = MISSING_TARGET if child.name == entity.name else IN_USE % child.title
        reasons.append(F.when(F.col(f"__used_{n}"), reason))
    return checked.select(ID, F.coalesce(*reasons).alias(REASON)).withColumn(
        ACCEPTED, F.col(REASON).isNull()
    )


def without_deleted(records: DataFrame, outcome: DataFrame) -> DataFrame:
    """The table without the accepted deletions."""
    return records.join(outcome.where(ACCEPTED).select(ID), ID, "left_anti")
