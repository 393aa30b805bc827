"""Versions as bits of a 64-bit validity mask; every rule is a native bitwise column expression."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import traverse
from graphloom.schema import CorruptBitSlot, DuplicateVersionName, InvalidMerge, VersionLimitExceeded, VersionNotFound, check_depth, conform


class MergeStrategy(Enum):
    UNION = "union"
    INTERSECTION = "intersection"


def bit(slot: int) -> int:
    """The signed 64-bit value of a slot's bit; slot 63 is the sign bit."""
    if not 0 <= slot <= 63:
        raise CorruptBitSlot(slot)
    return (1 << slot) - (1 << 64 if slot == 63 else 0)


def signed(mask: int) -> int:
    mask &= (1 << 64) - 1
    return mask - (1 << 64) if mask >> 63 else mask


def _lit(mask: int) -> Column:
    return F.lit(signed(mask)).cast("long")


def has_any(mask: int, column: str = "validity") -> Column:
    """NULL masks are in no version. IsNotNull reaches the scan."""
    return F.col(column).isNotNull() & (F.col(column).bitwiseAND(_lit(mask)) != 0)


def has_all(mask: int, column: str = "validity") -> Column:
    return F.col(column).isNotNull() & (F.col(column).bitwiseAND(_lit(mask)) == _lit(mask))


def _add(mask: int) -> Column:
    return F.coalesce("validity", F.lit(0).cast("long")).bitwiseOR(_lit(mask))


def _remove(mask: int) -> Column:
    left = F.col("validity").bitwiseAND(_lit(~mask))
    return F.when(left != 0, left)


def mark(rows: DataFrame, slot: int, where: Column | None = None) -> DataFrame:
    """Adds rows (all by default) to the slot's version."""
    new = _add(bit(slot))
    return rows.withColumn("validity", new if where is None else F.when(where, new).otherwise(F.col("validity")))


def unmark(rows: DataFrame, slot: int, where: Column | None = None) -> DataFrame:
    """Takes rows out of the slot's version; an empty mask becomes NULL."""
    new = _remove(bit(slot))
    return rows.withColumn("validity", new if where is None else F.when(where, new).otherwise(F.col("validity")))


def free_slot(versions: DataFrame) -> int:
    used = {r["bit_slot"] for r in versions.select("bit_slot").collect()}  # at most 64 rows
    slot = next((s for s in range(64) if s not in used), None)
    if slot is None:
        raise VersionLimitExceeded("all 64 slots are taken")
    return slot


def find(versions: DataFrame, version_id: int):
    row = versions.where(F.col("id") == version_id).first()
    if row is None:
        raise VersionNotFound(version_id)
    return row


def create(versions: DataFrame, version_id: int, name: str, now: int, branch: str = "main", parent_id: int | None = None, description: str | None = None, is_merged: bool = False) -> DataFrame:
    slot = free_slot(versions)
    if not versions.where(F.col("name") == name).isEmpty():
        raise DuplicateVersionName(name)
    if parent_id is not None:
        find(versions, parent_id)
    row = [(version_id, name, branch, parent_id, description, now, is_merged, slot)]
    schema = "id long, name string, branch string, parent_id long, description string, created_at long, is_merged boolean, bit_slot int"
    return conform(versions, "kg_versions").unionByName(versions.sparkSession.createDataFrame(row, schema))


def listed(versions: DataFrame) -> DataFrame:
    return versions.orderBy(F.desc("created_at"), F.desc("id"))


def version_entities(entities: DataFrame, slot: int, kind: str | None = None) -> DataFrame:
    rows = entities.where(has_any(bit(slot)))
    return rows if kind is None else rows.where(F.col("entity_type") == kind)


def version_relations(relations: DataFrame, slot: int, rel_type: str | None = None, source: int | None = None, target: int | None = None) -> DataFrame:
    rows = relations.where(has_any(bit(slot)))
    for name, value in (("rel_type", rel_type), ("source_id", source), ("target_id", target)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def version_neighbors(entities: DataFrame, relations: DataFrame, slot: int, start: int, depth: int) -> DataFrame:
    """Neighbours over relations and entities of the version; none if the start is not in it. Only what is reached is looked up in the version."""
    check_depth(depth, 5)
    e = version_entities(entities, slot)
    r = version_relations(relations, slot)
    if e.where(F.col("id") == start).isEmpty():
        return traverse.neighbors(entities.where(F.col("id") == start), r.limit(0), start, depth)
    return traverse.neighbors(e, r, start, depth, e)


def diff(rows: DataFrame, first: int, second: int) -> DataFrame:
    """id, change: added (in the second slot alone), removed (in the first alone) or common; one scan."""
    a, b = has_any(bit(first)), has_any(bit(second))
    return rows.where(has_any(bit(first) | bit(second))).select("id", F.when(a & b, "common").when(b, "added").otherwise("removed").alias("change"))


def history(rows: DataFrame, versions: DataFrame, entity_id: int) -> DataFrame:
    """Versions that hold the entity, newest first."""
    mask = rows.where(F.col("id") == entity_id).select("validity").first()
    held = mask["validity"] if mask is not None and mask["validity"] is not None else 0
    slots = [s for s in range(64) if held & bit(s)]
    return listed(versions.where(F.col("bit_slot").isin(slots) if slots else F.lit(False)))


def merge(entities: DataFrame, relations: DataFrame, slots: list[int], target: int, strategy: MergeStrategy) -> tuple[DataFrame, DataFrame]:
    """Both tables with the target slot set on rows in any (union) or all (intersection) of the slots."""
    if len(slots) < 2:
        raise InvalidMerge("two versions at least")
    mask = 0
    for s in slots:
        mask |= bit(s) & ((1 << 64) - 1)
    rule = has_any(mask) if strategy is MergeStrategy.UNION else has_all(mask)
    return mark(entities, target, rule), mark(relations, target, rule)
