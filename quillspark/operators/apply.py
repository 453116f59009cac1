"""Planning and applying the changes that a comparison found, and edits of loaded rows.

A plain table has no row-level changes: the next version of the table is computed in one job and committed as a whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import diff
from quillspark.shared import settled
from quillspark.sources.versioned import Refused, Version, VersionedTable


def matches(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(and_, (left[k].eqNullSafe(right[k]) for k in keys))


def apply_changes(target: DataFrame, classified: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """The target after inserts, updates and deletes. Updates set the requested columns, or all that changed."""
    columns = target.columns
    rest = [c for c in columns if c not in keys]
    have = set(classified.schema["source_row"].dataType.names)

    def value(c: str) -> Column:
        old, new = F.col(f"target_row.{c}"), F.col(f"source_row.{c}") if c in have else F.lit(None)
        if c in keys:
            return F.coalesce(old, new)
        take = F.lit(c in have and (not update or c in update))
        return F.when(F.col("status") == "source_only", new).when((F.col("status") == "value_changed") & take, new).otherwise(old)

    return classified.where("status != 'target_only'").select(*(value(c).alias(c) for c in columns)) if rest else classified.where("status != 'target_only'").select(*keys)


def action_counts(classified: DataFrame, table: str) -> DataFrame:
    """table_name, action, attempted_rows of what is to be done."""
    return classified.where("status != 'unchanged'").groupBy(F.lit(table).alias("table_name"), "action").agg(F.count("*").alias("attempted_rows"))


def missing_selections(selection: DataFrame, classified: DataFrame, keys: list[str]) -> DataFrame:
    """Selected keys that the comparison doesn't have; any such row is an error for the caller."""
    return selection.join(classified, matches(selection, classified, keys), "left_anti")


def conflicts(updates: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are both updated and deleted."""
    return updates.join(deletes, matches(updates, deletes, keys), "left_semi").select(*keys).distinct()


def overlay(loaded: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Loaded rows with pending edits on top; an edit to null shows the loaded value."""
    edited = [c for c in edits.columns if c not in keys]
    e = edits.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(F.col(c).alias(f"_e_{c}") for c in edited))
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    return loaded.join(e, on, "left").select(*(F.coalesce(f"_e_{c}", c).alias(c) if c in edited else F.col(c) for c in loaded.columns))


def group_edits(cells: DataFrame, key: str = "row_key") -> DataFrame:
    """Edited cells (key, column_name, before_value, next_value) by row: no-ops go, cells are sorted by column."""
    changed = cells.where(~F.col("before_value").eqNullSafe(F.col("next_value")))
    return changed.groupBy(key).agg(F.count("*").alias("change_count"), F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("columns"))


def blockers(expires_at: float, now: float, snapshot_then: str, snapshot_now: str, readonly: bool, deletes: int, most_deletes: int, empty_keys: int) -> list[tuple[str, str]]:
    """(code, severity) of what stands against an apply."""
    found = [
        ("compare_expired", "error", now > expires_at),
        ("target_changed", "error", snapshot_then != snapshot_now),
        ("readonly_target", "error", readonly),
        ("empty_key", "error", empty_keys > 0),
        ("many_deletes", "warning", deletes > most_deletes),
    ]
    return [(code, severity) for code, severity, holds in found if holds]


class MissingSelection(ValueError):
    """Selected rows that the comparison doesn't have."""


def selected_rows(classified: DataFrame, selection: DataFrame | None, keys: list[str]) -> DataFrame:
    """The compared rows of a selection (keys, and the action if it has one): those with another action stay unchanged. Without a
    selection all. A selected key that the comparison doesn't have is an error."""
    if selection is None:
        return classified
    selection = selection.distinct()
    on = keys + ["action"] * ("action" in selection.columns)
    gone = missing_selections(selection.select(*on), classified, on).limit(5).collect()
    if gone:
        raise MissingSelection("selected rows are not in the comparison: " + ", ".join(str(tuple(r[k] for k in keys)) for r in gone))
    picked = selection.select(*on).withColumn("_picked", F.lit(True))
    rows = classified.join(picked, matches(classified, picked, on), "left").select(*(classified[c] for c in classified.columns), "_picked")
    taken = F.col("_picked").isNotNull()
    # what isn't selected stays as the target has it
    return rows.where(taken | (F.col("status") != "source_only")).withColumn("status", F.when(taken, F.col("status")).otherwise("unchanged")).withColumn("action", F.when(taken, F.col("action")).otherwise("none")).drop("_picked")


@dataclass
class Plan:
    """What an apply is about to do to a table, and what stands against it."""

    job_id: str
    table_name: str
    seen: Version
    keys: list[str]
    classified: DataFrame
    update: list[str] | None
    counts: dict[str, int]
    blockers: list[tuple[str, str]]

    @property
    def executable(self) -> bool:
        return sum(self.counts.values()) > 0 and all(severity != "error" for _, severity in self.blockers)


def plan_apply(target: VersionedTable, source: DataFrame, keys: list[str], compare: list[str] | None = None, selection: DataFrame | None = None, update: list[str] | None = None, table_name: str = "table", readonly: bool = False, compared_hash: str | None = None, most_deletes: int = 10, expired: bool = False) -> Plan:
    """Compares a source with the newest version of a table. ``compared_hash`` is the snapshot that an earlier comparison saw."""
    seen = target.version()
    classified = selected_rows(diff.classify(source, target.read(seen.number), keys, compare), selection, keys)
    classified = settled(classified, "compared")
    empty = reduce(or_, (F.col(k).isNull() for k in keys))
    found = classified.where("status != 'unchanged'").groupBy("action").agg(F.count("*").alias("n"), F.count_if(empty).alias("empty")).collect()
    counts = {a: 0 for a in ("insert", "update", "delete")} | {r["action"]: r["n"] for r in found}
    then = compared_hash or seen.hash
    against = blockers(0 if expired else 1, 0.5, then, seen.hash, readonly, counts["delete"], most_deletes, sum(r["empty"] for r in found))
    return Plan(uuid.uuid4().hex, table_name, seen, keys, classified, update, counts, against)


def execute_apply(target: VersionedTable, plan: Plan, confirm_deletes: bool = False) -> dict:
    """Carries a plan out as one commit and writes its job row, which is returned: completed; blocked, if something stands against
    the plan or many deletes aren't confirmed; refused, if another commit came since the plan. Failures are rows too, and raised.
    All changes of a plan become visible at once or not at all."""
    created = target._now()
    against = [code for code, severity in plan.blockers if severity == "error" or not confirm_deletes]
    row = {"job_id": plan.job_id, "table_name": plan.table_name, "base_version": plan.seen.number, "version": None, "inserts": 0, "updates": 0, "deletes": 0, "hash_before": plan.seen.hash, "hash_after": None, "blockers": against, "error": None, "created_at": created}
    failure = None
    if against or not sum(plan.counts.values()):
        row |= {"status": "blocked", "error": None if against else "nothing to apply"}
    else:
        try:
            before = target.read(plan.seen.number)
            made = target.commit(apply_changes(before, plan.classified, plan.keys, plan.update), plan.seen, "apply", plan.job_id)
            row |= {"status": "completed", "version": made.number, "hash_after": made.hash, "inserts": plan.counts["insert"], "updates": plan.counts["update"], "deletes": plan.counts["delete"]}
        except Refused as e:
            row |= {"status": "refused", "blockers": ["target_changed"], "error": str(e)}
        except Exception as e:
            row |= {"status": "failed", "error": str(e)[:500]}
            failure = e
    row["finished_at"] = target._now()
    target.log_job(row)
    if failure:
        raise failure
    return row
