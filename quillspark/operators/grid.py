"""Editing loaded rows: what may be edited, drafts, plans and their results; and the loaded window itself."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.statements import with_lineage

PAGE, PLAN_SECONDS, PREVIEW = 1_000, 300, 20


def eligibility(rows: DataFrame, source: str | None, table: str | None, keys: list[str] | None, readonly: bool = False, error: str | None = None) -> list[str]:
    """Codes of what stands against editing a result, the first that holds; none if it may be edited. ``source`` says where it is
    from (a table, or a count), ``keys`` are the table's primary key columns, None for an unknown table."""
    if source is None or (source != "count" and not (table or "").strip()):
        return ["readonly_connection"] if readonly and source is not None else ["unsupported_source"]
    for holds, code in ((readonly, "readonly_connection"), (source == "count", "count_result"), (error, "result_error"), (keys is None, "table_not_found"), (not keys, "missing_primary_key")):
        if holds:
            return [code]
    missing = [k for k in keys if k not in rows.columns]
    if missing:
        return ["missing_primary_key_column"] * len(missing)
    return ["duplicate_primary_key_tuple"] if not duplicate_keys(rows, keys).isEmpty() else []


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key tuples that several rows have; null is a value."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def editable(rows: DataFrame, table: str, keys: list[str], schema: str | None = None) -> DataFrame:
    """``rows`` with the lineage that edits need, as metadata."""
    return with_lineage(rows, table, keys, schema)


def staged_edits(edits: DataFrame) -> DataFrame:
    """Edits (row_key, column_name, before_value, next_value, seq) as they stand at last: the value before the first edit, the value
    after the last one; cells that are back where they were go. Cells of rows in ``deleted`` are for the caller to drop."""
    last = edits.groupBy("row_key", "column_name").agg(F.min_by(F.struct("before_value"), "seq").alias("b"), F.max_by(F.struct("next_value"), "seq").alias("n"))
    return last.select("row_key", "column_name", "b.before_value", "n.next_value").where("not before_value <=> next_value")


def staged_rows(actions: DataFrame) -> DataFrame:
    """What rows come to: the last of delete, restore and edit decides (row_key, action, seq); an edit takes a delete back."""
    last = actions.groupBy("row_key").agg(F.max_by("action", "seq").alias("action"))
    return last.where("action != 'restore'")


def commit_drafts(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """row_key, kind (update or delete) and columns: edited cells by row, but for rows that are deleted."""
    gone = rows.where("action = 'delete'").select("row_key")
    kept = cells.join(gone, "row_key", "left_anti").groupBy("row_key").agg(F.array_join(F.array_sort(F.collect_set("column_name")), ",").alias("columns"))
    return kept.withColumn("kind", F.lit("update")).unionByName(gone.withColumns({"columns": F.lit(""), "kind": F.lit("delete")}))


def plan_hash(statements: DataFrame, table: str, keys: list[str], schema: str | None = None) -> DataFrame:
    """One row, n_statements and plan_hash: over a digest of each statement (kind, sql, row_key) in the order of place."""
    each = F.sha2(F.to_json(F.struct("kind", "sql", "row_key"), {"ignoreNullFields": "false"}), 256)
    head = json.dumps([table, schema, keys])
    rows = statements.agg(F.count("*").alias("n_statements"), F.array_sort(F.collect_list(F.struct("place", each.alias("h")))).alias("x"))
    # a plan is what one person edits: its list is of bounded size
    return rows.select("n_statements", F.sha2(F.concat(F.lit(head), F.array_join("x.h", "")), 256).alias("plan_hash"))


def affected(target: DataFrame, mutations: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind and affected: how many rows of the target each mutation meets; any number but one is an error."""
    n = target.groupBy(*keys).agg(F.count("*").alias("affected"))
    on = [mutations[k].eqNullSafe(n[k]) for k in keys]
    return mutations.join(n, on, "left").select(*[mutations[k] for k in keys], "kind", F.coalesce("affected", F.lit(0)).alias("affected"), (F.coalesce("affected", F.lit(0)) != 1).alias("mismatch"))


def failed_results(results: DataFrame, message: str, table: str | None = None, action: str | None = None) -> DataFrame:
    """Results (table_name, action, attempted) of an apply that was rolled back: nothing succeeded, all failed, and the message is
    on the result it is about, or on the first."""
    about = F.lit(False) if table is None else (F.col("table_name") == table) & (F.lit(True) if action is None else F.col("action") == action)
    first = results.agg(F.min(F.when(about, F.struct("table_name", "action"))).alias("a"), F.min(F.struct("table_name", "action")).alias("b")).select(F.coalesce("a", "b").alias("at"))
    rows = results.crossJoin(F.broadcast(first))
    return rows.select("table_name", "action", "attempted", F.lit(0).cast("long").alias("succeeded"), F.col("attempted").alias("failed"), F.when(F.struct("table_name", "action") == F.col("at"), F.lit(message)).alias("error"))


def job_summary(results: DataFrame) -> DataFrame:
    """job_id, the first table with a name, how many there are, and the first failure; results have job_id, seq, table_name, action and
    failure."""
    named, failure = F.trim("table_name") != "", F.trim(F.coalesce("failure", F.lit("")))
    said = F.concat_ws(" / ", "table_name", "action", failure)
    return results.groupBy("job_id").agg(
        F.min_by(F.when(named, F.col("table_name")), F.when(named, F.col("seq"))).alias("primary_table"),
        F.count_distinct(F.when(named, F.trim("table_name"))).alias("table_count"),
        F.min_by(F.when(failure != "", said), F.when(failure != "", F.col("seq"))).alias("failure_summary"),
    )


def preview(statements: DataFrame, place: str, most: int = PREVIEW) -> tuple[DataFrame, bool]:
    """The first statements of a plan and if there are more."""
    rows = statements.orderBy(place).limit(most + 1)
    return rows.limit(most), rows.count() > most


def confirmations(blockers: list[tuple[str, str]], confirmed_deletes: bool, environment: str | None, database: str, typed: str | None) -> list[tuple[str, str]]:
    """``blockers`` and what else an execution asks for: many deletes to be confirmed, and for production the name of the database."""
    out = list(blockers)
    if any(code == "many_deletes" for code, _ in blockers) and not confirmed_deletes:
        out.append(("unsafe_delete_confirmation_required", "error"))
    if environment == "prod" and (typed or "").strip() != database:
        out.append(("target_database_confirmation_required", "error"))
    return out


def current_page(rows: DataFrame, place: str, returned: int) -> DataFrame:
    """The last ``returned`` of the loaded rows, one at least."""
    return rows.orderBy(F.col(place).desc()).limit(max(1, returned))


def with_drafts(loaded: DataFrame, drafts: DataFrame, place: str) -> DataFrame:
    """New rows above the loaded ones, with ordinal for their common order; columns a draft lacks are null."""
    return drafts.withColumn("ordinal", F.struct(F.lit(0).alias("part"), place)).unionByName(loaded.withColumn("ordinal", F.struct(F.lit(1).alias("part"), place)), allowMissingColumns=True)


@dataclass
class Metrics:
    """What a grid says of its rows."""

    loaded: int
    retained: int
    next_load: int
    can_load_more: bool


def metrics(retained: int, returned: int, total: int | None, next_offset: int | None, has_more: bool, paging: str, loaded: int | None = None) -> Metrics:
    rest = PAGE if total is None or next_offset is None else max(1, min(PAGE, max(0, total - next_offset)))
    return Metrics(max(retained, returned if loaded is None else loaded), retained, rest, paging == "offset" and has_more)
