"""What a view of schema changes shows: impact of changes, filters, counts and orders; structured entries and line diffs.

Changes of columns have table (a key), action, changed_fields, old_comment and new_comment and names; see matching.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text

#: Fields whose change breaks users, actions that do, and the rank of actions in lists.
BREAKING = ["dataType", "size", "notNull", "isPk", "autoIncrement", "physicalName"]
GONE = ["removed", "renamed", "rename_suggest"]
ACTION_RANK = {"removed": 0, "rename_suggest": 1, "renamed": 2, "modified": 3, "changed": 3, "added": 4}
FILTERS = {"name": ["logicalName", "physicalName"], "nullable": ["notNull"], "pk": ["isPk"]}
STRONGEST = ["breaking", "non_breaking", "metadata"]


def _any(fields: Column, names: list[str]) -> Column:
    return F.arrays_overlap(fields, F.array(*map(F.lit, names)))


def column_impact(action: Column, fields: Column) -> Column:
    only_comment = (F.size(fields) == 1) & F.array_contains(fields, "comment")
    of_fields = F.when(F.size(fields) == 0, "non_breaking").when(only_comment, "metadata").when(_any(fields, BREAKING), "breaking").otherwise("non_breaking")
    return F.when(action == "added", "non_breaking").when(action.isin(GONE), "breaking").otherwise(of_fields)


def formatting_only(action: Column, fields: Column, old: Column, new: Column) -> Column:
    """If nothing but the layout of a comment changed."""
    a, b = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    return (action == "modified") & (F.size(fields) == 1) & F.array_contains(fields, "comment") & (a != b) & (text.comment_meaning(a) == text.comment_meaning(b))


def table_impact(action: Column, fields: Column, impacts: Column) -> Column:
    """By the table's own change, or else the strongest impact of its columns (an array)."""
    strongest = reduce(lambda w, k: w.when(F.array_contains(impacts, k), F.lit(k)), STRONGEST, F.when(F.lit(False), F.lit("")))
    own = F.when(action.isin(GONE), "breaking").when(action == "added", "non_breaking").when(F.array_contains(fields, "physicalTableName"), "breaking").when(F.array_contains(fields, "logicalTableName"), "non_breaking")
    return own.otherwise(strongest.otherwise("non_breaking"))


def field_filter(fields: Column, which: str) -> Column:
    return F.lit(True) if which == "all" else _any(fields, FILTERS.get(which, [which]))


def visible_columns(changes: DataFrame, action: str = "all", field: str = "all", keyword: str = "", metadata: bool = True, hide_formatting: bool = False) -> DataFrame:
    """``changes`` to show, with impact and formatting. A keyword is looked for in all names of the column."""
    rows = changes.withColumn("impact", column_impact(F.col("action"), F.col("changed_fields"))).withColumn("formatting", formatting_only(F.col("action"), F.col("changed_fields"), F.col("old_comment"), F.col("new_comment")))
    keep = field_filter(F.col("changed_fields"), field)
    if action != "all":
        keep &= F.col("action") == action
    if keyword.strip():
        keep &= F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("old_logical", "old_physical", "new_logical", "new_physical")))).contains(keyword.strip().lower())
    if not metadata:
        keep &= F.col("impact") != "metadata"
    if hide_formatting:
        keep &= ~F.col("formatting")
    return rows.where(keep)


def impact_counts(visible: DataFrame) -> DataFrame:
    """table_key, and how many visible changes are of the schema, of metadata and of formatting only."""
    return visible.groupBy("table_key").agg(F.count_if(F.col("impact") != "metadata").alias("n_schema"), F.count_if(F.col("impact") == "metadata").alias("n_metadata"), F.count_if("formatting").alias("n_formatting"))


def action_rank(action: Column) -> Column:
    return reduce(lambda w, k: w.when(action == k[0], F.lit(k[1])), ACTION_RANK.items(), F.when(F.lit(False), F.lit(0))).otherwise(5)


def ordered_changes(changes: DataFrame, place: str) -> DataFrame:
    """In the order of lists: removed first, added last, otherwise as they came."""
    return changes.withColumn("rank", action_rank(F.col("action"))).orderBy("rank", place)


def shown(c: Column) -> Column:
    """A value as entries show it: trimmed, a hyphen for nothing."""
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("-"))


def semantically_equal(a: Column, b: Column) -> Column:
    """If two values differ in white space at most."""
    return text.one_line(shown(a)) == text.one_line(shown(b))


def field_changes(changes: DataFrame, fields: list[str]) -> DataFrame:
    """``changes`` exploded to a row a field: field, old_value, new_value and same (equal but for white space). Columns that were
    added or removed list all fields, others those that changed. Sides are structs o and n whose fields are the names in ``fields``."""
    every = F.col("action").isin("added", "removed") | (F.size("changed_fields") == 0)
    each = F.array(*(F.struct(F.lit(f).alias("field"), shown(F.col(f"o.{f}")).alias("old_value"), shown(F.col(f"n.{f}")).alias("new_value"), semantically_equal(F.col(f"o.{f}"), F.col(f"n.{f}")).alias("same")) for f in fields))
    kept = F.filter(each, lambda x: every | F.array_contains("changed_fields", x["field"]))
    return changes.withColumn("x", F.explode(kept)).select(*changes.columns, "x.*")


def row_entries(classified: DataFrame, columns: list[str]) -> DataFrame:
    """A row delta as an entry: of changed rows the fields that changed, of others all fields in name order, as name, source_value and
    target_value."""
    value = lambda side, c: F.col(f"{side}.{c}").cast("string")
    each = F.array(*(F.struct(F.lit(c).alias("name"), value("source_row", c).alias("source_value"), value("target_row", c).alias("target_value")) for c in sorted(columns)))
    kept = F.filter(each, lambda x: (F.col("status") != "value_changed") | F.array_contains("changed", x["name"]))
    return classified.where("status != 'unchanged'").withColumn("fields", kept)


def listed_tables(tables: DataFrame, search: str = "", sort: str = "source") -> DataFrame:
    """Tables (place, logical, physical, excel_column) that a search in their names finds, in the order of the source, of names or of
    the workbook's columns (A before AA)."""
    q = search.strip().lower()
    rows = tables if not q else tables.where(F.coalesce(F.lower("logical").contains(q), F.lit(False)) | F.coalesce(F.lower("physical").contains(q), F.lit(False)))
    name, letters = F.coalesce(F.nullif("logical", F.lit("")), "physical", F.lit("")), F.upper(F.coalesce("excel_column", F.lit("")))
    number = F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda s, x: s * 26 + F.ascii(x) - 64)
    return rows.orderBy(*{"name": [name, "place"], "column": [number, "place"]}.get(sort, ["place"]))


def hunks(lines: DataFrame, key: str = "id", context: int = 3) -> DataFrame:
    """Lines with hunk (its number) and collapsed: lines further than ``context`` from any change are collapsed; a text without
    changes shows its first and last ones."""
    w = W.partitionBy(key)
    near = F.max((F.col("type") != "unchanged").cast("int")).over(w.orderBy("place").rowsBetween(-context, context)) == 1
    any_, n = F.max((F.col("type") != "unchanged").cast("int")).over(w) == 1, F.count("*").over(w)
    edge = (F.col("place") < context) | (F.col("place") >= n - context)
    rows = lines.withColumn("collapsed", F.when(any_, ~near).otherwise(~edge))
    start = F.coalesce((F.col("collapsed") != F.lag("collapsed").over(w.orderBy("place"))).cast("int"), F.lit(0))
    return rows.withColumn("_start", start).withColumn("hunk", F.sum("_start").over(w.orderBy("place"))).drop("_start")


def diff_stats(lines: DataFrame, key: str = "id") -> DataFrame:
    return lines.groupBy(key).agg(F.count_if(F.col("type") == "added").alias("added"), F.count_if(F.col("type") == "removed").alias("removed"))
