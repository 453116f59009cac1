"""Comparison of live schemas held as frames of (table_name, column_name, type, nullable, is_pk), by exact names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMN_SCHEMA = "table_name string, column_name string, position int, type string, nullable boolean, is_pk boolean"


def catalog_columns(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """The columns of some frames as a frame. Schemas are small: they are read on the driver."""
    keys = keys or {}
    rows = [(t, f.name, i, f.dataType.simpleString(), f.nullable, f.name in keys.get(t, [])) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def column_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """table_name, column_name, action (removed: only in the source; added: only in the target; changed) and changed fields, by name."""
    fields = ["type", "nullable", "is_pk"]
    s = source.select("table_name", "column_name", *(F.col(f).alias(f"s_{f}") for f in fields), F.lit(True).alias("in_s"))
    t = target.select("table_name", "column_name", *(F.col(f).alias(f"t_{f}") for f in fields), F.lit(True).alias("in_t"))
    joined = s.join(t, ["table_name", "column_name"], "full_outer")
    changed = F.concat_ws(",", *(F.when(~F.col(f"s_{f}").eqNullSafe(F.col(f"t_{f}")), F.lit(f)) for f in fields))
    action = F.when(F.col("in_t").isNull(), "removed").when(F.col("in_s").isNull(), "added").when(changed != "", "changed")
    return joined.select("table_name", "column_name", action.alias("action"), F.when(action == "changed", changed).otherwise("").alias("changed_fields")).where("action is not null").orderBy("table_name", "column_name")


def table_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """table_name and action of tables that one side lacks."""
    s, t = (df.select("table_name").distinct().withColumn(side, F.lit(True)) for df, side in ((source, "s"), (target, "t")))
    return s.join(t, "table_name", "full_outer").where("s is null or t is null").select("table_name", F.when(F.col("t").isNull(), "removed").otherwise("added").alias("action"))


def sync_index(source: DataFrame, target: DataFrame) -> DataFrame:
    """table_name, which sides have it, and what a comparison takes by default: keys (of either side) and compare_columns (the others
    of either side), both as sorted text."""
    sides = [df.select("table_name", "column_name", "is_pk", F.lit(i).alias("side")) for i, df in enumerate((source, target))]
    each = sides[0].unionByName(sides[1]).groupBy("table_name", "column_name").agg(F.bool_or("is_pk").alias("key"), F.bool_or(F.col("side") == 0).alias("s"), F.bool_or(F.col("side") == 1).alias("t"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    return each.groupBy("table_name").agg(F.bool_or("s").alias("in_source"), F.bool_or("t").alias("in_target"), listed(F.when(F.col("key"), F.col("column_name"))).alias("keys"), listed(F.when(~F.col("key"), F.col("column_name"))).alias("compare_columns"))


def signatures(columns: DataFrame) -> DataFrame:
    """One text a table: its name and its column names in order."""
    return columns.groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_list("column_name")), ",").alias("c")).select(F.concat_ws("|", "table_name", "c").alias("signature"))


def assemble_indexes(parts: DataFrame) -> DataFrame:
    """Rows of (table_name, index_name, seq, column_name) as one row an index with its columns in order."""
    x = F.array_sort(F.collect_list(F.struct("seq", "column_name")))
    return parts.groupBy("table_name", "index_name").agg(x.alias("x")).select("table_name", "index_name", F.array_join(F.col("x.column_name"), ",").alias("columns"))


def join_conditions(fks: DataFrame) -> DataFrame:
    """Rows of (constraint_name, table_name, seq, column_name, ref_table, ref_column) as one join condition a constraint."""
    one = F.concat("table_name", F.lit("."), "column_name", F.lit(" = "), "ref_table", F.lit("."), "ref_column")
    x = F.array_sort(F.collect_list(F.struct("seq", one.alias("c"))))
    return fks.groupBy("constraint_name").agg(x.alias("x")).select("constraint_name", F.array_join(F.col("x.c"), " AND ").alias("condition"))


def ddl(columns: DataFrame, quote: str = "`") -> DataFrame:
    """table_name and a CREATE TABLE statement for each table."""
    q = lambda c: F.concat(F.lit(quote), c, F.lit(quote))
    line = F.concat(F.lit("  "), q(F.col("column_name")), F.lit(" "), F.upper("type"), F.when(F.col("nullable"), "").otherwise(" NOT NULL"))
    x = F.array_sort(F.collect_list(F.struct("position", line.alias("line"), "is_pk", "column_name")))
    rows = columns.groupBy("table_name").agg(x.alias("x"))
    keys = F.transform(F.filter("x", lambda c: c["is_pk"]), lambda c: q(c["column_name"]))
    body = F.array_join(F.concat(F.col("x.line"), F.when(F.size(keys) > 0, F.array(F.concat(F.lit("  PRIMARY KEY ("), F.array_join(keys, ", "), F.lit(")")))).otherwise(F.array().cast("array<string>"))), ",\n")
    return rows.select("table_name", F.concat(F.lit("CREATE TABLE "), q(F.col("table_name")), F.lit(" (\n"), body, F.lit("\n)")).alias("ddl"))


def alter_statements(changes: DataFrame, new: DataFrame) -> DataFrame:
    """ALTER statements for a column_diff whose source is the old schema, removals last."""
    types = new.select("table_name", "column_name", "type")
    rows = changes.join(types, ["table_name", "column_name"], "left")
    head = F.concat(F.lit("ALTER TABLE `"), "table_name", F.lit("` "))
    col = F.concat(F.lit("`"), "column_name", F.lit("`"))
    typed = F.concat_ws(" ", col, F.upper("type"))
    text_ = F.when(F.col("action") == "added", F.concat(head, F.lit("ADD COLUMN "), typed)).when(F.col("action") == "removed", F.concat(head, F.lit("DROP COLUMN "), col)).otherwise(F.concat(head, F.lit("MODIFY COLUMN "), typed))
    rank = F.when(F.col("action") == "removed", 2).otherwise(1)
    return rows.select("table_name", "column_name", rank.alias("step"), text_.alias("statement"))
