"""Catalogs as frames: what Spark knows of databases and tables, metadata joins, and stored comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Schemas that belong to the server.
SYSTEM = ["information_schema", "mysql", "performance_schema", "sys", "pg_catalog", "pg_toast"]


def schemas(spark: SparkSession) -> DataFrame:
    """Databases, but those of the server; the active one if there is no other."""
    rows = spark.sql("show databases").select(F.col("namespace").alias("schema_name")).where(~F.lower("schema_name").isin(SYSTEM))
    return rows if not rows.isEmpty() else spark.range(1).select(F.current_database().alias("schema_name"))


def columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """A row for each column of each table and view of a database: table_name, is_view, position, column_name, type, nullable and comment.
    Catalogs are small: names are listed on the driver, as Spark's catalog gives them."""
    rows = [(t.name, t.tableType == "VIEW", i, c.name, c.dataType, c.nullable, c.description) for t in spark.catalog.listTables(database) for i, c in enumerate(spark.catalog.listColumns(t.name if t.isTemporary else f"{t.namespace[0]}.{t.name}"))]
    return spark.createDataFrame(rows, "table_name string, is_view boolean, position int, column_name string, type string, nullable boolean, comment string")


def inspected(spark: SparkSession, table: str) -> DataFrame:
    """What Spark tells of a table or view: key and value."""
    return spark.sql(f"describe table extended {table}").select(F.col("col_name").alias("key"), F.col("data_type").alias("value"))


def with_metadata(found: DataFrame, keys: DataFrame, comments: DataFrame) -> DataFrame:
    """Columns with is_pk (false where no key lists them) and their comments, by left joins on table and column."""
    on = ["table_name", "column_name"]
    marks = keys.select(*on).distinct().withColumn("is_pk", F.lit(True))
    rows = found.drop("is_pk", "comment").join(marks, on, "left").join(comments.select(*on, "comment"), on, "left")
    return rows.withColumn("is_pk", F.coalesce("is_pk", F.lit(False)))


def join_edges(fks: DataFrame, relations: DataFrame) -> DataFrame:
    """Foreign keys (table_name, constraint_name, columns, ref_table, ref_columns) between known relations, one for equal ends."""
    known = relations.select(F.lower("table_name").alias("k")).distinct()
    rows = fks.join(known, F.lower("table_name") == F.col("k"), "left_semi").join(known, F.lower("ref_table") == F.col("k"), "left_semi")
    low = [F.lower("table_name"), F.lower(F.array_join("columns", ",")), F.lower("ref_table"), F.lower(F.array_join("ref_columns", ","))]
    first = F.row_number().over(W.partitionBy(*low).orderBy("constraint_name"))
    return rows.withColumn("_i", first).where("_i = 1").drop("_i")


def overridden(tables: DataFrame, selected: DataFrame, overrides: DataFrame) -> DataFrame:
    """The selected tables (table_id), each as its override has it or else as it is; one that isn't there is an error."""
    missing = selected.join(tables, "table_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("table index out of range")
    rest = [c for c in tables.columns if c != "table_id"]
    o = overrides.select("table_id", F.struct(*rest).alias("o"))
    rows = selected.join(tables.select("table_id", F.struct(*rest).alias("t")), "table_id").join(o, "table_id", "left")
    return rows.select("table_id", F.coalesce("o", "t").alias("x")).select("table_id", "x.*")


def missing_types(definitions: DataFrame) -> DataFrame:
    """Tables with columns that have no type, and those columns in order."""
    bare = definitions.where(F.trim(F.coalesce("data_type", F.lit(""))) == "")
    x = F.array_sort(F.collect_list(F.struct("position", F.coalesce("physical", "logical").alias("name"))))
    return bare.groupBy("sheet", "table_id", "table_physical").agg(F.count("*").alias("n_columns"), x.alias("x")).withColumn("columns", F.array_join("x.name", ",")).drop("x")


def canonical(definitions: DataFrame) -> DataFrame:
    """Definitions with place: the order of a table's columns by normalised name, so that order of writing has no meaning."""
    from quillspark.operators.matching import norm

    name = F.coalesce(F.nullif(norm(F.col("physical")), F.lit("")), norm(F.col("logical")))
    return definitions.withColumn("place", F.row_number().over(W.partitionBy("sheet", "table_id").orderBy(name, "position")))


def store_comparison(classified: DataFrame, folder: str, compare_id: str, table: str, created: str, minutes: int = 15) -> None:
    """Appends a comparison's rows, with the time at which they lose their worth, to a table partitioned by comparison."""
    at = F.to_timestamp(F.lit(created))
    text_ = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    keys = [c for c in classified.columns if c not in ("status", "action", "source_row", "target_row", "changed")]
    rows = classified.select(F.lit(table).alias("table_name"), text_(F.struct(*sorted(keys))).alias("row_key"), "status", "action", text_(F.col("source_row")).alias("source_row"), text_(F.col("target_row")).alias("target_row"), "changed", (at + F.make_dt_interval(mins=F.lit(minutes))).alias("expires_at"), F.lit(compare_id).alias("compare_id"))
    rows.write.mode("append").partitionBy("compare_id").parquet(folder)


def stored_comparison(spark: SparkSession, folder: str, compare_id: str, now: str) -> DataFrame:
    """The rows of a stored comparison that haven't expired; only its partition is read."""
    return spark.read.parquet(folder).where((F.col("compare_id") == compare_id) & (F.col("expires_at") > F.to_timestamp(F.lit(now))))
