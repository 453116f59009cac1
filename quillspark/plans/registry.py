"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with the SQL that DuckDB runs for the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, *names: str) -> None:
    """Temporary views for queries that users give as SQL text."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def delegated(name: str, tables: str, sql: str, duck: str | None = None) -> None:
    """Registers a query given as SQL text, which Spark and the oracle run alike."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        views(spark, folder, *tables.split())
        return spark.sql(sql)

    run.__name__ = name
    QUERIES[name], SQL[name] = run, duck or sql


def values_sql(rows: list[tuple], names: str, alias: str = "t") -> str:
    """Rows as a table of an SQL statement."""
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(literal, v)) + "]"
        if isinstance(v, float):
            return f"{v!r}::double"
        return repr(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"(values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) as {alias}({names})"


from quillspark.plans import cell_queries, ddl_queries, diff_queries, function_queries, grid_queries, library_queries, matching_queries, relational_queries, schema_queries, source_queries, store_queries, transfer_queries, version_queries, view_queries, workbench_queries  # noqa: E402, F401
