"""Dumps of tables as SQL text: structure and data, to be run again and again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import ddl, statements

#: Types of columns by Spark type and driver.
TYPES = {
    "mysql": {"int": "INT", "bigint": "BIGINT", "smallint": "SMALLINT", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "string": "TEXT", "date": "DATE", "timestamp": "DATETIME(6)", "timestamp_ntz": "DATETIME(6)"},
    "postgres": {"int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "double": "DOUBLE PRECISION", "float": "REAL", "boolean": "BOOLEAN", "string": "TEXT", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"},
}


def draft_of(df: DataFrame, table: str, keys: list[str], driver: str) -> DataFrame:
    """The definition of a frame's table, a row a column. Schemas are small: they are read on the driver."""
    kinds = TYPES[driver]
    rows = [(table, i, f.name, kinds.get(f.dataType.simpleString(), f.dataType.simpleString().upper()), f.nullable and f.name not in keys, f.name in keys) for i, f in enumerate(df.schema, 1)]
    made = df.sparkSession.createDataFrame(rows, "table_name string, position int, name string, data_type string, nullable boolean, is_pk boolean")
    return made.withColumns({"default_value": F.lit(None).cast("string"), "auto_increment": F.lit(False), "comment": F.lit(None).cast("string")})


def dump(df: DataFrame, table: str, keys: list[str], driver: str = "mysql", structure: bool = True, data: bool = True, drop: bool = True, size: int = 100, files: int | None = None) -> DataFrame:
    """member, place and text of a table's dump: ``<table>/structure.sql`` with DROP (if wanted) and CREATE, and ``<table>/data-<n>.sql``
    with INSERTs of up to ``size`` rows, in the order of the keys. The data lie in ``files`` members, or as many as Spark shuffles to,
    so that no task writes a whole table; run in the order of their names they are the table. A table without rows has no data."""
    parts = []
    if structure:
        made = ddl.designed_tables(draft_of(df, table, keys, driver), driver).select(F.lit(1).alias("place"), F.col("ddl").alias("text"))
        if drop:
            head = df.sparkSession.createDataFrame([(0, statements.table_operation("drop", table, driver, if_exists=True))], "place int, text string")
            made = head.unionByName(made)
        parts.append(made.select(F.lit(f"{table}/structure.sql").alias("member"), F.col("place").cast("long").alias("place"), "text"))
    if data:
        names = df.columns
        head = f"INSERT INTO {statements.qualified(table, driver)} ({', '.join(statements.quoted(c, driver) for c in names)}) VALUES\n  "
        line = F.concat(F.lit("("), F.concat_ws(", ", *text.literals(df, names, driver == "mysql").values()), F.lit(")"))
        rows = df.select(*keys, line.alias("_line"), F.xxhash64(*names).alias("_h"))
        rows = rows.repartitionByRange(*([files] if files else []), *keys, "_h").withColumn("_part", F.spark_partition_id())
        place = F.row_number().over(W.partitionBy("_part").orderBy(*keys, "_h"))
        rows = rows.withColumn("_i", place).withColumn("place", F.floor((F.col("_i") - 1) / max(1, size)))
        each = rows.groupBy("_part", "place").agg(F.array_sort(F.collect_list(F.struct("_i", "_line"))).alias("x"))
        member = F.concat(F.lit(f"{table}/data-"), F.lpad(F.col("_part").cast("string"), 6, "0"), F.lit(".sql"))
        parts.append(each.select(member.alias("member"), F.col("place").cast("long").alias("place"), F.concat(F.lit(head), F.array_join("x._line", ",\n  "), F.lit(";")).alias("text")))
    return reduce(DataFrame.unionByName, parts)
