"""SQL text made from frames: a statement a row or a batch, for MySQL and PostgreSQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text

QUOTES = {"mysql": "`", "postgres": '"'}


def quoted(name: str, driver: str = "mysql") -> str:
    q = QUOTES[driver]
    return q + name.strip().replace(q, q + q) + q


def quoted_column(name: Column, driver: str = "mysql") -> Column:
    q = QUOTES[driver]
    return F.concat(F.lit(q), F.replace(F.trim(name), F.lit(q), F.lit(q + q)), F.lit(q))


def qualified(table: str, driver: str = "mysql", schema: str | None = None) -> str:
    return (f"{quoted(schema, driver)}." if schema and schema.strip() else "") + quoted(table, driver)


def select_statement(table: str, columns: list[str], driver: str = "mysql", schema: str | None = None, limit: int | None = None) -> str:
    names = ", ".join(quoted(c, driver) for c in columns) or "*"
    return f"SELECT {names} FROM {qualified(table, driver, schema)}" + (f" LIMIT {max(0, limit)}" if limit is not None else "") + ";"


def _values(df: DataFrame | None, columns: list[str], driver: str) -> list[Column]:
    """Literals of the frame's columns; question marks where there is no frame or no such column."""
    known = text.literals(df, [c for c in columns if c in df.columns], driver == "mysql") if df is not None else {}
    return [known.get(c, F.lit("?")) for c in columns]


def _equal(columns: list[str], values: list[Column], driver: str, between: str) -> Column:
    return F.concat_ws(between, *(F.concat(F.lit(f"{quoted(c, driver)} = "), v) for c, v in zip(columns, values)))


def insert_statement(df: DataFrame | None, table: str, columns: list[str], driver: str = "mysql", schema: str | None = None) -> Column:
    """With the values of each row, or question marks if ``df`` is None."""
    names = ", ".join(quoted(c, driver) for c in columns)
    return F.concat(F.lit(f"INSERT INTO {qualified(table, driver, schema)} ({names}) VALUES ("), F.concat_ws(", ", *_values(df, columns, driver)), F.lit(");"))


def update_statement(df: DataFrame | None, table: str, columns: list[str], keys: list[str], driver: str = "mysql", schema: str | None = None) -> Column:
    set_, where = _equal(columns, _values(df, columns, driver), driver, ", "), _equal(keys, _values(df, keys, driver), driver, " AND ")
    return F.concat(F.lit(f"UPDATE {qualified(table, driver, schema)} SET "), set_, F.lit(" WHERE "), where, F.lit(";"))


def delete_statement(df: DataFrame | None, table: str, keys: list[str], driver: str = "mysql", schema: str | None = None) -> Column:
    return F.concat(F.lit(f"DELETE FROM {qualified(table, driver, schema)} WHERE "), _equal(keys, _values(df, keys, driver), driver, " AND "), F.lit(";"))


def key_predicate(df: DataFrame, keys: list[str], driver: str = "mysql") -> Column:
    """Which row a key means: IS NULL for null, clauses in text order."""
    values = text.literals(df, keys)
    clauses = [F.when(F.col(k).isNull(), F.lit(f"{quoted(k, driver)} IS NULL")).otherwise(F.concat(F.lit(f"{quoted(k, driver)} = "), values[k])) for k in keys]
    return F.array_join(F.array_sort(F.array(*clauses)), " AND ")


def apply_statements(classified: DataFrame, table: str, keys: list[str], driver: str = "mysql", update: list[str] | None = None) -> DataFrame:
    """keys, action and statement for each row of a comparison that asks for one. Inserts take all columns in name order; updates
    the requested columns, or those that changed, or all but the keys."""
    name = qualified(table, driver)
    have = classified.schema["source_row"].dataType
    literal = {f.name: text.sql_literal(F.col(f"source_row.{f.name}"), f.dataType.simpleString()) for f in have}
    ordered = sorted(literal)
    insert = F.concat(F.lit(f"INSERT INTO {name} ({', '.join(quoted(c, driver) for c in ordered)}) VALUES ("), F.concat_ws(", ", *(literal[c] for c in ordered)), F.lit(");"))
    rest = [c for c in ordered if c not in keys]
    pick = lambda holds: F.concat_ws(", ", *(F.when(holds(c), F.concat(F.lit(f"{quoted(c, driver)} = "), literal[c])) for c in ordered))
    asked = pick(lambda c: F.lit(c in update)) if update else pick(lambda c: F.array_contains("changed", c))
    sets = F.when(asked != "", asked).otherwise(pick(lambda c: F.lit(c in rest)))
    where = key_predicate(classified, keys, driver)
    statement = (
        F.when(F.col("status") == "source_only", insert)
        .when(F.col("status") == "value_changed", F.concat(F.lit(f"UPDATE {name} SET "), sets, F.lit(" WHERE "), where, F.lit(";")))
        .when(F.col("status") == "target_only", F.concat(F.lit(f"DELETE FROM {name} WHERE "), where, F.lit(";")))
    )
    return classified.where("status != 'unchanged'").select(*keys, "action", statement.alias("statement"))


def lineage_names(df: DataFrame) -> dict[str, str]:
    """The name each column of a result has in its table (metadata source_column), or its own."""
    return {f.name: (f.metadata.get("source_column") or "").strip() or f.name for f in df.schema}


def lineage_table(df: DataFrame, fallback: str | None = None) -> str:
    """The table that a result comes from (metadata source_table), or the fallback, or a general name."""
    found = next((t for f in df.schema if (t := (f.metadata.get("source_table") or "").strip())), None)
    return found or (fallback or "").strip() or "exported_rows"


def with_lineage(df: DataFrame, table: str, keys: list[str], schema: str | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """``df`` with metadata of where each column comes from: source_table, source_schema, source_column, is_pk."""
    source = lambda c: (renamed or {}).get(c, c)
    return df.select(*(F.col(c).alias(c, metadata={"source_table": table, "source_schema": schema or "", "source_column": source(c), "is_pk": source(c) in keys}) for c in df.columns))


def insert_script(df: DataFrame, place: str, driver: str = "mysql", table: str | None = None, schema: str | None = None, size: int = 100) -> DataFrame:
    """batch and statement: INSERTs of ``size`` rows in the order of ``place`` (numbers from 1 without gaps). Table and column
    names are those of the lineage. A batch is a group of bounded size."""
    columns, size = [c for c in df.columns if c != place], max(1, size)
    names = lineage_names(df)
    head = f"INSERT INTO {qualified(table or lineage_table(df), driver, schema)} ({', '.join(quoted(names[c], driver) for c in columns)}) VALUES\n  "
    line = F.concat(F.lit("("), F.concat_ws(", ", *text.literals(df, columns, driver == "mysql").values()), F.lit(")"))
    rows = df.select(F.floor((F.col(place) - 1) / size).alias("batch"), F.struct(F.col(place).alias("i"), line.alias("line")).alias("x"))
    each = rows.groupBy("batch").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return each.select("batch", F.concat(F.lit(head), F.array_join("x.line", ",\n  "), F.lit(";")).alias("statement"))


def table_operation(kind: str, table: str, driver: str = "mysql", to: str | None = None, schema: str | None = None, if_exists: bool = False) -> str:
    """Statements of table maintenance: drop, truncate, rename or duplicate."""
    name, target = qualified(table, driver, schema), qualified(to, driver, schema) if to else ""
    mysql = driver == "mysql"
    made = {
        "drop": f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{name};",
        "truncate": f"TRUNCATE TABLE {name};",
        "rename": f"RENAME TABLE {name} TO {target};" if mysql else f"ALTER TABLE {name} RENAME TO {quoted(to or '', driver)};",
        "duplicate": f"CREATE TABLE {target} LIKE {name};" if mysql else f"CREATE TABLE {target} (LIKE {name} INCLUDING ALL);",
    }
    return made[kind]


#: Operations that need a confirmation.
DESTRUCTIVE = ("drop", "truncate", "rename")
