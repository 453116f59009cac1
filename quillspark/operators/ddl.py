"""DDL text from frames of column definitions (see matching): CREATE, ALTER and code of enumerations.

A statement is assembled from the lines of a table's columns, in their order; a table is a group of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import cells
from quillspark.operators.statements import quoted_column


@dataclass
class Settings:
    """How MySQL tables are written."""

    engine: str = "InnoDB"
    charset: str = "utf8mb4"
    collate: str = "utf8mb4_bin"
    upper: bool = False
    booleans: bool = False
    set_names: bool = True
    drop_table: bool = True


NO_NAME = "unknown_column"


def _escaped(c: Column) -> Column:
    return F.replace(c, F.lit("'"), F.lit("''"))


def typed(data_type: str = "data_type", size: str = "size") -> Column:
    return cells.type_and_size(F.col(data_type), F.col(size))


def auto_increment_plan(definitions: DataFrame) -> DataFrame:
    """``definitions`` with auto_plan, for columns that ask for it: enabled (the first integer primary key column of its table),
    or why not: not_primary_key, non_numeric_type, multiple_auto_increment."""
    asks, key = F.coalesce("auto_increment", F.lit(False)), F.coalesce("is_pk", F.lit(False))
    reason = F.when(~key, "not_primary_key").when(~F.coalesce(typed()["type"].isin(cells.INTEGERS), F.lit(False)), "non_numeric_type").otherwise("enabled")
    rows = definitions.withColumn("auto_plan", F.when(asks, reason))
    place = F.row_number().over(W.partitionBy("sheet", "table_id", "auto_plan").orderBy("position"))
    return rows.withColumn("auto_plan", F.when((F.col("auto_plan") == "enabled") & (place > 1), "multiple_auto_increment").otherwise(F.col("auto_plan")))


def auto_increment_warnings(definitions: DataFrame, dialect: str = "mysql") -> DataFrame:
    """table, column and reason of each AUTO_INCREMENT that isn't written."""
    rows = auto_increment_plan(definitions).where("auto_plan is not null")
    reason = F.col("auto_plan") if dialect == "mysql" else F.lit("dialect_unsupported")
    rows = rows.withColumn("reason", reason).where("reason != 'enabled'")
    return rows.select(F.coalesce(F.nullif(F.trim("table_physical"), F.lit("")), F.lit("unknown_table")).alias("table_name"), F.coalesce(F.nullif(F.trim("physical"), F.lit("")), F.lit(NO_NAME)).alias("column_name"), "reason")


def create_tables(definitions: DataFrame, dialect: str = "mysql", settings: Settings | None = None) -> DataFrame:
    """sheet, table_id, table_name and ddl: the CREATE TABLE of each table, with comments from logical names."""
    s, mysql = settings or Settings(), dialect == "mysql"
    rows = auto_increment_plan(definitions).withColumn("name", F.coalesce("physical", F.lit(NO_NAME)))
    not_null = F.when(F.coalesce("not_null", F.lit(False)), " NOT NULL").otherwise("")
    said = F.trim(F.coalesce("logical", F.lit(""))) != ""
    first = F.col("auto_plan").eqNullSafe("enabled")
    if mysql:
        line = F.concat(F.lit("  `"), "name", F.lit("` "), cells.mysql_type(typed(), s.upper, s.booleans, s.charset, s.collate), not_null, F.when(first, " AUTO_INCREMENT").otherwise(""), F.when(said, F.concat(F.lit(" COMMENT '"), _escaped(F.col("logical")), F.lit("'"))).otherwise(""))
        key = F.concat(F.lit("`"), "name", F.lit("`"))
    else:
        line, key = F.concat(F.lit("  "), "name", F.lit(" "), cells.oracle_type(typed()), not_null), F.col("name")
    note = F.when(said, F.concat(F.lit("COMMENT ON COLUMN "), "table_physical", F.lit("."), "name", F.lit(" IS '"), _escaped(F.col("logical")), F.lit("';")))
    listed = lambda *x: F.array_sort(F.collect_list(F.struct(*x)))
    primary = F.coalesce("is_pk", F.lit(False))
    tables = rows.groupBy("sheet", "table_id", F.col("table_physical").alias("table_name"), F.col("table_logical").alias("said")).agg(
        listed("position", line.alias("line")).alias("lines"),
        # the column that counts up comes first in a MySQL key
        listed((~first if mysql else F.lit(False)).alias("later"), "position", F.when(primary, key).alias("key")).alias("keys"),
        listed("position", note.alias("note")).alias("notes"),
    )
    keys = F.array_join(F.array_compact("keys.key"), ", ")
    about = _escaped(F.coalesce("said", F.lit("")))
    if mysql:
        start = (f"SET NAMES {s.charset};\n\n" if s.set_names else "", "DROP TABLE IF EXISTS `" if s.drop_table else "")
        drop = F.concat(F.lit(start[1]), "table_name", F.lit("`;\n")) if s.drop_table else F.lit("")
        head = F.concat(F.lit(start[0]), drop, F.lit("CREATE TABLE `"), "table_name", F.lit("`  (\n"))
        primary_line = F.concat(F.lit("  PRIMARY KEY ("), keys, F.lit(") USING BTREE"))
        end = F.concat(F.lit(f"\n) ENGINE = {s.engine} CHARACTER SET = {s.charset} COLLATE = {s.collate} COMMENT = '"), about, F.lit("';"))
    else:
        head = F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" (\n"))
        primary_line = F.concat(F.lit("  CONSTRAINT pk_"), "table_name", F.lit(" PRIMARY KEY ("), keys, F.lit(")"))
        notes = F.array_join(F.concat(F.array(F.concat(F.lit("COMMENT ON TABLE "), "table_name", F.lit(" IS '"), about, F.lit("';"))), F.array_compact("notes.note")), "\n")
        end = F.concat(F.lit("\n);\n\n"), notes)
    none = F.array().cast("array<string>")
    body = F.array_join(F.concat(F.col("lines.line"), F.when(keys != "", F.array(primary_line)).otherwise(none)), ",\n")
    return tables.select("sheet", "table_id", "table_name", F.concat(head, body, end).alias("ddl"))


def entries(tables: DataFrame, prefix: str = "Crt_", suffix: str = "") -> DataFrame:
    """path and content of the files of an export, a file a table; tables without a name are in the report instead."""
    named = F.trim(F.coalesce("table_name", F.lit(""))) != ""
    files = tables.where(named).select(F.concat(F.lit(prefix), "table_name", F.lit(f"{suffix}.sql")).alias("path"), F.col("ddl").alias("content"))
    counts = tables.agg(F.count("*").alias("n"), F.count_if(named).alias("ok")).where("n > ok")
    lines = [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in (("selectedTableCount", F.col("n")), ("successCount", F.col("ok")), ("skippedCount", F.col("n") - F.col("ok")))]
    return files.unionByName(counts.select(F.lit("export_errors.txt").alias("path"), F.concat_ws("\n", *lines).alias("content")))


def _definition(x: Column, dialect: str) -> Column:
    """A column in an ALTER statement; types have other defaults there than in CREATE TABLE."""
    name = F.coalesce(F.nullif(x["physical"], F.lit("")), x["logical"], F.lit(NO_NAME))
    t, size = F.lower(F.trim(F.coalesce(x["data_type"], F.lit("")))), F.nullif(F.trim(F.coalesce(x["size"], F.lit(""))), F.lit(""))
    sized = lambda n, s: F.when(s.isNull(), n).otherwise(F.concat(n, F.lit("("), s, F.lit(")")))
    or_else = lambda d: F.coalesce(size, F.lit(d))
    not_null = F.when(F.coalesce(x["not_null"], F.lit(False)), " NOT NULL").otherwise("")
    if dialect == "mysql":
        kind = F.when(t == "", "varchar(255)").when(t.isin("varchar", "char"), sized(t, or_else("255"))).when(t.isin("int", "integer"), sized(F.lit("int"), size)).when(t.isin("decimal", "numeric"), sized(F.lit("decimal"), or_else("10,2"))).otherwise(sized(t, size))
        counts = F.coalesce(x["auto_increment"], F.lit(False)) & F.coalesce(x["is_pk"], F.lit(False)) & t.isin(*cells.INTEGERS, "mediumint")
        return F.concat(F.lit("`"), name, F.lit("` "), kind, not_null, F.when(counts, " AUTO_INCREMENT").otherwise(""))
    kind = (
        F.when(t == "", "VARCHAR2(255)").when(t == "varchar", sized(F.lit("VARCHAR2"), or_else("255"))).when(t == "char", sized(F.lit("CHAR"), or_else("1"))).when(t.isin(cells.INTEGERS), sized(F.lit("NUMBER"), size))
        .when(t.isin("decimal", "numeric"), sized(F.lit("NUMBER"), or_else("10,2"))).when(t == "datetime", "TIMESTAMP").when(t.isin("text", "longtext", "mediumtext"), "CLOB").otherwise(sized(F.upper(t), size))
    )
    return F.concat(name, F.lit(" "), kind, not_null)


def alter_columns(columns: DataFrame, table: Column, dialect: str = "mysql", unconfirmed: bool = False) -> DataFrame:
    """``columns`` (action, changed_fields, o, n and decision: accept, reject or pending) with step and statement. A rename is
    written as decided: renamed, and modified if its definition changed too; dropped and added; or, while pending, a note."""
    q = (lambda c: F.concat(F.lit("`"), c, F.lit("`"))) if dialect == "mysql" else (lambda c: c)
    name = lambda side: F.coalesce(F.nullif(F.col(f"{side}.physical"), F.lit("")), F.col(f"{side}.logical"), F.lit("column"))
    head, new = F.concat(F.lit("ALTER TABLE "), q(table), F.lit(" ")), _definition(F.col("n"), dialect)
    add, drop = F.concat(head, F.lit("ADD "), new, F.lit(";")), F.concat(head, F.lit("DROP COLUMN "), q(name("o")), F.lit(";"))
    modify = F.concat(head, F.lit("MODIFY COLUMN "), new, F.lit(";")) if dialect == "mysql" else F.concat(head, F.lit("MODIFY ("), new, F.lit(");"))
    rename = F.concat(head, F.lit("RENAME COLUMN "), q(name("o")), F.lit(" TO "), q(name("n")), F.lit(";"))
    redefined = F.arrays_overlap("changed_fields", F.array(*map(F.lit, ("dataType", "size", "notNull", "autoIncrement"))))
    note = F.concat(F.lit("-- TODO(confirm rename): "), name("o"), F.lit(" -> "), name("n"))
    action, decision = F.col("action"), F.when(F.col("action") == "renamed", "accept").otherwise(F.coalesce("decision", F.lit("pending")))
    suggested = action.isin("rename_suggest", "renamed")
    statements = (
        F.when(action == "added", F.array(add))
        .when(action == "removed", F.array(drop))
        .when(action == "modified", F.array(modify))
        .when(suggested & (decision == "accept"), F.when(redefined, F.array(rename, modify)).otherwise(F.array(rename)))
        .when(suggested & (decision == "reject"), F.array(drop, add))
        .when(suggested & F.lit(unconfirmed), F.array(note))
    )
    return columns.select("*", F.posexplode(statements).alias("step", "statement"))


def alter_tables(tables: DataFrame, created: DataFrame, dialect: str = "mysql", unconfirmed: bool = False, single_table: bool = False) -> DataFrame:
    """Statements of whole tables (step, statement): ``tables`` has action, o, n and decision, ``created`` the CREATE TABLE of new
    tables by table_id. In single_table mode tables that were added are left out."""
    q = (lambda c: F.concat(F.lit("`"), c, F.lit("`"))) if dialect == "mysql" else (lambda c: c)
    name = lambda side: F.coalesce(F.nullif(F.col(f"{side}.physical"), F.lit("")), F.col(f"{side}.logical"))
    rows = tables.join(created.select("sheet", F.col("table_id").alias("_new"), "ddl"), (tables["sheet"] == created["sheet"]) & (F.col("n.id") == F.col("_new")), "left").drop(created["sheet"])
    drop = F.concat(F.lit("DROP TABLE "), q(name("o")), F.lit(";"))
    rename = F.concat(F.lit("RENAME TABLE " if dialect == "mysql" else "ALTER TABLE "), q(name("o")), F.lit(" TO " if dialect == "mysql" else " RENAME TO "), q(name("n")), F.lit(";"))
    note = F.concat(F.lit("-- TODO(confirm rename): "), name("o"), F.lit(" -> "), name("n"))
    action, decision = F.col("action"), F.coalesce("decision", F.lit("pending"))
    statements = (
        F.when((action == "added") & F.lit(not single_table), F.array("ddl"))
        .when(action == "removed", F.array(drop))
        .when((action == "rename_suggest") & (decision == "accept"), F.array(rename))
        .when((action == "rename_suggest") & (decision == "reject"), F.array(drop, F.col("ddl")))
        .when((action == "rename_suggest") & F.lit(unconfirmed), F.array(note))
    )
    return rows.select("sheet", "action", name("o").alias("before"), name("n").alias("after"), F.posexplode(statements).alias("step", "statement"))


def designed_columns(draft: DataFrame, driver: str = "mysql") -> Column:
    """The definition of a designer's column: name, data_type, nullable, default_value, auto_increment and comment."""
    trimmed = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    parts = [quoted_column(F.col("name"), driver), F.trim("data_type"), F.when(~F.col("nullable"), F.lit("NOT NULL")), F.concat(F.lit("DEFAULT "), trimmed("default_value"))]
    if driver == "mysql":
        parts += [F.when(F.coalesce("auto_increment", F.lit(False)), F.lit("AUTO_INCREMENT")), F.concat(F.lit("COMMENT '"), _escaped(trimmed("comment")), F.lit("'"))]
    return F.concat_ws(" ", *parts)


def designed_tables(draft: DataFrame, driver: str = "mysql") -> DataFrame:
    """table_name and ddl of tables as designed; ``draft`` has table_name, position, is_pk and what a definition takes."""
    line = F.concat(F.lit("  "), designed_columns(draft, driver))
    rows = draft.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line"), F.when(F.col("is_pk"), quoted_column(F.col("name"), driver)).alias("key")))).alias("x"))
    keys = F.array_join(F.array_compact("x.key"), ", ")
    key_line = F.when(keys != "", F.array(F.concat(F.lit("  PRIMARY KEY ("), keys, F.lit(")")))).otherwise(F.array().cast("array<string>"))
    return rows.select("table_name", F.concat(F.lit("CREATE TABLE "), quoted_column(F.col("table_name"), driver), F.lit(" (\n"), F.array_join(F.concat(F.col("x.line"), key_line), ",\n"), F.lit("\n);")).alias("ddl"))


def designed_changes(original: DataFrame, draft: DataFrame, driver: str = "mysql") -> DataFrame:
    """table_name, kind, step and statement of what turns tables into their drafts. Columns are matched by original_name; one
    without (or of a name that isn't there) is added, one that no draft names is dropped. Comments in PostgreSQL are statements."""
    fields = ["data_type", "nullable", "default_value", "comment"]
    a = original.select("table_name", F.col("name").alias("original_name"), *(F.col(c).alias(f"a_{c}") for c in fields), F.lit(True).alias("there"))
    rows = draft.join(a, ["table_name", "original_name"], "left")
    t = F.concat(F.lit("ALTER TABLE "), quoted_column(F.col("table_name"), driver), F.lit(" "))
    col, definition = quoted_column(F.col("name"), driver), designed_columns(draft, driver)
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    kind_a, kind_b = F.lower(F.trim("a_data_type")), F.lower(F.trim("data_type"))
    typed_, nulls = kind_a != kind_b, F.col("a_nullable") != F.col("nullable")
    default, comment = blank(F.col("a_default_value")) != blank(F.col("default_value")), blank(F.col("a_comment")) != blank(F.col("comment"))
    renamed, new = F.col("original_name") != F.col("name"), F.col("there").isNull()
    made = lambda kind, sql: F.struct(F.lit(kind).alias("kind"), sql.alias("statement"))
    about = F.concat(F.lit("COMMENT ON COLUMN "), quoted_column(F.col("table_name"), driver), F.lit("."), col, F.when(blank(F.col("comment")) == "", F.lit(" IS NULL;")).otherwise(F.concat(F.lit(" IS '"), _escaped(blank(F.col("comment"))), F.lit("';"))))
    add = made("add-column", F.concat(t, F.lit("ADD COLUMN "), definition, F.lit(";")))
    if driver == "mysql":
        old = quoted_column(F.col("original_name"), driver)
        change = F.when(renamed, made("rename-column", F.concat(t, F.lit("CHANGE COLUMN "), old, F.lit(" "), definition, F.lit(";")))).when(typed_ | nulls | default | comment, made("modify-column", F.concat(t, F.lit("MODIFY COLUMN "), definition, F.lit(";"))))
        found = F.array_compact(F.array(F.when(new, add).otherwise(change)))
    else:
        alter = F.concat(t, F.lit("ALTER COLUMN "), col)
        each = [
            F.when(new, add),
            F.when(new & (blank(F.col("comment")) != ""), made("comment", about)),
            F.when(~new & renamed, made("rename-column", F.concat(t, F.lit("RENAME COLUMN "), quoted_column(F.col("original_name"), driver), F.lit(" TO "), col, F.lit(";")))),
            F.when(~new & typed_, made("modify-column", F.concat(alter, F.lit(" TYPE "), F.trim("data_type"), F.lit(";")))),
            F.when(~new & nulls, made("modify-column", F.concat(alter, F.when(F.col("nullable"), F.lit(" DROP NOT NULL;")).otherwise(F.lit(" SET NOT NULL;"))))),
            F.when(~new & default, made("modify-column", F.concat(alter, F.when(blank(F.col("default_value")) == "", F.lit(" DROP DEFAULT;")).otherwise(F.concat(F.lit(" SET DEFAULT "), blank(F.col("default_value")), F.lit(";")))))),
            F.when(~new & comment, made("modify-column", about)),
        ]
        found = F.array_compact(F.array(*each))
    out = rows.select("table_name", "name", F.posexplode(found).alias("step", "x")).select("table_name", "name", "step", "x.kind", "x.statement")
    named = draft.select("table_name", F.col("original_name").alias("name")).where("name is not null")
    gone = original.join(named, ["table_name", "name"], "left_anti").select("table_name", "name", F.lit(0).alias("step"), F.lit("drop-column").alias("kind"), F.concat(t, F.lit("DROP COLUMN "), col, F.lit(";")).alias("statement"))
    return out.unionByName(gone).unionByName(key_changes(original, draft, driver))


def key_changes(original: DataFrame, draft: DataFrame, driver: str = "mysql") -> DataFrame:
    """Statements that drop and add a primary key where its columns or their order changed."""
    def keys(df: DataFrame, side: str) -> DataFrame:
        x = F.array_sort(F.collect_list(F.when(F.col("is_pk"), F.struct("position", "name"))))
        return df.groupBy("table_name").agg(x.alias("x")).select("table_name", F.col("x.name").alias(side))

    rows = keys(original, "a").join(keys(draft, "b"), "table_name").where("a != b")
    t = F.concat(F.lit("ALTER TABLE "), quoted_column(F.col("table_name"), driver))
    drop = F.concat(t, F.lit(" DROP PRIMARY KEY;")) if driver == "mysql" else F.concat(t, F.lit(" DROP CONSTRAINT "), quoted_column(F.concat("table_name", F.lit("_pkey")), driver), F.lit(";"))
    add = F.concat(t, F.lit(" ADD PRIMARY KEY ("), F.array_join(F.transform("b", lambda c: quoted_column(c, driver)), ", "), F.lit(");"))
    both = F.array_compact(F.array(F.when(F.size("a") > 0, drop), F.when(F.size("b") > 0, add)))
    return rows.select("table_name", F.lit(None).cast("string").alias("name"), F.posexplode(both).alias("step", "statement")).select("table_name", "name", "step", F.lit("primary-key").alias("kind"), "statement")


def index_ddl(indexes: DataFrame, driver: str = "postgres") -> DataFrame:
    """table_name, index_name and statement; ``indexes`` has the columns in order (an array), is_unique and is_primary."""
    t, name = quoted_column(F.col("table_name"), driver), quoted_column(F.col("index_name"), driver)
    listed = F.concat(F.lit(" ("), F.array_join(F.transform("columns", lambda c: quoted_column(c, driver)), ", "), F.lit(");"))
    alter = F.concat(F.lit("ALTER TABLE "), t)
    if driver == "mysql":
        found = F.when(F.col("is_primary"), F.concat(alter, F.lit(" ADD PRIMARY KEY"), listed)).otherwise(F.concat(alter, F.when(F.col("is_unique"), F.lit(" ADD UNIQUE INDEX ")).otherwise(F.lit(" ADD INDEX ")), name, listed))
    else:
        unique = F.when(F.col("is_unique"), F.lit("UNIQUE ")).otherwise("")
        found = F.when(F.col("is_primary"), F.concat(alter, F.lit(" ADD CONSTRAINT "), name, F.lit(" PRIMARY KEY"), listed)).otherwise(F.concat(F.lit("CREATE "), unique, F.lit("INDEX "), name, F.lit(" ON "), t, listed))
    return indexes.select("table_name", "index_name", found.alias("statement"))


def foreign_key_ddl(keys: DataFrame, driver: str = "postgres") -> DataFrame:
    """table_name, constraint_name and statement; ``keys`` has columns and ref_columns (arrays) and ref_table."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: quoted_column(x, driver)), ", ")
    q = lambda c: quoted_column(F.col(c), driver)
    sql = F.concat(F.lit("ALTER TABLE "), q("table_name"), F.lit(" ADD CONSTRAINT "), q("constraint_name"), F.lit(" FOREIGN KEY ("), listed("columns"), F.lit(") REFERENCES "), q("ref_table"), F.lit(" ("), listed("ref_columns"), F.lit(");"))
    return keys.select("table_name", "constraint_name", sql.alias("statement"))


def typescript_enums(constants: DataFrame) -> DataFrame:
    """class_name and code: an object and its types for each class; ``constants`` has class_name, row, name, value and label."""
    escaped = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    label = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(", label: '"), escaped(F.col("label")), F.lit("'"))).otherwise("")
    line = F.concat(F.lit("  "), "name", F.lit(": { value: '"), escaped(F.col("value")), F.lit("'"), label, F.lit(" },"))
    rows = constants.groupBy("class_name").agg(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("x"))
    c = F.col("class_name")
    code = F.concat(F.lit("export const "), c, F.lit(" = {\n"), F.array_join("x.line", "\n"), F.lit("\n} as const;\n\nexport type "), c, F.lit("Key = keyof typeof "), c, F.lit(";\nexport type "), c, F.lit("Value = (typeof "), c, F.lit(")["), c, F.lit("Key];\n"))
    return rows.select("class_name", code.alias("code"))
