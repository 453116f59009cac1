"""CREATE TABLE text as data: columns, keys and indexes out of scripts, a script a row.

This reads the shape of well-formed scripts with regular expressions of Spark; it is no parser of SQL. Quoted text is taken as a
whole, so semicolons, brackets and comment marks in it part nothing. Statements other than CREATE TABLE are left out, as is what a
definition has besides a name, a type, NOT NULL, DEFAULT, AUTO_INCREMENT, UNIQUE, PRIMARY KEY and a comment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import cells
from quillspark.shared import settled

#: Tasks of a core that scripts are dealt to.
TASKS = 4
NAME = r"[`\"]?([\p{L}\p{N}_$]+)[`\"]?"


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, "[`\"]", "")


#: Quoted text, with quotes doubled or escaped in it, and comments.
TEXT = r"'(?:[^'\\]++|''|\\.)*+'"
QUOTED = TEXT + r"|\"[^\"]*+\"|`[^`]*+`"
COMMENT = r"/\*(?s:.*?)\*/|--[^\n]*|#[^\n]*"
#: What stands in brackets, two deep.
_INNER = rf"\((?:{QUOTED}|[^()'\"`]|\((?:{QUOTED}|[^()'\"`])*+\))*+\)"


def create_tables(scripts: DataFrame, sql: str = "sql") -> DataFrame:
    """The other columns of ``scripts``, table_no, table_name, body and options of each CREATE TABLE. Reading a script takes far longer
    than moving it, so scripts are dealt to all tasks, however few files they come from."""
    scripts = scripts.repartition(TASKS * scripts.sparkSession.sparkContext.defaultParallelism)
    body = F.regexp_replace(F.col(sql), rf"({QUOTED})|{COMMENT}", "$1 ")
    found = F.regexp_extract_all(body, F.lit(rf"(?is)\bcreate\s+table\s+(?:{QUOTED}|[^;'\"`])*+"), F.lit(0))
    rows = scripts.withColumn("x", found).select(*[c for c in scripts.columns if c != sql], F.posexplode("x").alias("table_no", "statement"))
    head = rf"(?is)^create\s+table\s+(?:if\s+not\s+exists\s+)?(?:{NAME}\s*\.\s*)?{NAME}\s*\(((?:{QUOTED}|[^()'\"`]|{_INNER})*+)\)(.*)$"
    part = lambda i: F.regexp_extract("statement", head, i)
    return rows.select(*[c for c in rows.columns if c != "statement"], part(2).alias("table_name"), part(3).alias("body"), part(4).alias("options")).where("table_name != ''")


def imported_tables(scripts: DataFrame, sql: str = "sql") -> DataFrame:
    """table_no, table_name and comment of the tables in scripts."""
    said = F.regexp_extract("options", rf"(?is)\bcomment\s*=?\s*({TEXT})", 1)
    return create_tables(scripts, sql).select(*[c for c in scripts.columns if c != sql], "table_no", "table_name", _unquoted(said).alias("comment"))


def _unquoted(c: Column) -> Column:
    """What a quoted text says; null if it is empty."""
    return F.nullif(F.replace(F.regexp_replace(c, r"(?s)^'(.*)'$", "$1"), F.lit("''"), F.lit("'")), F.lit(""))


def items(tables: DataFrame) -> DataFrame:
    """The parts of each body: item_no and item. Commas within brackets or quotes part nothing; white space outside quotes is one space."""
    rows = tables.select("*", F.posexplode(F.regexp_extract_all("body", F.lit(rf"(?s)((?:{QUOTED}|[^,()'\"`]|{_INNER})+)"), F.lit(1))).alias("item_no", "item"))
    spaced = F.regexp_replace("item", rf"({QUOTED})|\s+", "$1 ")
    tight = F.regexp_replace(F.regexp_replace(F.trim(spaced), rf"({QUOTED}) +", "$1 "), rf"({QUOTED}) (?=[,)])", "$1")
    return rows.withColumn("item", tight).where("item != ''").drop("body")


KEY_ITEM = r"(?i)^(constraint\b|primary key\b|unique\b|key\b|index\b|foreign key\b|fulltext\b|check\b)"


def imported_columns(scripts: DataFrame, sql: str = "sql") -> DataFrame:
    """Columns of the tables in scripts: table_no, table_name, position, column_name, type, size, not_null, auto_increment, comment, is_pk (by
    the column itself or by a PRIMARY KEY of the table), default_value (as it is written) and is_unique (by the column itself)."""
    every = settled(items(create_tables(scripts, sql)), "items")  # asked for several times, and dear
    kept = [c for c in scripts.columns if c != sql]
    made = every.where(~F.col("item").rlike(KEY_ITEM))
    name, rest = F.regexp_extract("item", rf"^{NAME}", 1), F.regexp_replace("item", rf"^{NAME}\s*", "")
    typed = F.regexp_extract(rest, r"^([A-Za-z][A-Za-z0-9_]*(?: ?\([^)]*\))?)", 1)
    x = cells.type_and_size(typed, F.lit(None).cast("string"))
    low = F.lower(F.regexp_replace(rest, QUOTED, "''"))
    said = _unquoted(F.regexp_extract(rest, rf"(?is)\bcomment\s+({TEXT})", 1))
    default = F.nullif(F.regexp_extract(rest, rf"(?is)\bdefault\s+({TEXT}|[^\s(]+(?:\([^)]*\))?)", 1), F.lit(""))
    rows = made.select(*kept, "table_no", "table_name", "item_no", name.alias("column_name"), x["type"].alias("type"), x["size"].alias("size"), (low.contains("not null") | low.contains("primary key")).alias("not_null"), (low.contains("auto_increment") | low.contains("generated")).alias("auto_increment"), said.alias("comment"), low.contains("primary key").alias("own"), default.alias("default_value"), low.rlike(r"\bunique\b").alias("is_unique"))
    keys = every.where(F.col("item").rlike(r"(?i)^(constraint \S+ )?primary key"))
    listed = F.transform(F.split(F.regexp_extract("item", r"\(([^)]*)\)", 1), ","), lambda c: F.trim(_bare(c)))
    keys = keys.select(*kept, "table_no", F.explode(listed).alias("column_name")).distinct().withColumn("listed", F.lit(True))
    by = [*kept, "table_no", "column_name"]
    rows = rows.join(keys, by, "left").withColumn("is_pk", F.col("own") | F.coalesce("listed", F.lit(False))).withColumn("not_null", F.col("not_null") | F.col("is_pk"))
    return rows.select(*kept, "table_no", "table_name", F.col("item_no").alias("position"), "column_name", "type", "size", "not_null", "auto_increment", "is_pk", "comment", "default_value", "is_unique")


def imported_keys(scripts: DataFrame, sql: str = "sql") -> DataFrame:
    """Foreign keys and indexes of the tables in scripts: kind (foreign, unique or index), key_name, columns, ref_table, ref_columns, on_delete
    and on_update (in upper case, null where nothing is said)."""
    kept = [c for c in scripts.columns if c != sql]
    rows = settled(items(create_tables(scripts, sql)), "items").where(F.col("item").rlike(KEY_ITEM) & ~F.col("item").rlike(r"(?i)^(constraint \S+ )?(primary key|check)"))
    kind = F.when(F.col("item").rlike(r"(?i)\bforeign key\b"), "foreign").when(F.col("item").rlike(r"(?i)\bunique\b"), "unique").otherwise("index")
    named = F.coalesce(F.nullif(F.regexp_extract("item", rf"(?i)^constraint {NAME}", 1), F.lit("")), F.nullif(F.regexp_extract("item", rf"(?i)^(?:unique )?(?:key|index) {NAME}", 1), F.lit("")))
    listed = lambda pattern: F.transform(F.filter(F.split(F.regexp_extract("item", pattern, 1), ","), lambda c: F.trim(c) != ""), lambda c: F.trim(_bare(c)))
    ref = F.nullif(F.regexp_extract("item", rf"(?i)references (?:{NAME} ?\. ?)?{NAME}", 2), F.lit(""))
    rule = lambda event: F.nullif(F.upper(F.regexp_extract("item", rf"(?i)\bon {event} (cascade|restrict|no action|set null|set default)", 1)), F.lit(""))
    return rows.select(*kept, "table_no", "table_name", kind.alias("kind"), named.alias("key_name"), listed(r"\(([^)]*)\)").alias("columns"), ref.alias("ref_table"), listed(r"(?i)references [^(]*\(([^)]*)\)").alias("ref_columns"), rule("delete").alias("on_delete"), rule("update").alias("on_update"))


#: Types whose columns may count up.
COUNTING = ["INT", "BIGINT", "SMALLINT", "TINYINT", "INTEGER"]


def issues(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """What is doubtful in imported tables: severity, kind, table_name and column_name. A table without columns blocks, one without a
    primary key asks for confirmation, a column that counts up with another type than whole numbers is for information."""
    on = [c for c in columns.columns if c in tables.columns and c != "comment"]
    found = columns.groupBy(*on).agg(F.bool_or("is_pk").alias("has"))
    known = tables.drop("comment").join(found, on, "left")
    none, wrong = F.lit(None).cast("string"), F.lit("workbook_inexpressible")
    keyless = known.where("not coalesce(has, false)").select(F.lit("confirm").alias("severity"), wrong.alias("kind"), "table_name", none.alias("column_name"))
    bare = known.where("has is null").select(F.lit("blocking").alias("severity"), wrong.alias("kind"), "table_name", none.alias("column_name"))
    lossy = columns.where(F.col("auto_increment") & ~F.upper(F.coalesce("type", F.lit(""))).isin(COUNTING)).select(F.lit("info").alias("severity"), F.lit("workbook_lossy").alias("kind"), "table_name", "column_name")
    return keyless.unionByName(bare).unionByName(lossy)


def issue_counts(found: DataFrame) -> DataFrame:
    return found.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("blocking", "confirm", "info")))
