"""Queries of DDL text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import ddl, matching, statements
from quillspark.plans.matching_queries import OLD_SQL, fixed_versions, versions
from quillspark.plans.registry import query, table, values_sql

TYPE = "case when data_type in ('varchar', 'char') then data_type || '(' || coalesce(size, '255') || ') CHARACTER SET utf8mb4 COLLATE utf8mb4_bin' when data_type = 'decimal' then 'decimal(' || coalesce(size, '10,2') || ')' when data_type = 'boolean' then 'tinyint(1)' else data_type || coalesce('(' || size || ')', '') end"
FIRST = "auto_increment and is_pk and data_type in ('int', 'bigint')"


@query(f"""select sheet, table_id, table_physical as table_name, 'SET NAMES utf8mb4;' || chr(10) || chr(10) || 'DROP TABLE IF EXISTS `' || table_physical || '`;' || chr(10) || 'CREATE TABLE `' || table_physical || '`  (' || chr(10)
|| string_agg('  `' || physical || '` ' || {TYPE} || case when not_null then ' NOT NULL' else '' end || case when {FIRST} then ' AUTO_INCREMENT' else '' end || ' COMMENT ''' || logical || '''', ',' || chr(10) order by position)
|| coalesce(',' || chr(10) || '  PRIMARY KEY (' || string_agg('`' || physical || '`', ', ' order by position) filter (where is_pk) || ') USING BTREE', '') || chr(10) || ') ENGINE = InnoDB CHARACTER SET = utf8mb4 COLLATE = utf8mb4_bin COMMENT = ''' || table_logical || ''';' as ddl from {OLD_SQL} group by sheet, table_id, table_physical, table_logical""")
def create_mysql(spark, folder):
    return ddl.create_tables(versions(spark, folder)[0], "mysql")


ORACLE = "case data_type when 'varchar' then 'VARCHAR2(' || coalesce(size, '255') || ')' when 'bigint' then 'NUMBER' when 'int' then 'NUMBER' when 'decimal' then 'NUMBER(' || coalesce(size, '10,2') || ')' when 'text' then 'CLOB' when 'boolean' then 'NUMBER(1)' end"


@query(f"""select sheet, table_id, table_physical as table_name, 'CREATE TABLE ' || table_physical || ' (' || chr(10) || string_agg('  ' || physical || ' ' || {ORACLE} || case when not_null then ' NOT NULL' else '' end, ',' || chr(10) order by position)
|| coalesce(',' || chr(10) || '  CONSTRAINT pk_' || table_physical || ' PRIMARY KEY (' || string_agg(physical, ', ' order by position) filter (where is_pk) || ')', '') || chr(10) || ');' || chr(10) || chr(10) || 'COMMENT ON TABLE ' || table_physical || ' IS ''' || table_logical || ''';' || chr(10)
|| string_agg('COMMENT ON COLUMN ' || table_physical || '.' || physical || ' IS ''' || logical || ''';', chr(10) order by position) as ddl from {OLD_SQL} group by sheet, table_id, table_physical, table_logical""")
def create_oracle(spark, folder):
    return ddl.create_tables(versions(spark, folder)[0], "oracle")


COUNTED = [("s", 1, 1, "id", "int(11)", True, True), ("s", 1, 2, "second", "bigint", True, True), ("s", 1, 3, "text_key", "varchar(5)", True, True), ("s", 1, 4, "other", "int", False, True), ("s", 2, 1, "id", "INTEGER", True, True), ("s", 2, 2, "plain", "int", True, False), ("s", 3, 1, "none", None, True, True)]


def counted(spark, folder):
    part, k = table(spark, folder, "part"), F.col("p_partkey")
    kind = F.when(k % 3 == 0, "int").when(k % 3 == 1, "BIGINT(20)").otherwise("varchar(9)")
    more = part.select(F.lit("s").alias("sheet"), (F.col("p_size") + 100).alias("table_id"), F.concat(F.lit("t"), F.col("p_size") + 100).alias("table_physical"), k.cast("int").alias("position"), F.concat(F.lit("c"), k).alias("physical"), kind.alias("data_type"), (k % 2 == 0).alias("is_pk"), (k % 5 < 3).alias("auto_increment"))
    rows = [(s, t, None, f"t{t}", p, None, name, kind, None, False, pk, auto, None) for s, t, p, name, kind, pk, auto in COUNTED]
    return spark.createDataFrame(rows, matching.DEFINITION).unionByName(more.withColumn("not_null", F.lit(False)), allowMissingColumns=True)


PLAN_SQL = f"(select *, case when not auto then null when not pk then 'not_primary_key' when coalesce(not regexp_matches(lower(kind), '^(tinyint|smallint|int|integer|bigint)([(].*)?$'), true) then 'non_numeric_type' else 'enabled' end as r from (select * from {values_sql(COUNTED, 'sheet, table_id, position, name, kind, pk, auto')} union all select 's', p_size + 100, p_partkey, 'c' || p_partkey, case p_partkey % 3 when 0 then 'int' when 1 then 'BIGINT(20)' else 'varchar(9)' end, p_partkey % 2 = 0, p_partkey % 5 < 3 from part))"


@query(f"select table_id, position, case when r = 'enabled' and row_number() over (partition by table_id, r order by position) > 1 then 'multiple_auto_increment' else r end as auto_plan from {PLAN_SQL}")
def auto_increment_plan(spark, folder):
    return ddl.auto_increment_plan(counted(spark, folder)).select("table_id", "position", "auto_plan")


@query(f"select 't' || table_id as table_name, name as column_name, case when r = 'enabled' then 'multiple_auto_increment' else r end as reason from (select *, row_number() over (partition by table_id, r order by position) as nth from {PLAN_SQL}) where r <> 'enabled' or (r = 'enabled' and nth > 1) union all select 'ora', 't' || table_id || '.' || name, 'dialect_unsupported' from {PLAN_SQL} where auto")
def auto_increment_warnings(spark, folder):
    oracle = ddl.auto_increment_warnings(counted(spark, folder), "oracle")
    return ddl.auto_increment_warnings(counted(spark, folder)).unionByName(oracle.select(F.lit("ora").alias("table_name"), F.concat_ws(".", "table_name", "column_name").alias("column_name"), "reason"))


@query(f"select 'Crt_' || table_physical || '.sql' as path from {OLD_SQL} where table_physical <> '' group by sheet, table_physical union all select 'export_errors.txt'")
def ddl_entries(spark, folder):
    return ddl.entries(ddl.create_tables(versions(spark, folder)[0])).select("path")


ALTERS = {
    "accept": ["ALTER TABLE `orders` MODIFY COLUMN `customer_id` bigint;", "ALTER TABLE `orders` RENAME COLUMN `total_amount` TO `total_amt`;", "ALTER TABLE `orders` MODIFY COLUMN `note` varchar(100);", "ALTER TABLE `orders` MODIFY COLUMN `` longtext;", "ALTER TABLE `orders` DROP COLUMN `old_flag`;", "ALTER TABLE `orders` ADD `created_at` datetime NOT NULL;"],
    "reject": ["ALTER TABLE orders MODIFY (customer_id NUMBER);", "ALTER TABLE orders DROP COLUMN total_amount;", "ALTER TABLE orders ADD total_amt NUMBER(10,2);", "ALTER TABLE orders MODIFY (note VARCHAR2(100));", "ALTER TABLE orders MODIFY (Memo CLOB);", "ALTER TABLE orders DROP COLUMN old_flag;", "ALTER TABLE orders ADD created_at TIMESTAMP NOT NULL;"],
    "pending": ["-- TODO(confirm rename): total_amount -> total_amt"],
}
ALTERS["accept"][3] = "ALTER TABLE `orders` MODIFY COLUMN `Memo` longtext;"


@query(f"select decision, statement from {values_sql([(d, s) for d, xs in ALTERS.items() for s in xs], 'decision, statement')}")
def alter_column_statements(spark, folder):
    _, columns = matching.schema_changes(*fixed_versions(spark))
    columns = columns.where("old_table = 1")
    decided = lambda d: columns.withColumn("decision", F.lit(d))
    table = F.lit("orders")
    accept, reject = ddl.alter_columns(decided("accept"), table), ddl.alter_columns(decided("reject"), table, "oracle")
    pending = ddl.alter_columns(decided("pending").where("action = 'rename_suggest'"), table, unconfirmed=True)
    return accept.unionByName(reject).unionByName(pending).select("decision", "statement")


TABLE_ALTERS = [("accept", "RENAME TABLE `customers` TO `customer_master`;"), ("accept", "DROP TABLE `legacy_log`;"), ("accept", "DROP TABLE `stores`;"), ("pending", "-- TODO(confirm rename): customers -> customer_master"), ("pending", "DROP TABLE legacy_log;"), ("pending", "DROP TABLE stores;"), ("reject", "DROP TABLE `customers`;")]


@query(f"select decision, statement from {values_sql(TABLE_ALTERS, 'decision, statement')}")
def alter_table_statements(spark, folder):
    old, new = fixed_versions(spark)
    tables, _ = matching.schema_changes(old, new)
    made = lambda d, dialect, **how: ddl.alter_tables(tables.withColumn("decision", F.lit(d)), ddl.create_tables(new, dialect), dialect, **how).withColumn("decision", F.lit(d))
    rows = made("accept", "mysql", single_table=True).unionByName(made("pending", "oracle", unconfirmed=True, single_table=True))
    rejected = made("reject", "mysql", single_table=True).where("step = 0 and before = 'customers'")
    return rows.unionByName(rejected).select("decision", "statement")


ORIGINAL = [("t", 1, "id", "int", False, None, True, None, True), ("t", 2, "name", "varchar(20)", True, "'x'", False, "a name", False), ("t", 3, "gone", "int", True, None, False, None, False), ("t", 4, "same", "int", True, None, False, None, False)]
DRAFT = [("t", 1, "id", "id", "int", False, None, True, None, False), ("t", 2, "name", "title", "VARCHAR(40)", False, None, False, "it's", True), ("t", 3, "same", "same", "INT", True, " ", False, "", False), ("t", 4, None, "fresh", "date", True, "now()", False, "new", True), ("t", 5, "unknown", "lost", "text", True, None, False, None, False)]


def designs(spark):
    old = spark.createDataFrame(ORIGINAL, "table_name string, position int, name string, data_type string, nullable boolean, default_value string, auto_increment boolean, comment string, is_pk boolean")
    new = spark.createDataFrame(DRAFT, "table_name string, position int, original_name string, name string, data_type string, nullable boolean, default_value string, auto_increment boolean, comment string, is_pk boolean")
    return old, new


DESIGNED = [
    ("mysql", "rename-column", "ALTER TABLE `t` CHANGE COLUMN `name` `title` VARCHAR(40) NOT NULL COMMENT 'it''s';"),
    ("mysql", "add-column", "ALTER TABLE `t` ADD COLUMN `fresh` date DEFAULT now() COMMENT 'new';"),
    ("mysql", "add-column", "ALTER TABLE `t` ADD COLUMN `lost` text;"),
    ("mysql", "drop-column", "ALTER TABLE `t` DROP COLUMN `gone`;"),
    ("mysql", "primary-key", "ALTER TABLE `t` DROP PRIMARY KEY;"),
    ("mysql", "primary-key", "ALTER TABLE `t` ADD PRIMARY KEY (`title`, `fresh`);"),
    ("postgres", "rename-column", 'ALTER TABLE "t" RENAME COLUMN "name" TO "title";'),
    ("postgres", "modify-column", 'ALTER TABLE "t" ALTER COLUMN "title" TYPE VARCHAR(40);'),
    ("postgres", "modify-column", 'ALTER TABLE "t" ALTER COLUMN "title" SET NOT NULL;'),
    ("postgres", "modify-column", 'ALTER TABLE "t" ALTER COLUMN "title" DROP DEFAULT;'),
    ("postgres", "modify-column", "COMMENT ON COLUMN \"t\".\"title\" IS 'it''s';"),
    ("postgres", "add-column", 'ALTER TABLE "t" ADD COLUMN "fresh" date DEFAULT now();'),
    ("postgres", "comment", "COMMENT ON COLUMN \"t\".\"fresh\" IS 'new';"),
    ("postgres", "add-column", 'ALTER TABLE "t" ADD COLUMN "lost" text;'),
    ("postgres", "drop-column", 'ALTER TABLE "t" DROP COLUMN "gone";'),
    ("postgres", "primary-key", 'ALTER TABLE "t" DROP CONSTRAINT "t_pkey";'),
    ("postgres", "primary-key", 'ALTER TABLE "t" ADD PRIMARY KEY ("title", "fresh");'),
]


@query(f"select driver, kind, statement from {values_sql(DESIGNED, 'driver, kind, statement')}")
def designed_changes(spark, folder):
    old, new = designs(spark)
    out = [ddl.designed_changes(old, new, d).select(F.lit(d).alias("driver"), "kind", "statement") for d in ("mysql", "postgres")]
    return out[0].unionByName(out[1])


@query(f"""select table_name, 'CREATE TABLE "t" (' || chr(10) || string_agg('  "' || name || '" ' || trim(kind) || case when nullable then '' else ' NOT NULL' end || coalesce(' DEFAULT ' || nullif(trim(def), ''), ''), ',' || chr(10) order by position) || ',' || chr(10) || '  PRIMARY KEY (' || string_agg('"' || name || '"', ', ' order by position) filter (where pk) || ')' || chr(10) || ');' as ddl
from {values_sql(DRAFT, 'table_name, position, original, name, kind, nullable, def, auto, comment, pk')} group by table_name""")
def designed_tables(spark, folder):
    return ddl.designed_tables(designs(spark)[1], "postgres")


INDEXES = [("t", "t_pkey", ["id"], True, True), ("t", "by_name", ["last", "first"], False, False), ("t", "one", ["code"], True, False)]


@query(f"""select driver, index_name, case when driver = 'mysql' then 'ALTER TABLE `t` ADD ' || case when pk then 'PRIMARY KEY' when uq then 'UNIQUE INDEX `' || index_name || '`' else 'INDEX `' || index_name || '`' end || ' (' || list_aggregate(list_transform(cols, lambda x: '`' || x || '`'), 'string_agg', ', ') || ');'
when pk then 'ALTER TABLE "t" ADD CONSTRAINT "' || index_name || '" PRIMARY KEY (' || list_aggregate(list_transform(cols, lambda x: '"' || x || '"'), 'string_agg', ', ') || ');' else 'CREATE ' || case when uq then 'UNIQUE ' else '' end || 'INDEX "' || index_name || '" ON "t" (' || list_aggregate(list_transform(cols, lambda x: '"' || x || '"'), 'string_agg', ', ') || ');' end as statement
from {values_sql(INDEXES, 'table_name, index_name, cols, uq, pk')}, (values ('mysql'), ('postgres')) as d(driver)""")
def index_statements(spark, folder):
    df = spark.createDataFrame(INDEXES, "table_name string, index_name string, columns array<string>, is_unique boolean, is_primary boolean")
    out = [ddl.index_ddl(df, d).select(F.lit(d).alias("driver"), "index_name", "statement") for d in ("mysql", "postgres")]
    return out[0].unionByName(out[1])


@query("""select 'fk' as constraint_name, 'ALTER TABLE "line" ADD CONSTRAINT "fk" FOREIGN KEY ("a", "b") REFERENCES "part" ("x", "y");' as statement""")
def foreign_key_statements(spark, folder):
    df = spark.createDataFrame([("line", "fk", ["a", "b"], "part", ["x", "y"])], "table_name string, constraint_name string, columns array<string>, ref_table string, ref_columns array<string>")
    return ddl.foreign_key_ddl(df).select("constraint_name", "statement")


OPERATIONS = [("drop", "mysql", "DROP TABLE IF EXISTS `s`.`a`;"), ("truncate", "mysql", "TRUNCATE TABLE `s`.`a`;"), ("rename", "mysql", "RENAME TABLE `s`.`a` TO `s`.`b`;"), ("duplicate", "mysql", "CREATE TABLE `s`.`b` LIKE `s`.`a`;"), ("rename", "postgres", 'ALTER TABLE "s"."a" RENAME TO "b";'), ("duplicate", "postgres", 'CREATE TABLE "s"."b" (LIKE "s"."a" INCLUDING ALL);')]


@query(f"select kind, driver, statement from {values_sql(OPERATIONS, 'kind, driver, statement')}")
def table_operations(spark, folder):
    return spark.createDataFrame([(k, d, statements.table_operation(k, "a", d, "b", "s", True)) for k, d, _ in OPERATIONS], "kind string, driver string, statement string")


CONSTANTS = [("Status", 1, "OPEN", "o", "Open'd"), ("Status", 2, "DONE", "d\\", None), ("Kind", 3, "A", "1", "")]


@query(f"""select cls as class_name, 'export const ' || cls || ' = {{' || chr(10) || string_agg('  ' || name || ': {{ value: ''' || replace(v, chr(92), chr(92) || chr(92)) || '''' || case when coalesce(label, '') <> '' then ', label: ''' || replace(label, '''', chr(92) || '''') || '''' else '' end || ' }},', chr(10) order by row_) || chr(10) || '}} as const;' || chr(10) || chr(10)
|| 'export type ' || cls || 'Key = keyof typeof ' || cls || ';' || chr(10) || 'export type ' || cls || 'Value = (typeof ' || cls || ')[' || cls || 'Key];' || chr(10) as code from {values_sql(CONSTANTS, 'cls, row_, name, v, label')} group by cls""")
def enum_code(spark, folder):
    return ddl.typescript_enums(spark.createDataFrame(CONSTANTS, "class_name string, row int, name string, value string, label string"))
