"""Queries of workbooks, scripts and catalogs as sources."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators import ddl
from quillspark.plans.diff_queries import VERSIONS, compared
from quillspark.plans.matching_queries import OLD, OLD_SQL, versions
from quillspark.plans.registry import query, table, values_sql
from quillspark.shared import fresh_dir
from quillspark.sources import catalog, ddl_text, workbook

C = F.col


def grid(spark, sheets):
    rows = [("w.xlsx", i, name, r, cells) for i, (name, lines) in enumerate(sheets.items()) for r, cells in enumerate(lines)]
    return spark.createDataFrame(rows, workbook.GRID)


SHEETS = {
    "a": [["テーブル情報"], ["論理テーブル名", "受注", "", "物理テーブル名", "orders"], ["No", "論理名", "物理名", "データ型", "Size", "Not Null", "PK", "備考"], ["1", "受注番号", "order_id", "bigint (AI)", "", "○", "〇", ""], ["2", "RDBMS", "MySQL", "", "", "", "", ""], ["3", "金額", "amount", "decimal（10，2）", "", "NOT NULL 制約", "", "自動採番なし"], ["No", "論理名", "物理名", "データ型", "", "", "", ""], ["4", "備考", "note", "varchar", "100", "任意", "", "identity"]],
    "b": [["データベース定義書"], ["No.", "論理テーブル名", "物理テーブル名"], ["1", "店舗", "stores"]],
    "c": [["", "物理テーブル名", "items"], ["", "論理名", "物理名", "データ型"], ["", "コード", "code", "char(3)"], *[[""]] * 12, ["", "遠い", "far", "int"]],
    "d": [["memo"], ["x", "y"]],
}


@query(f"select sheet, a as score_a, b as score_b, format from {values_sql([('a', 9 + 1, 1, 'A'), ('b', 1, 8 + 3 + 1, 'B'), ('c', 2, 0, 'A'), ('d', 0, 0, 'unknown')], 'sheet, a, b, format')}")
def workbook_formats(spark, folder):
    return workbook.sheet_formats(grid(spark, SHEETS)).select("sheet", "score_a", "score_b", "format")


DEFINED = [("a", "orders", 1, "order_id", "bigint", None, True, True, True), ("a", "orders", 2, "amount", "decimal", "10,2", True, False, False), ("a", "orders", 3, "note", "varchar", "100", False, False, True), ("c", "items", 1, "code", "char", "3", False, False, False)]
DEFINED_SQL = values_sql(DEFINED, "sheet, table_name, position, physical_name, type, size, not_null, is_pk, auto_increment")


@query(f"select sheet, table_name, position, physical_name, type, size, not_null, is_pk, auto_increment from {DEFINED_SQL}")
def sheet_definitions(spark, folder):
    return workbook.table_definitions(grid(spark, SHEETS)).select("sheet", "table_name", "position", "physical_name", "type", "size", "not_null", "is_pk", "auto_increment")


@query(f"select distinct 'table' as kind, sheet, table_name as name, true as has_tables from {DEFINED_SQL} union all select 'sheet', s, s, s in ('a', 'c') from (select unnest(['a', 'b', 'c', 'd']) as s)")
def workbook_search_index(spark, folder):
    g = grid(spark, SHEETS)
    return workbook.search_index(g, workbook.table_definitions(g)).select("kind", "sheet", "name", "has_tables")


REGION = {"r": [["", "", "物理テーブル名", "left_one", "", "", "物理テーブル名", "right_one"], ["", "", "論理名", "物理名", "データ型", "", "論理名", "物理名", "データ型"], ["", "", "a", "aa", "int", "", "b", "bb", "date"]]}


@query("select 'right_one' as table_name, 'bb' as physical_name, 'date' as type union all select 'left_one', 'aa', 'int'")
def region_definitions(spark, folder):
    g = grid(spark, REGION)
    right, left = workbook.region(g, "r", 1, 2, 6, 8), workbook.region(g.withColumn("cells", F.slice("cells", 1, 5)), "r", 1, 2, 2, 4)
    both = workbook.table_definitions(right).unionByName(workbook.table_definitions(left))
    return both.select("table_name", "physical_name", "type")


ENUM_SHEET = {"e": [["enums"], ["Group", "Constant", "Value", "Label"], ["order status", "open", "1", "Open"], ["order status", "in progress", "2", ""], ["order status", "OPEN", "3", "again"], ["", "skipped", "9", ""], ["kind", "", "5", ""], ["kind", "a", "x", "A"]]}


@query("""select * from (values (2, 'OrderStatus', 'OPEN', '1', 'Open', false), (3, 'OrderStatus', 'IN_PROGRESS', '2', null, false), (4, 'OrderStatus', 'OPEN', '3', 'again', true), (6, 'Kind', 'UNKNOWN', '5', null, true), (7, 'Kind', 'A', 'x', 'A', false)) as t(row, class_name, name, value, label, duplicate)""")
def enum_sheet(spark, folder):
    return workbook.enum_constants(grid(spark, ENUM_SHEET)).select("row", "class_name", "name", "value", "label", "duplicate")


@query("select unnest(['Kind', 'OrderStatus']) as class_name, unnest([1, 2]) as n_constants")
def enum_sheet_code(spark, folder):
    """Code made from the sheet: as many constants a class as it has lines with a value."""
    code = ddl.typescript_enums(workbook.enum_constants(grid(spark, ENUM_SHEET)).where("not duplicate"))
    return code.select("class_name", (F.size(F.split("code", "value: '")) - 1).alias("n_constants"))


SCRIPTS = [
    (1, "-- shop\nCREATE TABLE IF NOT EXISTS `shop`.`orders` (\n `id` bigint(20) NOT NULL AUTO_INCREMENT COMMENT 'key, of it''s row',\n `total` DECIMAL(10,2) DEFAULT '0,0',\n customer_id int NOT NULL,\n PRIMARY KEY (`id`),\n UNIQUE KEY `by_total` (`total`, `customer_id`),\n CONSTRAINT `fk_c` FOREIGN KEY (`customer_id`) REFERENCES `customers` (`id`)\n) ENGINE=InnoDB COMMENT='Orders';\nINSERT INTO orders VALUES (1);\nALTER TABLE orders ADD x int;"),
    (2, "create table items (code varchar(3) primary key, label text /* shown, (never) */ , qty int);create table loose (a int, A date)"),
]
IMPORTED = [(1, "orders", "id", "bigint", "20", True, True, True, "key, of it's row"), (1, "orders", "total", "decimal", "10,2", False, False, False, None), (1, "orders", "customer_id", "int", None, True, False, False, None), (2, "items", "code", "varchar", "3", True, False, True, None), (2, "items", "label", "text", None, False, False, False, None), (2, "items", "qty", "int", None, False, False, False, None), (2, "loose", "a", "int", None, False, False, False, None), (2, "loose", "A", "date", None, False, False, False, None)]


def scripts(spark):
    return spark.createDataFrame(SCRIPTS, "id int, sql string")


@query(f"select id, t as table_name, c as column_name, k as type, s as size, nn as not_null, ai as auto_increment, pk as is_pk, m as comment from {values_sql(IMPORTED, 'id, t, c, k, s, nn, ai, pk, m')}")
def ddl_import(spark, folder):
    return ddl_text.imported_columns(scripts(spark)).select("id", "table_name", "column_name", "type", "size", "not_null", "auto_increment", "is_pk", "comment")


@query("select unnest(['foreign', 'unique']) as kind, unnest(['fk_c', 'by_total']) as key_name, unnest(['customer_id', 'total,customer_id']) as columns, unnest(['customers', null]) as ref_table, unnest(['id', '']) as ref_columns")
def ddl_import_keys(spark, folder):
    rows = ddl_text.imported_keys(scripts(spark))
    return rows.select("kind", "key_name", F.array_join("columns", ",").alias("columns"), "ref_table", F.array_join("ref_columns", ",").alias("ref_columns"))


@query("select 0 as blocking, 1 as confirm, 0 as info")
def ddl_import_issues(spark, folder):
    df = scripts(spark)
    return ddl_text.issue_counts(ddl_text.issues(ddl_text.imported_tables(df), ddl_text.imported_columns(df)))


def part_scripts(spark, folder):
    """A script for each part: quotes with marks in them, defaults, rules, tables without keys or columns."""
    k, c = F.col("p_partkey"), F.concat
    said = lambda *parts: c(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    kind, key = F.when(k % 4 == 1, "varchar(9)").otherwise("bigint"), F.when(k % 3 == 0, "").otherwise(" PRIMARY KEY (`id`),")
    rules = F.when(k % 5 == 0, " ON DELETE SET NULL ON UPDATE CASCADE").otherwise("")
    full = said(
        "insert into x values (';');\n-- it's `one`\nCREATE TABLE IF NOT EXISTS `shop`.`t_", k, "` ( `id` ", kind, " NOT NULL AUTO_INCREMENT,\n name varchar(", F.col("p_size"), ") DEFAULT '", F.col("p_name"), "; -- (x' UNIQUE COMMENT 'it''s ", F.col("p_type"),
        ", /* kept */', made timestamp default now(),", key, " CONSTRAINT `fk_", k, "` FOREIGN KEY (`name`) REFERENCES `shop`.`brands` (`brand`)", rules, ") ENGINE=InnoDB COMMENT='", F.col("p_brand"), ";';",
    )
    return table(spark, folder, "part").select("p_partkey", F.when(k % 50 == 7, said("/* none; */ create table t_", k, " ();")).otherwise(full).alias("sql"))


@query("""select p_partkey, x.* from part, lateral (select unnest([{'column_name': 'id', 'type': case when p_partkey % 4 = 1 then 'varchar' else 'bigint' end, 'size': case when p_partkey % 4 = 1 then '9' end, 'not_null': true, 'is_pk': p_partkey % 3 <> 0, 'is_unique': false, 'default_value': null, 'comment': null},
{'column_name': 'name', 'type': 'varchar', 'size': p_size::varchar, 'not_null': false, 'is_pk': false, 'is_unique': true, 'default_value': '''' || p_name || '; -- (x''', 'comment': 'it''s ' || p_type || ', /* kept */'}, {'column_name': 'made', 'type': 'timestamp', 'size': null, 'not_null': false, 'is_pk': false, 'is_unique': false, 'default_value': 'now()', 'comment': null}]) as x) where p_partkey % 50 <> 7""")
def ddl_import_columns(spark, folder):
    return ddl_text.imported_columns(part_scripts(spark, folder)).select("p_partkey", "column_name", "type", "size", "not_null", "is_pk", "is_unique", "default_value", "comment")


@query("select p_partkey, 't_' || p_partkey as table_name, case when p_partkey % 50 <> 7 then p_brand || ';' end as comment, case when p_partkey % 50 <> 7 then 'fk_' || p_partkey end as key_name, case when p_partkey % 50 <> 7 then 'brands' end as ref_table, case when p_partkey % 50 <> 7 and p_partkey % 5 = 0 then 'SET NULL' end as on_delete, case when p_partkey % 50 <> 7 and p_partkey % 5 = 0 then 'CASCADE' end as on_update from part")
def ddl_import_rules(spark, folder):
    df = part_scripts(spark, folder)
    keys = ddl_text.imported_keys(df).select("p_partkey", "key_name", "ref_table", "on_delete", "on_update")
    return ddl_text.imported_tables(df).select("p_partkey", "table_name", "comment").join(keys, "p_partkey", "left")


@query("""select 'confirm' as severity, 't_' || p_partkey as table_name, null as column_name from part where p_partkey % 50 = 7 or p_partkey % 3 = 0 union all select 'blocking', 't_' || p_partkey, null from part where p_partkey % 50 = 7
union all select 'info', 't_' || p_partkey, 'id' from part where p_partkey % 50 <> 7 and p_partkey % 4 = 1""")
def ddl_import_doubts(spark, folder):
    df = part_scripts(spark, folder)
    return ddl_text.issues(ddl_text.imported_tables(df), ddl_text.imported_columns(df)).select("severity", "table_name", "column_name")


SIDES = """(select *, row_number() over (partition by p_brand, side order by p_partkey) as i from (select p_brand, p_partkey, p_partkey % 2 as side, p_size, p_type from part))"""


def side_by_side(spark, folder):
    """A sheet for each brand with two tables beside each other, of parts with even and with odd keys, and a third one below."""
    part = table(spark, folder, "part").withColumn("side", (C("p_partkey") % 2).cast("int"))
    place = F.row_number().over(W.partitionBy("p_brand", "side").orderBy("p_partkey"))
    head, none = ["No", "論理名", "物理名", "データ型", "Size"], F.array(*map(F.lit, [""] * 5))
    lit = lambda cells: F.array(*map(F.lit, cells))
    cells = part.select("p_brand", "side", place.alias("row_idx"), F.array(place.cast("string"), C("p_type"), F.concat(F.lit("c_"), C("p_partkey")), F.lit("varchar"), C("p_size").cast("string")).alias("x"))
    rows = cells.groupBy("p_brand", "row_idx").agg(F.max(F.when(C("side") == 0, C("x"))).alias("a"), F.max(F.when(C("side") == 1, C("x"))).alias("b"))
    rows = rows.select("p_brand", (C("row_idx") + 2).alias("row_idx"), F.concat(F.coalesce("a", none), lit(["", ""]), F.coalesce("b", none)).alias("cells"))
    brands = part.groupBy("p_brand").agg(F.lit(1).alias("n"))
    name = lambda side: F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(f"_{side}"))
    label = brands.select("p_brand", F.lit(0).alias("row_idx"), F.array(F.lit("物理テーブル名"), name(0), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit("物理テーブル名"), name(1)).alias("cells"))
    headers = brands.select("p_brand", F.lit(1).alias("row_idx"), lit([*head, "", "", *head]).alias("cells"))
    grid_ = label.unionByName(headers).unionByName(rows)
    return grid_.select(F.lit("x").alias("path"), F.lit(1).alias("sheet_no"), C("p_brand").alias("sheet"), C("row_idx").cast("int").alias("row_idx"), "cells")


@query(f"select p_brand as sheet, replace(lower(p_brand), '#', '_') || '_' || side as table_name, i as position, 'c_' || p_partkey as physical_name, p_type as logical_name, p_size::varchar as size from {SIDES}")
def side_by_side_tables(spark, folder):
    return workbook.all_definitions(side_by_side(spark, folder)).select("sheet", "table_name", "position", "physical_name", "logical_name", "size")


FKS = [("orders", "fk_b", ["customer_id"], "customers", ["customer_id"]), ("Orders", "fk_a", ["CUSTOMER_ID"], "customers", ["customer_id"]), ("orders", "fk_x", ["x"], "nowhere", ["x"]), ("stores", "fk_s", ["a", "b"], "orders", ["order_id", "note"])]


@query(f"select arg_min(t, c) as table_name, min(c) as constraint_name from {values_sql(FKS, 't, c, cols, r, rcols')} where r <> 'nowhere' group by lower(t), lower(array_to_string(cols, ',')), lower(r), lower(array_to_string(rcols, ','))")
def fk_join_edges(spark, folder):
    fks = spark.createDataFrame(FKS, "table_name string, constraint_name string, columns array<string>, ref_table string, ref_columns array<string>")
    known = versions(spark, folder)[0].select(C("table_physical").alias("table_name")).distinct()
    return catalog.join_edges(fks, known).select("table_name", "constraint_name")


@query(f"select table_physical as table_name, physical as column_name, is_pk, comment from {OLD_SQL} where physical <> ''")
def metadata_join(spark, folder):
    rows = versions(spark, folder)[0].where("physical != ''").select(C("table_physical").alias("table_name"), C("physical").alias("column_name"), "is_pk", "comment")
    on = ["table_name", "column_name"]
    return catalog.with_metadata(rows.select(*on), rows.where("is_pk").select(*on), rows.where("comment is not null").select(*on, "comment"))


@query("select n_nationkey as table_id, case when n_nationkey % 4 = 0 then upper(n_name) || '!' else n_name end as name from nation where n_nationkey % 2 = 0")
def override_join(spark, folder):
    tables = table(spark, folder, "nation").select(C("n_nationkey").alias("table_id"), C("n_name").alias("name"))
    return catalog.overridden(tables, tables.where("table_id % 2 = 0").select("table_id"), tables.where("table_id % 4 = 0").withColumn("name", F.concat(F.upper("name"), F.lit("!"))))


@query("select unnest(['t1', 't3']) as table_physical, unnest([2, 1]) as n_columns, unnest(['b,c', 'x']) as columns")
def missing_type_groups(spark, folder):
    rows = [("s", t, f"t{t}", p, n, k) for t, p, n, k in [(1, 1, "a", "int"), (1, 3, "c", " "), (1, 2, "b", None), (2, 1, "d", "text"), (3, 1, "x", "")]]
    df = spark.createDataFrame(rows, "sheet string, table_id int, table_physical string, position int, physical string, data_type string").withColumn("logical", F.lit(None).cast("string"))
    return catalog.missing_types(df).select("table_physical", "n_columns", "columns")


@query(f"select sheet, table_id, position, row_number() over (partition by sheet, table_id order by case when physical <> '' then lower(physical) else lower(replace(logical, ' ', '_')) end) as place from {OLD_SQL}")
def canonical_columns(spark, folder):
    return catalog.canonical(versions(spark, folder)[0]).select("sheet", "table_id", "position", "place")


@query(VERSIONS + """select '{"o_orderkey":' || o_orderkey || '}' as row_key, status from cmp where status <> 'unchanged'""")
def stored_comparisons(spark, folder):
    """Written twice, read before and after its time is over."""
    path = fresh_dir(spark, "comparisons")
    rows = compared(spark, folder).where("status != 'unchanged'")
    for i in ("one", "two"):
        catalog.store_comparison(rows, path, i, "orders", "2024-01-01 00:00:00")
    late = catalog.stored_comparison(spark, path, "two", "2024-01-01 00:20:00").select("row_key", "status")
    return catalog.stored_comparison(spark, path, "one", "2024-01-01 00:10:00").select("row_key", "status").unionByName(late)


@query("select 'region' as table_name, 'r_regionkey' as column_name, 'int' as type union all select 'region', 'r_name', 'string'")
def catalog_columns(spark, folder):
    table(spark, folder, "region").createOrReplaceTempView("region")
    return catalog.columns(spark).where("table_name = 'region'").select("table_name", "column_name", "type")
