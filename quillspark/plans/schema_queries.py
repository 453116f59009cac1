"""Queries of schema comparison, on the schemas of the tables and an edited version of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import matching, names, schema_diff
from quillspark.plans.registry import query, table

TABLES = ["customer", "nation", "orders", "part", "region", "supplier"]
KEYS = {"customer": ["c_custkey"], "nation": ["n_nationkey"], "orders": ["o_orderkey"], "part": ["p_partkey"], "region": ["r_regionkey"], "supplier": ["s_suppkey"]}

#: What information_schema calls the types of these tables.
OLD = """with old as (select table_name, column_name, cast(ordinal_position as int) - 1 as position, case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' else 'timestamp_ntz' end as type,
column_name in ('c_custkey', 'n_nationkey', 'o_orderkey', 'p_partkey', 'r_regionkey', 's_suppkey') as is_pk from information_schema.columns where table_name in ('customer', 'nation', 'orders', 'part', 'region', 'supplier')),
new as (select table_name, case column_name when 'p_brand' then 'p_brand_name' else column_name end as column_name, position, case when type = 'double' then 'decimal(12,2)' else type end as type, is_pk from old where column_name not in ('n_regionkey', 'o_orderpriority'))
"""


def old_and_new(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    old = schema_diff.catalog_columns(spark, {t: table(spark, folder, t) for t in TABLES}, KEYS)
    new = old.where("column_name not in ('n_regionkey', 'o_orderpriority')")
    new = new.withColumn("type", F.expr("case when type = 'double' then 'decimal(12,2)' else type end"))
    return old, new.withColumn("column_name", F.expr("case column_name when 'p_brand' then 'p_brand_name' else column_name end"))


@query(OLD + """select coalesce(o.table_name, n.table_name) as table_name, coalesce(o.column_name, n.column_name) as column_name, case when n.column_name is null then 'removed' when o.column_name is null then 'added' else 'changed' end as action,
case when n.column_name is not null and o.column_name is not null then 'type' else '' end as changed_fields
from old o full join new n on o.table_name = n.table_name and o.column_name = n.column_name where o.column_name is null or n.column_name is null or o.type <> n.type""")
def schema_diff_columns(spark, folder):
    return schema_diff.column_diff(*old_and_new(spark, folder))


@query(OLD + "select o.table_name, 'removed' as action from (select distinct table_name from old) o where o.table_name not in (select table_name from new where table_name <> 'region')")
def schema_diff_tables(spark, folder):
    old, new = old_and_new(spark, folder)
    return schema_diff.table_diff(old, new.where("table_name <> 'region'"))


@query(OLD + """, n as (select * from new where table_name <> 'region'), both_ as (select table_name, column_name, bool_or(is_pk) as k, bool_or(side = 0) as s, bool_or(side = 1) as t from (select table_name, column_name, is_pk, 0 as side from old where table_name <> 'nation' union all select table_name, column_name, is_pk, 1 from n) group by all)
select table_name, bool_or(s) as in_source, bool_or(t) as in_target, coalesce(string_agg(column_name, ',' order by column_name) filter (where k), '') as keys, coalesce(string_agg(column_name, ',' order by column_name) filter (where not k), '') as compare_columns from both_ group by table_name""")
def sync_index(spark, folder):
    old, new = old_and_new(spark, folder)
    return schema_diff.sync_index(old.where("table_name != 'nation'"), new.where("table_name != 'region'"))


@query(OLD + "select table_name || '|' || string_agg(column_name, ',' order by column_name) as signature from old group by table_name")
def table_signatures(spark, folder):
    return schema_diff.signatures(old_and_new(spark, folder)[0])


@query(OLD + """, o as (select table_name, column_name as x from old where (table_name, column_name) not in (select table_name, column_name from new)), n as (select table_name, column_name as y from new where (table_name, column_name) not in (select table_name, column_name from old))
select o.table_name, x as old, y as new from o join n on o.table_name = n.table_name""")
def column_matches(spark, folder):
    """Columns left over after exact matching, paired by similarity, best first: here one pair, of the renamed column."""
    old, new = (rows.select(F.lit("s").alias("sheet"), "table_name", F.struct(F.col("position").alias("id"), F.lit("").alias("logical"), F.col("column_name").alias("physical"), F.col("type").alias("data_type"), F.lit(None).cast("string").alias("size"), (~F.col("nullable")).alias("not_null"), "is_pk", F.lit(False).alias("auto_increment"), F.lit(None).cast("string").alias("comment")).alias("x")) for rows in old_and_new(spark, folder))
    scope = ["sheet", "table_name"]
    pairs = matching.matched(old, new, scope, matching.column_score).where("phase = 'fuzzy'")
    named = lambda df, side: df.select(*scope, F.col("x.id").alias(f"{side}_id"), F.col("x.physical").alias(side))
    return pairs.join(named(old, "old"), [*scope, "old_id"]).join(named(new, "new"), [*scope, "new_id"]).select("table_name", "old", "new")


@query(OLD + "select table_name, 'pk_' || table_name as index_name, string_agg(column_name, ',' order by position) as columns from old where is_pk group by table_name union all select table_name, 'all_' || table_name, string_agg(column_name, ',' order by position) from old group by table_name")
def index_assembly(spark, folder):
    old = old_and_new(spark, folder)[0]
    parts = old.where("is_pk").withColumn("index_name", F.concat(F.lit("pk_"), "table_name")).unionByName(old.withColumn("index_name", F.concat(F.lit("all_"), "table_name")))
    return schema_diff.assemble_indexes(parts.withColumnRenamed("position", "seq"))


@query("select 'fk_nation' as constraint_name, 'nation.n_regionkey = region.r_regionkey' as condition union all select 'fk_orders', 'orders.o_custkey = customer.c_custkey' union all select 'fk_lineitem', 'lineitem.l_partkey = part.p_partkey AND lineitem.l_suppkey = supplier.s_suppkey'")
def fk_join_condition(spark, folder):
    rows = [("fk_nation", "nation", 1, "n_regionkey", "region", "r_regionkey"), ("fk_orders", "orders", 1, "o_custkey", "customer", "c_custkey"), ("fk_lineitem", "lineitem", 2, "l_suppkey", "supplier", "s_suppkey"), ("fk_lineitem", "lineitem", 1, "l_partkey", "part", "p_partkey")]
    return schema_diff.join_conditions(spark.createDataFrame(rows, "constraint_name string, table_name string, seq int, column_name string, ref_table string, ref_column string"))


@query("select p_partkey, case when i = 1 then base else base || '_' || cast(i as varchar) end as resolved from (select p_partkey, base, row_number() over (partition by p_type, base order by p_partkey) as i from (select p_partkey, p_type, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(p_brand, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_+', '_', 'g'), '^_|_$', '', 'g') as base from part))")
def name_fix_plan(spark, folder):
    rows = names.name_plan(table(spark, folder, "part").select("p_partkey", "p_brand", "p_type"), ["p_type"], "p_partkey", ["p_brand"], "'unnamed'")
    return rows.select("p_partkey", F.col("after").alias("resolved"))


@query(OLD + "select table_name, 'CREATE TABLE `' || table_name || '` (' || chr(10) || string_agg('  `' || column_name || '` ' || upper(type), ',' || chr(10) order by position) || ',' || chr(10) || '  PRIMARY KEY (`' || max(case when is_pk then column_name end) || '`)' || chr(10) || ')' as ddl from old group by table_name")
def create_table_ddl(spark, folder):
    return schema_diff.ddl(old_and_new(spark, folder)[0])


@query(OLD + """select coalesce(o.table_name, n.table_name) as table_name, coalesce(o.column_name, n.column_name) as column_name, case when n.column_name is null then 2 else 1 end as step,
'ALTER TABLE `' || coalesce(o.table_name, n.table_name) || '` ' || case when n.column_name is null then 'DROP COLUMN `' || o.column_name || '`' when o.column_name is null then 'ADD COLUMN `' || n.column_name || '` ' || upper(n.type) else 'MODIFY COLUMN `' || n.column_name || '` ' || upper(n.type) end as statement
from old o full join new n on o.table_name = n.table_name and o.column_name = n.column_name where o.column_name is null or n.column_name is null or o.type <> n.type""")
def alter_plan(spark, folder):
    old, new = old_and_new(spark, folder)
    return schema_diff.alter_statements(schema_diff.column_diff(old, new), new)


@query(OLD + "select action, count(*) as n_columns from (select case when n.column_name is null then 'removed' when o.column_name is null then 'added' else 'changed' end as action from old o full join new n on o.table_name = n.table_name and o.column_name = n.column_name where o.column_name is null or n.column_name is null or o.type <> n.type) group by action")
def schema_diff_summary(spark, folder):
    return schema_diff.column_diff(*old_and_new(spark, folder)).groupBy("action").agg(F.count("*").alias("n_columns"))


@query(OLD + """, pairs as (select o.table_name as a, n.table_name as b, count(*) as n from old o join new n on o.column_name = n.column_name group by 1, 2),
x as (select table_name as a, count(distinct column_name) as n from old group by 1), y as (select table_name as b, count(distinct column_name) as n from new group by 1)
select x.a, y.b, cast(round(coalesce(p.n, 0) / cast(x.n + y.n - coalesce(p.n, 0) as double), 6) as double) as score from x cross join y left join pairs p on p.a = x.a and p.b = y.b""")
def jaccard_column_sets(spark, folder):
    """Of all pairs of an old and a new table."""
    x, y = (rows.groupBy(F.col("table_name").alias(k)).agg(F.collect_set("column_name").alias(f"{k}_names")) for rows, k in zip(old_and_new(spark, folder), "ab"))
    return x.crossJoin(y).select("a", "b", F.round(text.jaccard(F.col("a_names"), F.col("b_names")), 6).alias("score"))
