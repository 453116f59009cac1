"""Queries of row comparison and of applying its result, on two versions of orders.

The source version lacks urgent orders; the target version lacks finished ones and has the status of expensive orders changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import apply, diff
from quillspark.plans.registry import query, table, values_sql

KEYS, COMPARE = ["o_orderkey"], ["o_orderstatus", "o_orderpriority"]

VERSIONS = """with src as (select * from orders where o_orderpriority <> '1-URGENT'),
tgt as (select o_orderkey, o_custkey, case when o_totalprice > 200000 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        from orders where o_orderstatus <> 'F'),
cmp as (select coalesce(s.o_orderkey, t.o_orderkey) as o_orderkey,
        case when t.o_orderkey is null then 'source_only' when s.o_orderkey is null then 'target_only'
             when s.o_orderstatus is distinct from t.o_orderstatus or s.o_orderpriority is distinct from t.o_orderpriority then 'value_changed' else 'unchanged' end as status,
        s.o_custkey as s_custkey, t.o_custkey as t_custkey, s.o_orderstatus as s_status, t.o_orderstatus as t_status, s.o_orderpriority as s_priority, t.o_orderpriority as t_priority
        from src s full join tgt t on s.o_orderkey is not distinct from t.o_orderkey)
"""


def versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders")
    source = orders.where("o_orderpriority <> '1-URGENT'")
    target = orders.where("o_orderstatus <> 'F'").withColumn("o_orderstatus", F.expr("case when o_totalprice > 200000 then 'X' else o_orderstatus end"))
    return source, target


def compared(spark: SparkSession, folder: str) -> DataFrame:
    return diff.classify(*versions(spark, folder), KEYS, COMPARE)


@query(VERSIONS + "select status, count(*) as n_rows from cmp group by status")
def diff_status_counts(spark, folder):
    return diff.status_counts(diff.statuses(*versions(spark, folder), KEYS, COMPARE))


@query(VERSIONS + """select o_orderkey, 'o_orderstatus' as column_name, s_status as source_value, t_status as target_value, s_status is distinct from t_status as changed from cmp where status in ('value_changed', 'unchanged')
union all select o_orderkey, 'o_orderpriority', s_priority, t_priority, s_priority is distinct from t_priority from cmp where status in ('value_changed', 'unchanged')""")
def diff_field_deltas(spark, folder):
    return diff.field_deltas(compared(spark, folder), KEYS, COMPARE)


@query(VERSIONS + """select '{"o_orderkey":' || cast(o_orderkey as varchar) || '}' as row_key, status, case status when 'source_only' then 'insert' when 'target_only' then 'delete' else 'update' end as action
from cmp where status <> 'unchanged' order by row_key limit 101 offset 100""")
def diff_detail_page(spark, folder):
    return diff.detail_page(compared(spark, folder), KEYS, 100, 100).select("row_key", "status", "action")


@query(VERSIONS + "select o_orderkey, status from cmp where status <> 'unchanged' order by o_orderkey limit 20")
def diff_sample_rows(spark, folder):
    return diff.sample_rows(compared(spark, folder), KEYS, 20).select("o_orderkey", "status")


@query(VERSIONS + "select coalesce(status, 'all') as status, count(*) as n_rows from cmp group by rollup(status)")
def diff_totals(spark, folder):
    return diff.statuses(*versions(spark, folder), KEYS, COMPARE).rollup("status").agg(F.count("*").alias("n_rows")).withColumn("status", F.coalesce("status", F.lit("all")))


@query(VERSIONS + "select column_name, sum(case when changed then 1 else 0 end) as n_changed from (select 'o_orderstatus' as column_name, s_status is distinct from t_status as changed from cmp where status = 'value_changed' union all select 'o_orderpriority', s_priority is distinct from t_priority from cmp where status = 'value_changed') group by column_name")
def diff_changed_columns(spark, folder):
    rows = diff.field_deltas(compared(spark, folder).where("status = 'value_changed'"), KEYS, COMPARE)
    return rows.groupBy("column_name").agg(F.sum(F.col("changed").cast("long")).alias("n_changed"))


HASHED = [("a", None, 1), ("null", "x|b=y", None), (None, "null", 2), ('quote"', "é", 3)]
JSON_SQL = """'{"a":' || coalesce('"' || replace(a, '"', chr(92) || '"') || '"', 'null') || ',"b":' || coalesce('"' || replace(b, '"', chr(92) || '"') || '"', 'null') || ',"n":' || coalesce(cast(n as varchar), 'null') || '}'"""


@query(f"""select n, sha256({JSON_SQL}) as h from (select * from {values_sql(HASHED, 'b, a, n')} union all select p_name, p_brand || '"', p_partkey + 1000 from part)""")
def snapshot_row_hashes(spark, folder):
    parts = table(spark, folder, "part").select(F.col("p_name").alias("b"), F.concat("p_brand", F.lit('"')).alias("a"), (F.col("p_partkey") + 1000).cast("int").alias("n"))
    rows = spark.createDataFrame(HASHED, "b string, a string, n int").unionByName(parts)
    return rows.select("n", diff.row_hash(rows).alias("h"))


PART = "cast(sum(cast(('0x' || substr(h, {0}, 8)) as bigint)) as varchar)"


@query(f"""select count(*) as n_rows, concat_ws('-', {', '.join(PART.format(8 * i + 1) for i in range(8))}) as hash from (select sha256('{{"c_acctbal":' || case when abs(c_acctbal) < 1e7 then cast(c_acctbal as varchar) end || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}}') as h from customer)""")
def snapshot_hash(spark, folder):
    return diff.snapshot_hash(table(spark, folder, "customer"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) as r from lineitem) where r = 1""")
def dedupe_keep_last(spark, folder):
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    return diff.keep_last(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], order, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query(VERSIONS + """select o_orderkey, case when status = 'source_only' then s_custkey else t_custkey end as o_custkey, case when status in ('source_only', 'value_changed') then s_status else t_status end as o_orderstatus,
case when status = 'source_only' or (status = 'value_changed' and s_priority is distinct from t_priority) then s_priority else t_priority end as o_orderpriority from cmp where status <> 'target_only'""")
def apply_result_table(spark, folder):
    source, target = versions(spark, folder)
    out = apply.apply_changes(target, diff.classify(source, target, KEYS, COMPARE), KEYS, COMPARE)
    return out.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query(VERSIONS + "select 'orders' as table_name, case status when 'source_only' then 'insert' when 'target_only' then 'delete' else 'update' end as action, count(*) as attempted_rows from cmp where status <> 'unchanged' group by status")
def apply_action_counts(spark, folder):
    return apply.action_counts(compared(spark, folder), "orders")


@query(VERSIONS + "select c_custkey from customer where c_custkey not in (select s_custkey from cmp where status = 'value_changed')")
def anti_join_missing(spark, folder):
    selected = table(spark, folder, "customer").select("c_custkey")
    known = compared(spark, folder).where("status = 'value_changed'").select(F.col("source_row.o_custkey").alias("c_custkey"))
    return apply.missing_selections(selected, known, ["c_custkey"])


@query("select u.o_orderkey from orders u where o_totalprice > 200000 and exists (select 1 from orders d where d.o_orderkey = u.o_orderkey and d.o_orderstatus = 'F')")
def mutation_conflicts(spark, folder):
    orders = table(spark, folder, "orders")
    return apply.conflicts(orders.where("o_totalprice > 200000"), orders.where("o_orderstatus = 'F'"), KEYS)


@query("select o_orderkey, case when o_totalprice > 200000 and o_orderstatus <> 'P' then 'X' else o_orderstatus end as o_orderstatus, o_custkey from orders")
def grid_overlay(spark, folder):
    loaded = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    edits = table(spark, folder, "orders").where("o_totalprice > 200000").select("o_orderkey", F.expr("case when o_orderstatus <> 'P' then 'X' end").alias("o_orderstatus"))
    return apply.overlay(loaded, edits, KEYS)


@query("""with cells as (select o_orderkey as row_key, 'o_orderstatus' as column_name, o_orderstatus as before_value, case when o_totalprice > 200000 then 'X' else o_orderstatus end as next_value from orders
union all select o_orderkey, 'o_orderpriority', o_orderpriority, case when o_totalprice < 50000 then '5-LOW' else o_orderpriority end from orders
union all select o_orderkey, 'o_custkey', cast(o_custkey as varchar), cast(o_custkey + (case when o_totalprice > 250000 then 1 else 0 end) as varchar) from orders)
select row_key, count(*) as change_count, string_agg(column_name, ',' order by column_name) as columns from cells where before_value is distinct from next_value group by row_key""")
def pending_edit_groups(spark, folder):
    cells = table(spark, folder, "orders").selectExpr(
        """inline(array(
        struct(o_orderkey as row_key, 'o_orderstatus' as column_name, o_orderstatus as before_value, case when o_totalprice > 200000 then 'X' else o_orderstatus end as next_value),
        struct(o_orderkey as row_key, 'o_orderpriority' as column_name, o_orderpriority as before_value, case when o_totalprice < 50000 then '5-LOW' else o_orderpriority end as next_value),
        struct(o_orderkey as row_key, 'o_custkey' as column_name, cast(o_custkey as string) as before_value, cast(o_custkey + (case when o_totalprice > 250000 then 1 else 0 end) as string) as next_value)))"""
    )
    return apply.group_edits(cells)


@query("select coalesce(s.o_orderstatus, t.o_orderstatus) as name, s.o_orderstatus is not null as in_source, t.o_orderstatus is not null as in_target from (select distinct o_orderstatus from orders where o_orderpriority <> '1-URGENT') s full join (select distinct case when o_totalprice > 200000 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderstatus <> 'F') t on s.o_orderstatus = t.o_orderstatus")
def name_index(spark, folder):
    source, target = (df.select(F.col("o_orderstatus").alias(f"{side}_name")).distinct() for side, df in zip("st", versions(spark, folder)))
    return source.join(target, F.col("s_name") == F.col("t_name"), "full_outer").select(F.coalesce("s_name", "t_name").alias("name"), F.col("s_name").isNotNull().alias("in_source"), F.col("t_name").isNotNull().alias("in_target"))
