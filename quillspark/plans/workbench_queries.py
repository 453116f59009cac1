"""Queries of catalog scans, explain trees and streaming state."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import paging, schema_diff
from quillspark.plans import sqltext
from quillspark.plans.registry import query, table, views
from quillspark.sources import files, workbook
from quillspark.streaming import windows


@query()
def explain_nodes(spark, folder):
    views(spark, folder, "orders", "customer")
    return sqltext.explain_nodes(spark.sql("select c_name, count(*) as n from customer join orders on c_custkey = o_custkey where o_totalprice > 1000 group by c_name"))


@query("select event_type, date_trunc('hour', ts) as hour_start, count(*) as n from events group by event_type, hour_start")
def hourly_events(spark, folder):
    return windows.tumbling(table(spark, folder, "events"), "ts", "1 hour", ["event_type"]).withColumnRenamed("window_start", "hour_start")


@query("select user_id, session_no, min(ts) as session_start, count(*) as n from (select user_id, ts, sum(case when gap then 1 else 0 end) over (partition by user_id order by ts, event_id) as session_no from (select user_id, ts, event_id, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) > interval '30 minutes', true) as gap from events)) group by user_id, session_no")
def user_sessions(spark, folder):
    return windows.sessions(table(spark, folder, "events"), "user_id", "ts", "event_id", 1800)


@query("select event_id, user_id, event_type from events where event_type is not null and event_id % 3 = 0 and user_id > 2")
def filtered_scan(spark, folder):
    return files.scan(table(spark, folder, "events"), "event_type is not null and event_id % 3 = 0 and user_id > 2").select("event_id", "user_id", "event_type")


@query("select r_regionkey, r_name from region")
def csv_round_trip(spark, folder):
    """Written as CSV with CRLF line ends to the shared folder and read again."""
    return files.csv_round_trip(table(spark, folder, "region"))


@query("select conv_id, turn, role from conversations where turn >= 1 and role = 'user'")
def conversation_rows(spark, folder):
    return table(spark, folder, "conversations").where("turn >= 1 and role = 'user'").select("conv_id", "turn", "role")


@query("""select table_name, cast(ordinal_position as int) as position, column_name as physical_name, case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' else 'timestamp_ntz' end as type,
column_name in ('n_nationkey', 'r_regionkey', 'o_orderkey') as is_pk from information_schema.columns where table_name in ('nation', 'region', 'orders')""")
def workbook_definitions(spark, folder):
    """Table definitions written as a workbook to the shared folder and parsed from it again."""
    keys = {"nation": ["n_nationkey"], "region": ["r_regionkey"], "orders": ["o_orderkey"]}
    catalog = schema_diff.catalog_columns(spark, {t: table(spark, folder, t) for t in keys}, keys)
    rows = [{"table_name": r["table_name"], "physical_name": r["column_name"], "type": r["type"], "is_pk": r["is_pk"]} for r in catalog.orderBy("table_name", "position").collect()]
    path = files.write_bytes(spark, "catalog.xlsx", workbook.write_workbook(workbook.definition_sheets(rows)))
    return workbook.table_definitions(workbook.read_grid(spark, path)).select("table_name", "position", "physical_name", "type", "is_pk")


@query("select o_orderstatus, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3")
def newest_jobs_by_state(spark, folder):
    by = W.partitionBy("o_orderstatus").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, folder, "orders").withColumn("r", F.row_number().over(by)).where("r <= 3").select("o_orderstatus", "o_orderkey", "o_totalprice")


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 25")
def newest_jobs(spark, folder):
    return paging.newest_jobs(table(spark, folder, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("select event_type, sum(n) as n, max(last_seen) as last_seen, string_agg(distinct kinds, ',' order by kinds) as kinds from (select event_type, user_id, count(*) as n, max(ts) as last_seen, case when value is null then 'null' when value < 0 then 'negative' else 'positive' end as kinds from events group by event_type, user_id, kinds) group by event_type")
def profile_merge(spark, folder):
    """Profiles of single runs merged: sums of counts, unions of kinds, the last time seen."""
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value") < 0, "negative").otherwise("positive")
    runs = table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"), F.collect_set(kind).alias("kinds"))
    each = runs.select("event_type", F.explode("kinds").alias("kind")).distinct().groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"))
    return runs.groupBy("event_type").agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen")).join(each, "event_type")


@query("select p_partkey, upper(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g')) as enum_name, regexp_replace(lower(trim(p_type)), '\\s+', ' ', 'g') as token, regexp_matches(p_name, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') as valid from part")
def enum_names(spark, folder):
    return table(spark, folder, "part").select("p_partkey", text.constant_name(F.col("p_type")).alias("enum_name"), text.token_normalize(F.col("p_type")).alias("token"), text.is_valid_name(F.col("p_name")).alias("valid"))


@query("select c_mktsegment, count(*) as n_rows, sum(case when c_acctbal < 0 then 1 else 0 end) as n_error, sum(case when c_acctbal >= 0 and c_acctbal < 100 then 1 else 0 end) as n_warning from customer group by c_mktsegment")
def issue_counts(spark, folder):
    b = F.col("c_acctbal")
    return table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n_rows"), F.count_if(b < 0).alias("n_error"), F.count_if((b >= 0) & (b < 100)).alias("n_warning"))


@query("select c_mktsegment as group_name, count(*) as n_members, min(c_custkey) as first_member, string_agg(distinct cast(c_nationkey as varchar), ',' order by cast(c_nationkey as varchar)) as nations from customer group by c_mktsegment")
def connection_groups(spark, folder):
    rows = table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("group_name"))
    return rows.agg(F.count("*").alias("n_members"), F.min("c_custkey").alias("first_member"), F.array_join(F.array_sort(F.collect_set(F.col("c_nationkey").cast("string"))), ",").alias("nations"))


@query("select doc_id, array_to_string(list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) as meaning from documents")
def comment_meanings(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.comment_meaning(F.col("text")).alias("meaning"))
