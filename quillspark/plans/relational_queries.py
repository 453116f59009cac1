"""The relational surface that users reach by SQL text: joins, grouping, windows, set operations and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import asof
from quillspark.plans.registry import delegated, query, table

delegated("join_inner", "orders customer nation", "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
delegated("join_left", "customer orders", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P'")
delegated("join_right", "customer orders", "select c_custkey, o_orderkey from customer right join orders on c_custkey = o_custkey and c_acctbal > 0")
delegated("join_full", "supplier customer", "select s_suppkey, c_custkey from supplier full join customer on s_suppkey = c_custkey and s_nationkey = c_nationkey")
delegated("join_semi", "customer orders", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
delegated("join_anti", "customer orders", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
delegated("join_theta", "nation region", "select n_nationkey, r_regionkey from nation join region on n_regionkey = r_regionkey and n_nationkey > r_regionkey * 4")
delegated("join_in_subquery", "part lineitem", "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 49)")
delegated("group_having", "lineitem", "select l_returnflag, l_linestatus, count(*) as n, sum(cast(l_quantity as bigint)) as q, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship from lineitem group by l_returnflag, l_linestatus having count(*) > 10")
delegated("group_filter", "orders", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_f, count(distinct o_custkey) as n_customers from orders group by o_orderpriority")
delegated("grouping_sets", "orders", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
delegated("rollup_cube", "customer", "select c_mktsegment, c_nationkey, count(*) as n from customer group by cube (c_mktsegment, c_nationkey)")
delegated("window_ranking", "customer", "select c_custkey, rank() over (partition by c_nationkey order by c_acctbal desc) as r, dense_rank() over (partition by c_nationkey order by c_mktsegment) as d, ntile(4) over (partition by c_nationkey order by c_acctbal, c_custkey) as t from customer")
delegated("window_frames", "orders", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as n, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before_key, first_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as first_key from orders")
delegated("set_union", "customer supplier", "select c_nationkey as k from customer union select s_nationkey from supplier")
delegated("set_union_all", "customer supplier", "select c_nationkey as k from customer union all select s_nationkey from supplier")
delegated("set_intersect", "customer supplier", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
delegated("set_except", "customer orders", "select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'P'")
delegated("cte_query", "orders", "with big as (select o_custkey, count(*) as n from orders group by o_custkey), top as (select * from big where n >= 10) select o_custkey, n from top")
delegated("scalar_subquery", "customer orders", "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n from customer")
delegated("case_coalesce", "orders", "select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'part' end as s, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') as p, o_custkey between 10 and 20 as b from orders")
delegated("like_filter", "part", "select p_partkey from part where p_type like '%BRASS%' or p_name like 'p%1' or p_brand in ('Brand#11', 'Brand#12')")
delegated("string_functions", "customer", "select c_custkey, upper(c_name) as u, lower(c_mktsegment) as l, length(c_name) as n, trim(c_name) as t, substr(c_name, 2, 4) as s, replace(c_name, '#', '-') as r, concat(c_name, c_mktsegment) as c from customer")
delegated("date_functions", "orders", "select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as m, year(o_orderdate) as y, month(o_orderdate) as mm from orders")
delegated("string_aggregate", "nation", "select n_regionkey, listagg(n_name, ',') within group (order by n_name) as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey")
delegated("count_starter", "lineitem", "select count(*) as n from lineitem")
delegated("distinct_rows", "customer", "select distinct c_mktsegment, c_nationkey from customer")
delegated("order_limit", "orders", "select o_orderkey, o_custkey from orders order by o_orderdate desc, o_orderkey limit 50")


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_custkey >= 100")
def param_query(spark, folder):
    """Named parameters are bound by Spark, never pasted into the text."""
    table(spark, folder, "orders").createOrReplaceTempView("orders")
    return spark.sql("select o_orderkey from orders where o_orderstatus = :status and o_custkey >= :least", args={"status": "F", "least": 100})


@query("select e.event_id, o.o_orderkey from (select event_id, ts, user_id from events) e left join (select event_id as eid, o_orderkey, row_number() over (partition by event_id order by o_orderdate desc, o_orderkey desc) as r from events join orders on o_custkey = user_id and o_orderdate <= ts) o on o.eid = e.event_id and o.r = 1")
def asof_join(spark, folder):
    """For each event the latest order of that customer up to its time."""
    events, orders = table(spark, folder, "events"), table(spark, folder, "orders")
    return asof.asof(events, orders, ("user_id", "ts"), ("o_custkey", "o_orderdate"), ["o_orderkey"]).select("event_id", "o_orderkey")


@query("select p_partkey, n from (select l_partkey as p_partkey, count(*) as n from lineitem where l_quantity between 10 and 20 group by l_partkey) order by n desc, p_partkey limit 10")
def top_k(spark, folder):
    rows = table(spark, folder, "lineitem").where("l_quantity between 10 and 20").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.col("n").desc(), "p_partkey").limit(10)
