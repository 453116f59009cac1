"""Queries of deep pages, of stored records and of searches in folded names."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.range_index import RangeIndex
from quillspark.plans.registry import query, table
from quillspark.shared import fresh_dir
from quillspark.sources.records import RecordLog

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (order by {', '.join(LINE_ORDER)}) as i, count(*) over () as n from lineitem) where i > n * 5 // 6 and i <= n * 5 // 6 + 101")
def deep_page(spark, folder):
    """A page from five sixths of the way on; only the ranges that it lies in are read."""
    index = RangeIndex(table(spark, folder, "lineitem"), LINE_ORDER, ranges=16)
    return index.page(100, index.n_rows * 5 // 6).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"select p, min(l_orderkey) as first_order, count(*) as n from (select l_orderkey, (row_number() over (order by {', '.join(LINE_ORDER)}) - 1) // (select count(*) // 7 + 1 from lineitem) as p from lineitem) group by p")
def all_pages(spark, folder):
    """Seven pages, each from the index, are the whole table."""
    index = RangeIndex(table(spark, folder, "lineitem"), LINE_ORDER, ranges=5)
    size, out = index.n_rows // 7 + 1, None
    for p in range(7):
        page = index.page(size - 1, p * size).agg(F.lit(p).cast("long").alias("p"), F.min("l_orderkey").alias("first_order"), F.count("*").alias("n"))
        out = page if out is None else out.unionByName(page)
    return out


UPSERTS = """(select o_orderkey as id, o_orderdate as happened, 'started' as payload, false as deleted, 1 as seq from orders union all select o_orderkey, o_orderdate + interval '1 day', o_orderpriority, false, 2 from orders where o_orderstatus <> 'O'
union all select o_orderkey, o_orderdate - interval '1 day', 'late', false, 3 from orders where o_orderkey % 3 = 0 union all select o_orderkey, o_orderdate + interval '2 days', null, true, 4 from orders where o_orderstatus = 'F' and o_orderkey % 5 = 0)"""
LATEST = f"select id, payload from (select *, row_number() over (partition by id order by happened desc, seq desc) as r from {UPSERTS}) where r = 1 and not deleted"


@query(f"select 'before' as reading, cast(id as varchar) as id, payload from ({LATEST}) union all select 'after', cast(id as varchar), payload from ({LATEST})")
def record_log(spark, folder):
    """States of jobs, some late and some deleted, replayed from orders in four appends, and read before and after compaction."""
    log, orders = RecordLog(spark, fresh_dir(spark, "records")), table(spark, folder, "orders")
    date = F.col("o_orderdate").cast("timestamp")
    state = lambda df, days, payload, deleted=False: df.select(F.lit("job").alias("kind"), F.col("o_orderkey").alias("id"), (date + F.make_dt_interval(days=F.lit(days))).alias("at"), payload.cast("string").alias("payload"), F.lit(deleted).alias("deleted"))
    log.append(state(orders, 0, F.lit("started")))
    log.append(state(orders.where("o_orderstatus != 'O'"), 1, F.col("o_orderpriority")))
    log.append(state(orders.where("o_orderkey % 3 = 0"), -1, F.lit("late")))
    log.append(state(orders.where("o_orderstatus = 'F' and o_orderkey % 5 = 0"), 2, F.lit(None), True))
    before = log.read("job").select(F.lit("before").alias("reading"), "id", "payload")
    log.compact()
    return before.unionByName(log.read("job").select(F.lit("after").alias("reading"), "id", "payload"))



@query("select p_partkey, p_partkey % 2 = 0 as wide, contains(replace(p_name, ' ', ''), 'ring') as found from part")
def folded_names(spark, folder):
    """Names in full-width letters are found like others."""
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")
    name = F.when(F.col("p_partkey") % 2 == 0, wide).otherwise(F.col("p_name"))
    return table(spark, folder, "part").select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("wide"), text.search_key(text.nfkc(name)).contains("ring").alias("found"))
