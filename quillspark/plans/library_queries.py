"""Queries of what a workbench remembers, over events and conversations as its runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import library
from quillspark.plans.registry import query, table, values_sql

C = F.col

RUNS_SQL = "(select event_id as id, ts, user_id, 'SELECT  * FROM ' || event_type || case when user_id % 2 = 0 then ' WHERE user_id = ' else ' where USER_ID = ' end || cast(user_id % 40 as varchar) as q, event_type, value from events)"


def runs(spark, folder) -> DataFrame:
    word = F.when(C("user_id") % 2 == 0, " WHERE user_id = ").otherwise(" where USER_ID = ")
    return table(spark, folder, "events").select(C("event_id").alias("id"), "ts", "user_id", F.concat(F.lit("SELECT  * FROM "), "event_type", word, (C("user_id") % 40).cast("string")).alias("q"), "event_type", "value")


@query(f"select arg_max(q, (ts, q)) as q, ts from (select q, ts, regexp_replace(lower(q), ' +', ' ', 'g') as k, max(ts) over (partition by regexp_replace(lower(q), ' +', ' ', 'g')) as last from {RUNS_SQL}) where ts = last group by k, ts order by ts desc, q limit 30")
def recent_statements(spark, folder):
    return library.recent(runs(spark, folder), "q", "ts")


@query(f"select id, ts from {RUNS_SQL} order by ts desc, id desc limit 40")
def run_history(spark, folder):
    return library.newest(runs(spark, folder), "ts", "id", library.HISTORY).select("id", "ts")


@query(f"""select coalesce(event_type, '') as schema, 'select' as kind, 'SELECT * FROM ' || event_type || case when user_id % 2 = 0 then ' WHERE user_id = ?' else ' where USER_ID = ?' end as pattern, count(*) as n, max(ts) as last_at, 'r.' || event_type as relation_keys, string_agg(distinct 'r.' || event_type || '.c' || user_id % 3, ',' order by 'r.' || event_type || '.c' || user_id % 3) as column_keys
from {RUNS_SQL} group by event_type, user_id % 2 order by n desc, last_at desc, pattern limit 80""")
def statement_memory(spark, folder):
    rows = runs(spark, folder).withColumn("relation", F.concat(F.lit("r."), "event_type"))
    rows = rows.select("q", "ts", C("event_type").alias("schema"), F.array("relation").alias("relation_keys"), F.array(F.concat("relation", F.lit(".c"), (C("user_id") % 3).cast("string"))).alias("column_keys"))
    return library.patterns(rows, "q", "ts").withColumn("relation_keys", F.array_join("relation_keys", ",")).withColumn("column_keys", F.array_join("column_keys", ","))


@query(f"select event_type as key, count(*) as n, max(ts) as last_at from (select lower(event_type) || '::c' || user_id % 70 || '::::::' as event_type, ts from {RUNS_SQL}) group by key order by n desc, last_at desc, key limit 120")
def accepted_suggestions(spark, folder):
    events = runs(spark, folder).select(F.upper("event_type").alias("kind"), F.concat(F.lit(" C"), (C("user_id") % 70).cast("string")).alias("label"), F.lit(None).cast("string").alias("schema"), F.lit("").alias("relation"), F.lit(" ").alias("column_name"), C("ts").alias("accepted_at"))
    return library.accepted(events).select("key", "n", "last_at")


KINDS_SQL = r"""case when v is null then 'null' when trim(v) = '' then 'empty-text' when regexp_matches(trim(v), '^[\[{](.|\n)*[\]}]$') then 'json-like' when length(trim(v)) > 48 then 'long-text' else 'text' end"""


@query(f"""with r as (select * from (select *, row_number() over (partition by event_type order by event_id) as i from events) where i <= 50),
k as (select 'value' as column_name, case when value is null then 'null' when value = floor(value) then 'integer' else 'number' end as k from r union all select 'props', {KINDS_SQL.replace(' v ', ' props ').replace('(v)', '(props)')} from r union all select 'user_id', case when user_id is null then 'null' else 'integer' end from r)
select column_name, count(*) as n_rows, sum(case when k = 'null' then 1 else 0 end) as n_null, string_agg(distinct k, ',' order by k) as kinds from k group by column_name""")
def batch_value_profiles(spark, folder):
    return library.value_profiles(table(spark, folder, "events"), ["value", "props", "user_id"], "event_type", "event_id")


@query("""select event_type as key, count(*) as n_rows, sum(case when value is null then 1 else 0 end) as n_null, string_agg(distinct case when value is null then 'null' when value < 0 then 'negative' else 'positive' end, ',' order by case when value is null then 'null' when value < 0 then 'negative' else 'positive' end) as kinds, max(ts) as last_at from events group by event_type order by n_rows desc, last_at desc, key limit 96""")
def merged_value_profiles(spark, folder):
    kind = F.when(C("value").isNull(), "null").when(C("value") < 0, "negative").otherwise("positive")
    each = table(spark, folder, "events").groupBy(C("event_type").alias("key"), "user_id").agg(F.count("*").alias("n_rows"), F.count_if(C("value").isNull()).alias("n_null"), F.collect_set(kind).alias("kinds"), F.max("ts").alias("at"))
    return library.merged_profiles(each).withColumn("kinds", F.array_join("kinds", ","))


MEMORY = [(1, "Sales", ["sales.a"], ["sales.a.x"]), (2, None, ["hr.b"], ["sales.c.y"]), (3, "hr", ["hr.b"], []), (4, " SALES ", [], []), (5, None, [], [])]


@query(f"select 'patterns' as what, id from {values_sql(MEMORY, 'id, s, r, c')} where id in (3, 5) union all select 'profiles', id from {values_sql(MEMORY, 'id, s, r, c')} where coalesce(lower(trim(s)), '') <> 'sales' union all select 'kept', id from {values_sql(MEMORY, 'id, s, r, c')}")
def cleared_memory(spark, folder):
    df = spark.createDataFrame(MEMORY, "id int, schema string, relation_keys array<string>, column_keys array<string>")
    parts = [("patterns", library.cleared(df, "queryPatterns", None, "Sales")), ("profiles", library.cleared(df, "valueProfiles", ["valueProfiles"], "sales")), ("kept", library.cleared(df, "acceptedSuggestions", ["queryPatterns"])), ("none", library.cleared(df, "queryPatterns"))]
    out = [x.select(F.lit(k).alias("what"), "id") for k, x in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


ITEMS = [(1, "0100:a", 100, 5, 8, 6, 7, 100), (2, "0095:b", 95, 0, 0, 0, None, None), (3, "0010:c", 10, 1, 0, 0, None, 3), (4, "0010:d", 10, 1, 0, 0, None, 3), (5, "0000:e", 0, 0, 0, 0, 0, None), (6, "0076:f", 76, None, None, None, None, None)]


@query(f"""with s as (select id, sort_text, bucket, least(18, coalesce(a, 0) * 4) + least(14, coalesce(r, 0) * 2) + least(16, coalesce(c, 0) * 3) + least(10, coalesce(s, 0) * 2) + case when p is null then 0 else least(10, 2 + p // 8) end as score from {values_sql(ITEMS, 'id, sort_text, bucket, a, r, c, s, p')})
select id, score, row_number() over (order by greatest(0, bucket - least(24, score)), score desc, sort_text) as rank from s""")
def ranked_suggestions(spark, folder):
    df = spark.createDataFrame(ITEMS, "id int, sort_text string, bucket int, accepted int, relation int, column int, schema_uses int, sampled int")
    return library.ranked(df, "where").select("id", "score", "rank")


TURNS_SQL = "(select conv_id * 1000 + turn as id, role as mode, text as sql, case when turn % 5 = 0 then 'failed' else 'success' end as status, case when turn % 5 = 0 then 'boom ' || conv_id end as error_message, conv_id, turn from conversations)"


@query(f"""with l as (select 'history' as kind, id, case when mode = 'script' then 'Script run' else 'Statement run' end as title, lower(trim(coalesce(sql, '') || chr(10) || status || chr(10) || mode || chr(10) || coalesce(error_message, ''))) as s from {TURNS_SQL}
union all select 'snippet', conv_id, 'S' || conv_id, lower(trim('S' || conv_id || chr(10) || coalesce(sql, ''))) from {TURNS_SQL} where turn = 0) select kind, id, title from l where contains(s, 'boom 1') or contains(s, 's1')""")
def library_search(spark, folder):
    turns = table(spark, folder, "conversations")
    failed = C("turn") % 5 == 0
    history = turns.select((C("conv_id") * 1000 + C("turn")).alias("id"), C("role").alias("mode"), C("text").alias("sql"), F.when(failed, "failed").otherwise("success").alias("status"), F.when(failed, F.concat(F.lit("boom "), C("conv_id").cast("string"))).alias("error_message"), F.lit(None).cast("timestamp").alias("executed_at"))
    snippets = turns.where("turn = 0").select(C("conv_id").alias("id"), F.concat(F.lit("S"), C("conv_id").cast("string")).alias("name"), C("text").alias("sql"), F.lit(None).cast("timestamp").alias("updated_at"))
    recents = turns.select(C("turn").alias("id"), C("text").alias("sql"))
    listed = library.entries(snippets, history, recents)
    return library.found(listed, " BOOM 1 ").unionByName(library.found(listed, "s1\n")).select("kind", "id", "title").distinct()


@query("select 'recent' as kind, turn as id, 'Recent query ' || (turn + 1) as title from conversations where conv_id = (select min(conv_id) from conversations)")
def library_without_history(spark, folder):
    turns = table(spark, folder, "conversations")
    first = turns.join(F.broadcast(turns.agg(F.min("conv_id").alias("conv_id"))), "conv_id")
    empty = turns.where("false")
    snippets = empty.select(C("conv_id").alias("id"), C("role").alias("name"), C("text").alias("sql"), F.lit(None).cast("timestamp").alias("updated_at"))
    history = empty.select(C("conv_id").alias("id"), C("role").alias("mode"), C("text").alias("sql"), C("role").alias("status"), C("role").alias("error_message"), F.lit(None).cast("timestamp").alias("executed_at"))
    return library.entries(snippets, history, first.select(C("turn").alias("id"), C("text").alias("sql"))).select("kind", "id", "title")


SNIPPETS = [(1, " Top ", "select 1", "2024-01-01"), (2, "top", " select 2 ", "2024-02-01"), (3, "", "select 3", "2024-03-01"), (4, "Other", " ", "2024-01-05"), (5, "Third", "select 5", "2024-01-09")]


@query(f"select trim(arg_max(name, up)) as name, trim(arg_max(q, up)) as sql, max(up) as updated_at from {values_sql(SNIPPETS, 'id, name, q, up')} where trim(name) <> '' and trim(q) <> '' group by lower(trim(name))")
def saved_snippets(spark, folder):
    return library.saved(spark.createDataFrame(SNIPPETS, "id int, name string, sql string, updated_at string"))


@query("""select conv_id, count(*) as n_statements, case when sum(case when turn % 3 = 1 then 1 else 0 end) = 0 then 'success' when sum(case when turn % 3 = 1 then 0 else 1 end) = 0 then 'failed' else 'partial' end as status, sum(length(text)) as returned, sum(turn) as affected, cast(0 as bigint) as elapsed_ms, min(case when turn % 3 = 1 then turn end) as first_failed, min(case when turn % 3 = 1 then 'e' || turn end) filter (where turn = 1) as error_message from conversations group by conv_id""")
def run_statuses(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.when(C("turn") % 3 == 1, F.concat(F.lit("e"), C("turn").cast("string"))).alias("error"), F.length("text").cast("long").alias("returned"), C("turn").alias("affected"), F.lit(None).cast("long").alias("elapsed_ms"))
    return library.run_status(rows, "conv_id", "turn")


REFS = [
    (1, "s1", "Orders", "orders", "State", "state", "see codes", "see codes [A]", [("codes", "A", "[A]", "1:open 2:done")]),
    (2, "s1", "Orders", "orders", "Kind", "kind", None, "", [("Codes", "AB", "[AB]", ""), ("other", "A", "x", "")]),
    (3, "s2", "Stores", "stores", "Note", "note", "free text about orders", None, []),
    (4, "s2", "Stores", "stores", "Id", "id", None, None, []),
]
REF_SCHEMA = "id int, sheet string, table_logical string, table_physical string, logical string, physical string, comment string, comment_raw string, refs array<struct<source: string, code: string, raw: string, options: string>>"
REF_SQL = values_sql([(*r[:8], len(r[8])) for r in REFS], "id, sheet, tl, tp, l, p, c, cr, n")


@query("""select unnest(['bare', 'bare', 'bare', 'query', 'query', 'query', 'source', 'source', 'code', 'code', 'prefix', 'refs', 'refs']) as search, unnest([1, 2, 3, 1, 2, 3, 1, 2, 1, 2, 2, 1, 2]) as id, unnest([1, 2, 0, 0, 0, 0, 1, 1, 1, 2, 1, 1, 2]) as n""")
def comment_reference_search(spark, folder):
    df = library.comment_rows(spark.createDataFrame(REFS, REF_SCHEMA))
    searches = {"bare": {}, "query": {"query": "ORDERS"}, "source": {"source": "codes"}, "code": {"code": "a"}, "prefix": {"code": "ab", "code_mode": "starts_with"}, "refs": {"bare": False}}
    out = [library.comment_references(df, **how).select(F.lit(k).alias("search"), "id", F.size("matched").alias("n")) for k, how in searches.items()]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


@query("select doc_id, (select count(*) from documents where contains(lower(coalesce(text, '')), 'an')) as matched_rows, (select count(*) from documents where contains(lower(coalesce(text, '')), 'an')) > 130 as truncated from documents where contains(lower(coalesce(text, '')), 'an') order by doc_id limit 100 offset 30")
def reference_pages(spark, folder):
    hits = table(spark, folder, "documents").where(F.lower(F.coalesce("text", F.lit(""))).contains("an"))
    page, total = library.reference_page(hits, ["doc_id"], 100, 30)
    return page.crossJoin(F.broadcast(total)).select("doc_id", "matched_rows", "truncated")


CATALOG = [("orders", "all orders", "id", "bigint", None), ("orders", "all orders", "note", "text", "free"), ("stores", None, "order_no", "int", None), ("stores", None, "name", "varchar", "of the ORDER"), ("stores", None, "city", "varchar", None)]


@query(f"select t as table_name, c as column_name, contains(lower(t || ' ' || coalesce(tc, '')), 'order') as by_table from {values_sql(CATALOG, 't, tc, c, k, m')} where contains(lower(t || ' ' || coalesce(tc, '')), 'order') or contains(lower(c || ' ' || k || ' ' || coalesce(m, '')), 'order')")
def catalog_filter(spark, folder):
    df = spark.createDataFrame(CATALOG, "table_name string, table_comment string, column_name string, type string, comment string")
    return library.catalog_matches(df, " Order ").select("table_name", "column_name", "by_table")


CONNECTIONS = [(1, "beta", "mysql", "h1", "db1", "u", " Team A ", "prod", None, True), (2, "alpha", "mysql", "h2", "db2", "u", "Team A", "dev", None, False), (3, "", "postgres", "h3", "zeta", "u", "", "prod", "public", None), (4, "delta", "postgres", "h1", "db4", "u", None, "dev", None, True), (5, "aaa", "mysql", "h9", "db5", "u", "Team B", "prod", None, False)]
CONNECTION_SQL = values_sql(CONNECTIONS, "id, name, driver, host, database, username, g, environment, ds, fav")


@query(f"""with c as (select *, coalesce(nullif(trim(g), ''), 'Ungrouped') as group_name, coalesce(nullif(trim(g), ''), '') = '' as ungrouped from {CONNECTION_SQL}) select 'all' as filter, id, group_name, ungrouped, row_number() over (partition by group_name order by coalesce(fav, false) desc, coalesce(nullif(name, ''), database)) as place from c
union all select 'prod', id, group_name, ungrouped, row_number() over (partition by group_name order by coalesce(fav, false) desc, coalesce(nullif(name, ''), database)) from c where environment = 'prod' union all select 'h1', id, group_name, ungrouped, 1 from c where host = 'h1' and fav""")
def connection_list(spark, folder):
    df = spark.createDataFrame(CONNECTIONS, "id int, name string, driver string, host string, database string, username string, group_name string, environment string, default_schema string, favorite boolean")
    searches = {"all": {}, "prod": {"environment": "prod"}, "h1": {"search": "H1", "favorites": True}}
    out = [library.connections(df, **how).select(F.lit(k).alias("filter"), "id", "group_name", "ungrouped", "place") for k, how in searches.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
