"""Queries of edits, plans and results of applying them, on orders and the comparison of its versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import grid, statements
from quillspark.plans.diff_queries import COMPARE, KEYS, VERSIONS, compared
from quillspark.plans.registry import query, table, values_sql

C = F.col


@query("select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by all having count(*) > 1")
def duplicate_key_tuples(spark, folder):
    return grid.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


CASES = [("none", "unsupported_source"), ("readonly", "readonly_connection"), ("count", "count_result"), ("error", "result_error"), ("no table", "unsupported_source"), ("unknown", "table_not_found"), ("no key", "missing_primary_key"), ("missing", "missing_primary_key_column,missing_primary_key_column"), ("twice", "duplicate_primary_key_tuple"), ("fine", "")]


@query(f"select name, codes from {values_sql(CASES, 'name, codes')}")
def edit_eligibility(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    check = grid.eligibility
    found = {
        "none": check(orders, None, None, None), "readonly": check(orders, "table", "orders", KEYS, readonly=True), "count": check(orders, "count", "orders", KEYS), "error": check(orders, "table", "orders", KEYS, error="x"), "no table": check(orders, "table", " ", KEYS),
        "unknown": check(orders, "table", "orders", None), "no key": check(orders, "table", "orders", []), "missing": check(orders, "table", "orders", ["a", "b"]), "twice": check(lines, "table", "lineitem", ["l_orderkey", "l_linenumber"]), "fine": check(orders, "table", "orders", KEYS),
    }
    return spark.createDataFrame([(k, ",".join(v)) for k, v in found.items()], "name string, codes string")


@query("select r_regionkey, '`r_regionkey`,`label`' as names, 'region' as source, 'INSERT INTO `region` (`r_regionkey`, `r_name`) VALUES' || chr(10) || '  (' || r_regionkey || ', ''' || r_name || ''');' as statement from region")
def lineage_insert(spark, folder):
    rows = table(spark, folder, "region").withColumnRenamed("r_name", "label").withColumn("place", (C("r_regionkey") + 1).cast("int"))
    placed = statements.with_lineage(rows, "region", ["r_regionkey"], renamed={"label": "r_name"})
    made = statements.insert_script(placed, "place", size=1).withColumn("r_regionkey", C("batch").cast("int"))
    names = ",".join(statements.quoted(f.name) for f in placed.schema if f.name != "place")
    return made.select("r_regionkey", F.lit(names).alias("names"), F.lit(statements.lineage_table(placed)).alias("source"), "statement")


@query("select cast(floor((n_nationkey) / 10) as bigint) as batch, 'INSERT INTO \"exported_rows\" (\"n_nationkey\", \"n_name\", \"n_regionkey\") VALUES' || chr(10) || '  ' || string_agg('(' || n_nationkey || ', ''' || n_name || ''', ' || n_regionkey || ')', ',' || chr(10) || '  ' order by n_nationkey) || ';' as statement from nation group by 1")
def insert_script(spark, folder):
    return statements.insert_script(table(spark, folder, "nation").withColumn("place", C("n_nationkey") + 1), "place", "postgres", size=10)


@query(VERSIONS + """select o_orderkey, case status when 'source_only' then 'insert' when 'target_only' then 'delete' else 'update' end as action,
case status when 'source_only' then 'INSERT INTO `orders` (`o_custkey`, `o_orderkey`, `o_orderpriority`, `o_orderstatus`) VALUES (' || s_custkey || ', ' || o_orderkey || ', ''' || s_priority || ''', ''' || s_status || ''');'
when 'target_only' then 'DELETE FROM `orders` WHERE `o_orderkey` = ' || o_orderkey || ';' else 'UPDATE `orders` SET ' || array_to_string(list_filter([case when s_priority is distinct from t_priority then '`o_orderpriority` = ''' || s_priority || '''' end, case when s_status is distinct from t_status then '`o_orderstatus` = ''' || s_status || '''' end], lambda x: x is not null), ', ') || ' WHERE `o_orderkey` = ' || o_orderkey || ';' end as statement from cmp where status <> 'unchanged'""")
def apply_statement_text(spark, folder):
    rows = compared(spark, folder)
    cut = F.col("source_row")
    rows = rows.withColumn("source_row", F.when(cut.isNotNull(), F.struct(*(cut[c].alias(c) for c in ("o_orderkey", "o_custkey", *COMPARE)))))
    return statements.apply_statements(rows, "orders", KEYS)


KEYED = [(1, "a", None), (2, None, 5), (3, "it's", 7)]


@query(f"select id, case when b is null then '`b` = ' || n || ' AND `n` IS NULL' end as predicate from {values_sql(KEYED, 'id, b, n')} where false union all select 1, '`a` = ''a'' AND `n` IS NULL' union all select 2, '`a` IS NULL AND `n` = 5' union all select 3, '`a` = ''it''''s'' AND `n` = 7'")
def key_predicates(spark, folder):
    df = spark.createDataFrame(KEYED, "id int, a string, n int")
    return df.select("id", statements.key_predicate(df, ["n", "a"]).alias("predicate"))


EDITS_SQL = "(select o_orderkey as row_key, 'o_orderstatus' as column_name, case when i = 1 then o_orderstatus else 'T' end as b, case when i = 1 then 'T' when o_custkey % 2 = 0 then o_orderstatus else 'X' end as n, i from orders, (values (1), (2)) as s(i) where o_totalprice > 200000 and (i = 1 or o_custkey % 3 = 0))"


def edits(spark, folder):
    rows = table(spark, folder, "orders").where("o_totalprice > 200000").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2)))).where("seq = 1 or o_custkey % 3 = 0")
    back = F.when(C("o_custkey") % 2 == 0, C("o_orderstatus")).otherwise("X")
    return rows.select(C("o_orderkey").alias("row_key"), F.lit("o_orderstatus").alias("column_name"), F.when(C("seq") == 1, C("o_orderstatus")).otherwise("T").alias("before_value"), F.when(C("seq") == 1, "T").otherwise(back).alias("next_value"), "seq")


STAGED_SQL = f"(select row_key, column_name, arg_min(b, i) as before_value, arg_max(n, i) as next_value from {EDITS_SQL} group by row_key, column_name having arg_min(b, i) is distinct from arg_max(n, i))"


@query(f"select * from {STAGED_SQL}")
def staged_cells(spark, folder):
    return grid.staged_edits(edits(spark, folder))


@query(f"with d as (select o_orderkey as row_key from orders where o_orderkey % 5 = 0 and o_orderkey % 2 = 0) select row_key, 'update' as kind, 'o_orderstatus' as columns from {STAGED_SQL} where row_key not in (select row_key from d) union all select row_key, 'delete', '' from d")
def commit_drafts(spark, folder):
    keys = table(spark, folder, "orders").where("o_orderkey % 5 = 0").select(C("o_orderkey").alias("row_key"))
    actions = keys.withColumns({"action": F.lit("delete"), "seq": F.lit(1)}).unionByName(keys.where("row_key % 2 = 1").withColumns({"action": F.lit("restore"), "seq": F.lit(2)}))
    return grid.commit_drafts(grid.staged_edits(edits(spark, folder)), grid.staged_rows(actions)).select("row_key", "kind", "columns")


@query("""select count(*) as n_statements, sha256('["nation", null, ["n_nationkey"]]' || string_agg(sha256('{"kind":"update","sql":' || case when n_nationkey % 7 = 0 then 'null' else '"UPDATE ' || n_name || '"' end || ',"row_key":"' || n_nationkey || '"}'), '' order by n_nationkey)) as plan_hash from nation""")
def plan_hash(spark, folder):
    rows = table(spark, folder, "nation").select(C("n_nationkey").alias("place"), F.lit("update").alias("kind"), F.when(C("n_nationkey") % 7 != 0, F.concat(F.lit("UPDATE "), "n_name")).alias("sql"), C("n_nationkey").cast("string").alias("row_key"))
    return grid.plan_hash(rows, "nation", ["n_nationkey"])


@query("select k as l_orderkey, 'update' as kind, coalesce(n, 0) as affected, coalesce(n, 0) <> 1 as mismatch from (select distinct o_orderkey as k from orders where o_orderkey % 3 = 0) left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) on k = l_orderkey")
def affected_rows(spark, folder):
    wanted = table(spark, folder, "orders").where("o_orderkey % 3 = 0").select(C("o_orderkey").alias("l_orderkey"), F.lit("update").alias("kind"))
    return grid.affected(table(spark, folder, "lineitem"), wanted, ["l_orderkey"])


RESULTS_SQL = "(select o_orderpriority as table_name, case when o_orderstatus = 'F' then 'insert' when o_orderstatus = 'O' then 'update' else 'delete' end as action, count(*) as attempted from orders group by all)"


@query(f"select table_name, action, attempted, 0 as succeeded, attempted as failed, case when table_name = '2-HIGH' and action = 'insert' then 'lost connection' end as error from {RESULTS_SQL}")
def failure_accounts(spark, folder):
    action = F.when(C("o_orderstatus") == "F", "insert").when(C("o_orderstatus") == "O", "update").otherwise("delete")
    rows = table(spark, folder, "orders").groupBy(C("o_orderpriority").alias("table_name"), action.alias("action")).agg(F.count("*").alias("attempted"))
    return grid.failed_results(rows, "lost connection", "2-HIGH", "insert")


JOB_SQL = "(select o_custkey as job_id, o_orderkey as seq, case when o_orderkey % 3 = 0 then ' ' else o_orderpriority end as t, o_orderstatus as a, case when o_orderkey % 4 = 0 then ' bad ' end as f from orders)"


@query(f"select job_id, arg_min(t, seq) filter (where trim(t) <> '') as primary_table, count(distinct trim(t)) filter (where trim(t) <> '') as table_count, arg_min(t || ' / ' || a || ' / bad', seq) filter (where f is not null) as failure_summary from {JOB_SQL} group by job_id")
def job_summaries(spark, folder):
    rows = table(spark, folder, "orders").select(C("o_custkey").alias("job_id"), C("o_orderkey").alias("seq"), F.when(C("o_orderkey") % 3 == 0, " ").otherwise(C("o_orderpriority")).alias("table_name"), C("o_orderstatus").alias("action"), F.when(C("o_orderkey") % 4 == 0, " bad ").alias("failure"))
    return grid.job_summary(rows)


@query("select n_nationkey, n_name, true as more from nation order by n_nationkey limit 20")
def statement_preview(spark, folder):
    rows, more = grid.preview(table(spark, folder, "nation"), "n_nationkey")
    return rows.select("n_nationkey", "n_name", F.lit(more).alias("more"))


@query("select o_orderkey from orders order by o_orderkey desc limit 37")
def current_page(spark, folder):
    return grid.current_page(table(spark, folder, "orders"), "o_orderkey", 37).select("o_orderkey")


@query("select n_nationkey, n_name, row_number() over (order by part, n_nationkey) as i from (select 1 as part, n_nationkey, n_name from nation union all select 0, r_regionkey, null from region)")
def drafts_above_rows(spark, folder):
    from pyspark.sql import Window as W

    drafts = table(spark, folder, "region").select(C("r_regionkey").alias("n_nationkey"))
    rows = grid.with_drafts(table(spark, folder, "nation").select("n_nationkey", "n_name"), drafts, "n_nationkey")
    return rows.select("n_nationkey", "n_name", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("ordinal")).alias("i"))


@query("select 1 as i, 50 as loaded, 50 as retained, 1000 as next_load, true as more union all select 2, 120, 100, 30, true union all select 3, 100, 100, 1, false union all select 4, 7, 5, 1000, false")
def grid_metrics(spark, folder):
    made = [grid.metrics(50, 50, None, None, True, "offset"), grid.metrics(100, 100, 150, 120, True, "offset", 120), grid.metrics(100, 100, 100, 100, False, "offset"), grid.metrics(5, 7, None, None, True, "unsupported")]
    return spark.createDataFrame([(i + 1, m.loaded, m.retained, m.next_load, m.can_load_more) for i, m in enumerate(made)], "i int, loaded int, retained int, next_load int, more boolean")


@query("select 1 as i, 'many_deletes,unsafe_delete_confirmation_required,target_database_confirmation_required' as codes union all select 2, 'many_deletes' union all select 3, 'target_database_confirmation_required' union all select 4, ''")
def execution_confirmations(spark, folder):
    many = [("many_deletes", "warning")]
    made = [grid.confirmations(many, False, "prod", "shop", "sho"), grid.confirmations(many, True, "prod", "shop", " shop "), grid.confirmations([], False, "prod", "shop", None), grid.confirmations([], False, "dev", "shop", None)]
    return spark.createDataFrame([(i + 1, ",".join(c for c, _ in m)) for i, m in enumerate(made)], "i int, codes string")
