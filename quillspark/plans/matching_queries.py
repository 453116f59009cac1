"""Queries of schema matching and of name plans, on two versions of a small schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import cells, text
from quillspark.operators import matching, names, similarity, visibility
from quillspark.plans.registry import query, table, values_sql

OLD = [
    ("s1", 1, "Orders", "orders", 1, "Order id", "order_id", "bigint", None, True, True, True, None),
    ("s1", 1, "Orders", "orders", 2, "Customer", "customer_id", "bigint", None, True, False, False, "who"),
    ("s1", 1, "Orders", "orders", 3, "Total amount", "total_amount", "decimal", "10,2", False, False, False, "sum"),
    ("s1", 1, "Orders", "orders", 4, "Note", "note", "varchar", "100", False, False, None, "free\ntext"),
    ("s1", 1, "Orders", "orders", 5, "Memo", "", "text", None, False, False, False, None),
    ("s1", 1, "Orders", "orders", 6, "Flag", "old_flag", "boolean", None, False, False, False, None),
    ("s1", 2, "Customers", "customers", 1, "Customer id", "customer_id", "bigint", None, True, True, False, None),
    ("s1", 2, "Customers", "customers", 2, "Customer name", "customer_name", "varchar", "120", True, False, False, None),
    ("s1", 3, "Plain list", "", 1, "Key", "list_key", "int", None, True, True, False, None),
    ("s1", 4, "Legacy", "legacy_log", 1, "Line", "log_line", "text", None, False, False, False, None),
    ("s2", 1, "Stores", "stores", 1, "Store", "store_id", "int", None, True, True, False, None),
]
NEW = [
    ("s1", 1, "Orders", "orders", 1, "Order id", "order_id", "bigint", None, True, True, True, None),
    ("s1", 1, "Orders", "orders", 2, "Customer", "customer_id", "bigint", None, False, False, False, "who"),
    ("s1", 1, "Orders", "orders", 3, "Total amount", "total_amt", "decimal", "10,2", False, False, False, "sum"),
    ("s1", 1, "Orders", "orders", 4, "Note", "note", "varchar", "100", False, False, False, " free \n\n text"),
    ("s1", 1, "Orders", "orders", 5, "Memo", "", "longtext", None, False, False, False, None),
    ("s1", 1, "Orders", "orders", 6, "Created", "created_at", "datetime", None, True, False, False, None),
    ("s1", 2, "Customers", "customer_master", 1, "Customer id", "customer_id", "bigint", None, True, True, False, None),
    ("s1", 2, "Customers", "customer_master", 2, "Customer name", "customer_name", "varchar", "120", True, False, False, None),
    ("s1", 3, "Plain list", "", 1, "Key", "list_key", "int", None, True, True, False, None),
    ("s1", 5, "Brand new", "brand_new", 1, "Id", "id", "int", "11", True, True, True, None),
    ("s3", 1, "Stores", "stores", 1, "Store", "store_id", "int", None, True, True, False, None),
]
NAMES_SQL = "sheet, table_id, table_logical, table_physical, position, logical, physical, data_type, size, not_null, is_pk, auto_increment, comment"
#: The parts of a brand and type as a table, a column a part.
PART_OLD = """(select p_brand as sheet, cast(ascii(p_type) * 128 + ascii(substr(p_type, 2, 1)) as int) as table_id, p_brand || ' ' || p_type as table_logical, 'tab_' || replace(lower(p_brand), '#', '_') || '_' || lower(p_type) as table_physical,
    cast(row_number() over (partition by p_brand, p_type order by p_partkey) as int) as position, 'Part ' || p_partkey as logical, 'c_' || p_partkey as physical, case p_partkey % 3 when 0 then 'varchar' when 1 then 'int' else 'decimal' end as data_type,
    case p_partkey % 3 when 0 then cast(p_size as varchar) when 2 then '10,2' end as size, p_size % 2 = 0 as not_null, row_number() over (partition by p_brand, p_type order by p_partkey) = 1 as is_pk, false as auto_increment, case when p_partkey % 5 = 0 then p_name end as comment from part)"""
#: The same, later: parts gone, sizes and flags changed, and comments in their white space.
PART_NEW = f"""(select sheet, table_id, table_logical, table_physical, position, logical, physical, data_type, case when k % 10 = 1 then coalesce(size, '') || '9' else size end as size, case when k % 10 = 2 then not not_null else not_null end as not_null,
    is_pk, auto_increment, case when k % 10 = 3 then coalesce(comment, '') || chr(10) || ' ' else comment end as comment from (select *, cast(substr(physical, 3) as int) as k from {PART_OLD}) where k % 10 <> 0)"""
#: What differs of columns whose table is still there, with the tables that are gone.
PART_CHANGES = f"""(select o.sheet, o.table_id, o.table_physical as tab, o.physical, o.position as place, case when n.sheet is null then 'removed' else 'modified' end as action,
    case when n.sheet is null then [] when o.size is distinct from n.size then ['size'] when o.not_null <> n.not_null then ['notNull'] else ['comment'] end as f
    from {PART_OLD} o left join {PART_NEW} n on o.sheet = n.sheet and o.table_id = n.table_id and o.position = n.position
    where (o.sheet, o.table_id) in (select (sheet, table_id) from {PART_NEW}) and (n.sheet is null or o.size is distinct from n.size or o.not_null <> n.not_null or o.comment is distinct from n.comment))"""
PART_GONE = f"(select distinct sheet, table_physical as tab from {PART_OLD} where (sheet, table_id) not in (select (sheet, table_id) from {PART_NEW}))"
OLD_SQL, NEW_SQL = (f"(select * from {values_sql(rows, NAMES_SQL, 'x')} union all select * from {more}) as {alias}" for rows, more, alias in ((OLD, PART_OLD, "o"), (NEW, PART_NEW, "n")))


def versions(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Two versions of definitions: of parts, and a few that reach each rule."""
    part, k = table(spark, folder, "part"), F.col("p_partkey")
    place = F.row_number().over(W.partitionBy("p_brand", "p_type").orderBy("p_partkey"))
    old = part.select(
        F.col("p_brand").alias("sheet"), (F.ascii("p_type") * 128 + F.ascii(F.substring("p_type", 2, 1))).alias("table_id"), F.concat_ws(" ", "p_brand", "p_type").alias("table_logical"),
        F.concat(F.lit("tab_"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit("_"), F.lower("p_type")).alias("table_physical"), place.alias("position"), F.concat(F.lit("Part "), k).alias("logical"), F.concat(F.lit("c_"), k).alias("physical"),
        F.when(k % 3 == 0, "varchar").when(k % 3 == 1, "int").otherwise("decimal").alias("data_type"), F.when(k % 3 == 0, F.col("p_size").cast("string")).when(k % 3 == 2, "10,2").alias("size"), (F.col("p_size") % 2 == 0).alias("not_null"), (place == 1).alias("is_pk"),
        F.lit(False).alias("auto_increment"), F.when(k % 5 == 0, F.col("p_name")).alias("comment"), k.alias("k"),
    )
    k = F.col("k")
    new = old.where(k % 10 != 0).withColumns({"size": F.when(k % 10 == 1, F.concat(F.coalesce("size", F.lit("")), F.lit("9"))).otherwise(F.col("size")), "not_null": F.col("not_null") != (k % 10 == 2), "comment": F.when(k % 10 == 3, F.concat(F.coalesce("comment", F.lit("")), F.lit("\n "))).otherwise(F.col("comment"))})
    return tuple(a.unionByName(b.drop("k")) for a, b in zip(fixed_versions(spark), (old, new)))


def fixed_versions(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(OLD, matching.DEFINITION), spark.createDataFrame(NEW, matching.DEFINITION)


def norm_sql(x: str) -> str:
    return rf"regexp_replace(lower(trim(coalesce({x}, ''))), '\s+', '_', 'g')"


def dice_sql(x: str, y: str) -> str:
    a, b = norm_sql(x), norm_sql(y)
    grams = lambda c: f"(case when length({c}) < 2 then [{c}] else list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)) end)"
    p, q = grams(a), grams(b)
    shared = f"list_sum(list_transform(list_distinct({p}), lambda g: least(len(list_filter({p}, lambda z: z = g)), len(list_filter({q}, lambda z: z = g)))))"
    return f"(case when {a} = {b} then 1.0 when {a} = '' or {b} = '' then 0.0 else 2.0 * {shared} / (len({p}) + len({q})) end)"


COLUMN_SCORE = f"cast(round(round(0.45 * {dice_sql('o.physical', 'n.physical')} + 0.2 * {dice_sql('o.logical', 'n.logical')} + 0.2 * (case when o.data_type is not distinct from n.data_type and o.size is not distinct from n.size then 1 else 0 end) + 0.1 * (case when o.not_null = n.not_null and o.is_pk = n.is_pk then 1 else 0 end) + 0.05 * {dice_sql('o.comment', 'n.comment')}, 9), 6) as double)"


@query(f"select o.table_id, o.position as old_position, n.position as new_position, {COLUMN_SCORE} as score from {OLD_SQL} join {NEW_SQL} on o.sheet = n.sheet and o.table_id = n.table_id")
def column_scores(spark, folder):
    rows = matching.column_scores(*versions(spark, folder), ["sheet", "table_id"], places=6)
    return rows.select("table_id", "old_position", "new_position", "score")


TABLES_SQL = "(select sheet, table_id as id, max(table_logical) as logical, max(table_physical) as physical, list(distinct case when physical <> '' then lower(physical) else lower(replace(logical, ' ', '_')) end) as names, string_agg(coalesce(comment, ''), '|' order by position) as comments from {0} group by sheet, table_id)"
SIDES = f"{TABLES_SQL.format(OLD_SQL)} o join {TABLES_SQL.format(NEW_SQL)} n on o.sheet = n.sheet"
TABLE_SCORE = f"cast(round(round(0.35 * {dice_sql('o.physical', 'n.physical')} + 0.25 * {dice_sql('o.logical', 'n.logical')} + 0.3 * len(list_intersect(o.names, n.names)) / len(list_distinct(list_concat(o.names, n.names))) + 0.1 * {dice_sql('o.comments', 'n.comments')}, 9), 6) as double)"


@query(f"select o.sheet, o.id as old_id, n.id as new_id, {TABLE_SCORE} as score from {SIDES}")
def table_scores(spark, folder):
    return matching.table_scores(*map(matching.tables_of, versions(spark, folder)), ["sheet"]).withColumn("score", F.round("score", 6))


@query(f"""with recursive pairs as (select o.sheet, o.id as a, n.id as b, o.physical as p, n.physical as q, o.logical as l, n.logical as m, {TABLE_SCORE} as score from {SIDES}),
exact as (select sheet, a, b, score, case when p <> '' then 'physical' else 'logical' end as phase from pairs where (p <> '' and lower(p) = lower(q)) or (p = '' and q = '' and lower(l) = lower(m))),
cand as (select *, row_number() over (partition by sheet order by score desc, a, b) as i from pairs p where score >= 0.65 and not exists (select 1 from exact e where e.sheet = p.sheet and (e.a = p.a or e.b = p.b))),
walk as (select distinct sheet, cast(0 as bigint) as i, cast([] as integer[]) as ua, cast([] as integer[]) as ub, cast(null as integer) as a, cast(null as integer) as b, cast(null as double) as score from cand
union all select c.sheet, c.i, case when list_contains(ua, c.a) or list_contains(ub, c.b) then ua else list_append(ua, c.a) end, case when list_contains(ua, c.a) or list_contains(ub, c.b) then ub else list_append(ub, c.b) end, case when list_contains(ua, c.a) or list_contains(ub, c.b) then null else c.a end, c.b, c.score from walk w join cand c on c.sheet = w.sheet and c.i = w.i + 1)
select sheet, a as old_id, b as new_id, phase, score from exact union all select sheet, a, b, 'fuzzy', score from walk where a is not null""")
def table_matches(spark, folder):
    sides = [matching.tables_of(df).select("sheet", F.struct(F.col("table_id").alias("id"), "logical", "physical", "names", "comments").alias("x")) for df in versions(spark, folder)]
    return matching.matched(*sides, ["sheet"], matching.table_score).withColumn("score", F.round("score", 6))


COLUMN_CHANGES = [
    ("s1", 1, 1, "modified", ["notNull"], 2, 2),
    ("s1", 1, 1, "rename_suggest", ["physicalName"], 3, 3),
    ("s1", 1, 1, "modified", ["comment"], 4, 4),
    ("s1", 1, 1, "modified", ["dataType"], 5, 5),
    ("s1", 1, 1, "removed", [], 6, None),
    ("s1", 1, 1, "added", [], None, 6),
]
TABLE_CHANGES = [("s1", "changed", "orders", "orders", [], 6), ("s1", "rename_suggest", "customers", "customer_master", ["physicalTableName"], 0), ("s1", "removed", "legacy_log", None, [], 0), ("s1", "added", None, "brand_new", [], 0), ("s2", "removed", "stores", None, [], 0), ("s3", "added", None, "stores", [], 0)]


@query(f"select sheet, old_table, new_table, action, array_to_string(f, ',') as fields, a as old_position, b as new_position from {values_sql(COLUMN_CHANGES, 'sheet, old_table, new_table, action, f, a, b')} union all select sheet, table_id, table_id, action, array_to_string(f, ','), place, case when action = 'modified' then place end from {PART_CHANGES}")
def column_change_list(spark, folder):
    _, columns = matching.schema_changes(*versions(spark, folder))
    return columns.select("sheet", "old_table", "new_table", "action", F.array_join("changed_fields", ",").alias("fields"), F.col("o.id").alias("old_position"), F.col("n.id").alias("new_position"))


@query(f"select sheet, action, a as before, b as after, array_to_string(f, ',') as fields, n as n_columns from {values_sql(TABLE_CHANGES, 'sheet, action, a, b, f, n')} union all select sheet, 'changed', tab, tab, '', count(*) from {PART_CHANGES} group by sheet, tab union all select sheet, 'removed', tab, null, '', 0 from {PART_GONE}")
def table_change_list(spark, folder):
    tables, _ = matching.schema_changes(*versions(spark, folder))
    return tables.select("sheet", "action", F.col("o.physical").alias("before"), F.col("n.physical").alias("after"), F.array_join("changed_fields", ",").alias("fields"), "n_columns")


@query(f"select 2 as added_tables, 2 + (select count(*) from {PART_GONE}) as removed_tables, 1 + count(distinct tab) as changed_tables, 1 as added_columns, 1 + count_if(action = 'removed') as removed_columns, 4 + count_if(action = 'modified') as changed_columns, 2 as rename_suggestions from {PART_CHANGES}")
def schema_change_summary(spark, folder):
    return matching.summary(*matching.schema_changes(*versions(spark, folder)))


@query("select unnest(['column:created_at', 'column:customer_id', 'column:Memo', 'column:note', 'column:old_flag', 'column:total_amt', 'rename:pending_confirmation', 'table:brand_new', 'table:customer_master', 'table:legacy_log', 'table:orders', 'table:stores']) as keyword " + f"union select 'column:' || physical from {PART_CHANGES} union select 'table:' || tab from {PART_CHANGES} union select 'table:' || tab from {PART_GONE}")
def change_hints(spark, folder):
    return matching.hints(*matching.schema_changes(*versions(spark, folder)))


@query(f"select distinct lower(sheet) || '|' || lower(physical) || '|' || list_aggregate(list_sort(names), 'string_agg', ',') as signature from {TABLES_SQL.format(OLD_SQL)} o")
def definition_signatures(spark, folder):
    return matching.signatures(versions(spark, folder)[0])


FILES = [(i, f"design_{'ab'[i % 2]}_{i}.xlsx", f"2024-01-{1 + i % 28:02d} 00:00:00", [f"t{j}" for j in range(i % 4)]) for i in range(1, 31)]
OWN = ["t0", "t2", "t9"]
BASE_SQL = f"""with f as (select id, name, epoch_ms(cast(up as timestamp)) as ms, sigs, {dice_sql('name', "'design_a_7.xlsx'")} as named from {values_sql(FILES, 'id, name, up, sigs')}), u as (select epoch_ms(timestamp '2024-01-20 12:00:00') as now),
q as (select f.*, abs(ms - now) as far, (select max(abs(ms - now)) from f, u) as most from f, u), s as (select * from q order by round(0.7 * named + 0.3 * greatest(1 - far / cast(most as double), 0), 9) desc, id limit 24)
select id, cast(round(0.35 * named + 0.25 * greatest(1 - far / cast((select max(far) from s) as double), 0) + 0.4 * len(list_intersect(sigs, ['t0', 't2', 't9'])) / len(list_distinct(list_concat(sigs, ['t0', 't2', 't9']))), 6) as double) as score from s"""


@query(BASE_SQL)
def baseline_candidates(spark, folder):
    files = spark.createDataFrame(FILES, "id int, name string, at string, signatures array<string>").withColumn("ms", cells.timestamp_ms(F.col("at")))
    now = 1705752000000
    own = spark.createDataFrame([(OWN,)], "signatures array<string>")
    return matching.baseline_scores(files, "design_a_7.xlsx", now, own).withColumn("score", F.round("score", 6))


@query(f"select distinct sheet from (select sheet from {OLD_SQL} union select sheet from {NEW_SQL})")
def sheet_names(spark, folder):
    old, new = versions(spark, folder)
    return old.select("sheet").union(new.select("sheet")).distinct().orderBy("sheet")


@query(f"select 's1' as sheet, 's1' as baseline union all select 's3', 's2' union all select distinct sheet, sheet from {PART_NEW}")
def sheet_baselines(spark, folder):
    old, new = versions(spark, folder)
    return matching.sheet_mapping(new, old)


IDENTIFIERS = [(1, 1, "a"), (1, 2, "a"), (1, 3, "a_2"), (1, 4, "Order"), (1, 5, "order"), (1, 6, "日本"), (1, 7, "2nd Value"), (1, 8, "x" * 70), (2, 1, "a"), (2, 2, ""), (2, 3, "camelCase"), (2, 4, "CAMEL_CASE")]
PLANNED = [(1, 1, "a", ""), (1, 2, "a_2", "duplicate_resolved"), (1, 3, "a_2_2", "duplicate_resolved"), (1, 4, "n_order", "reserved_word_prefixed"), (1, 5, "n_order_2", "reserved_word_prefixed,duplicate_resolved"), (1, 6, "column_6", ""), (1, 7, "t_2nd_value", ""), (1, 8, "x" * 57 + "_" + names.fnv_hash("x" * 70), "length_overflow_truncated"), (2, 1, "a", ""), (2, 2, "column_2", ""), (2, 3, "camel_case", ""), (2, 4, "camel_case_2", "duplicate_resolved")]


@query(f"select table_id, position, after, reasons from {values_sql(PLANNED, 'table_id, position, after, reasons')}")
def name_plan(spark, folder):
    df = spark.createDataFrame(IDENTIFIERS, "table_id int, position int, physical string")
    rows = names.name_plan(df, ["table_id"], "position", ["physical"], "concat('column_', position)")
    return rows.select("table_id", "position", "after", F.array_join("reasons", ",").alias("reasons"))


@query(f"""select table_id, position, conflicts from {values_sql([(1, 2, 'duplicate'), (1, 4, 'reserved_word'), (1, 5, 'reserved_word,duplicate'), (1, 8, 'length_overflow'), (2, 4, 'duplicate')], 'table_id, position, conflicts')}""")
def name_conflicts(spark, folder):
    df = spark.createDataFrame(IDENTIFIERS, "table_id int, position int, physical string")
    rows = names.name_plan(df, ["table_id"], "position", ["physical"], "concat('column_', position)", conflict="abort", reserved="abort", overflow="abort")
    return rows.where(F.size("conflicts") > 0).select("table_id", "position", F.array_join("conflicts", ",").alias("conflicts"))


def flat_changes(spark, folder) -> DataFrame:
    """Column changes with what views ask for."""
    _, columns = matching.schema_changes(*versions(spark, folder))
    side = lambda s, p: [F.col(f"{s}.{f}").alias(f"{p}_{f}") for f in ("logical", "physical", "comment")]
    return columns.select(F.col("old_table").alias("table_key"), "action", "changed_fields", "o", "n", F.coalesce("o.id", "n.id").alias("place"), *side("o", "old"), *side("n", "new"))


FLAT = [(1, "modified", ["notNull"], 2), (1, "rename_suggest", ["physicalName"], 3), (1, "modified", ["comment"], 4), (1, "modified", ["dataType"], 5), (1, "removed", [], 6), (1, "added", [], 6)]
FLAT_SQL = f"""(select *, case when action = 'added' then 'non_breaking' when action <> 'modified' then 'breaking' when f = ['comment'] then 'metadata' when len(list_intersect(f, ['dataType', 'size', 'notNull', 'isPk', 'autoIncrement', 'physicalName'])) > 0 then 'breaking' else 'non_breaking' end as impact from (select * from {values_sql(FLAT, 'table_key, action, f, place')} union all select table_id, action, f, place from {PART_CHANGES}))"""


@query(f"select action, place, impact, f = ['comment'] as formatting from {FLAT_SQL}")
def change_impacts(spark, folder):
    return visibility.visible_columns(flat_changes(spark, folder)).select("action", "place", "impact", "formatting")


@query(f"select action, place from {FLAT_SQL} where impact <> 'metadata' union all select action, place + 100 from {FLAT_SQL} where list_contains(f, 'notNull') union all select action, place + 200 from {FLAT_SQL} where action = 'modified' and f <> ['comment'] union all select 'rename_suggest', 303")
def visible_changes(spark, folder):
    rows = flat_changes(spark, folder)
    shown = [visibility.visible_columns(rows, metadata=False), visibility.visible_columns(rows, field="nullable"), visibility.visible_columns(rows, action="modified", hide_formatting=True), visibility.visible_columns(rows, keyword="TOTAL_AMT")]
    out = [df.select("action", (F.col("place") + 100 * i).alias("place")) for i, df in enumerate(shown)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(f"select table_key, sum(case when impact <> 'metadata' then 1 else 0 end) as n_schema, sum(case when impact = 'metadata' then 1 else 0 end) as n_metadata, sum(case when f = ['comment'] then 1 else 0 end) as n_formatting from {FLAT_SQL} group by table_key")
def change_impact_counts(spark, folder):
    return visibility.impact_counts(visibility.visible_columns(flat_changes(spark, folder)))


TABLE_IMPACTS = [(1, "removed", [], []), (2, "added", [], []), (3, "changed", ["physicalTableName"], []), (4, "changed", ["logicalTableName"], ["breaking"]), (5, "changed", [], ["metadata", "breaking"]), (6, "changed", [], ["metadata"]), (7, "changed", [], []), (8, "changed", [], ["metadata", "non_breaking"]), (9, "rename_suggest", [], ["metadata"])]


@query("select unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) as id, unnest(['breaking', 'non_breaking', 'breaking', 'non_breaking', 'breaking', 'metadata', 'non_breaking', 'non_breaking', 'breaking']) as impact")
def table_impacts(spark, folder):
    df = spark.createDataFrame(TABLE_IMPACTS, "id int, action string, fields array<string>, impacts array<string>")
    return df.select("id", visibility.table_impact(F.col("action"), F.col("fields"), F.col("impacts")).alias("impact"))


@query(f"select rank() over (order by r, place) as i, action, place from (select action, place, case action when 'removed' then 0 when 'rename_suggest' then 1 when 'modified' then 3 when 'added' then 4 end as r from {FLAT_SQL})")
def change_order(spark, folder):
    rows = visibility.ordered_changes(flat_changes(spark, folder), "place")
    return rows.select(F.rank().over(W.partitionBy(F.lit(1)).orderBy("rank", "place")).alias("i"), "action", "place")


@query(f"""select n.position, f as field, case when v is null or trim(v) = '' then '-' else trim(v) end as new_value from (select n.position, unnest(['logical', 'physical', 'data_type', 'size', 'comment']) as f, unnest([n.logical, n.physical, n.data_type, n.size, n.comment]) as v from {NEW_SQL} where n.physical = 'created_at') as n""")
def added_column_fields(spark, folder):
    rows = flat_changes(spark, folder).where("action = 'added'")
    return visibility.field_changes(rows, ["logical", "physical", "data_type", "size", "comment"]).select(F.col("n.id").alias("position"), "field", "new_value")


NAMED = """(select p_brand, p_partkey as id, p_name || ' ' || p_type || ' ' || p_size as name from part)"""
EDITED = """(select p_brand, p_partkey as id, case p_partkey % 4 when 0 then replace(p_name, ' ', '  ') || ' ' || p_type || ' ' || p_size when 1 then upper(p_name) || ' ' || p_type
    when 2 then replace(p_name, 'i', 'ie') || ' ' || p_type || ' ' || (p_size + 1) else p_type || '_' || p_name end as name from part)"""


def part_names(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Names of parts, and the same names edited."""
    part = table(spark, folder, "part")
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size")
    edits = F.when(F.col("p_partkey") % 4 == 0, F.concat_ws(" ", F.replace(name, F.lit(" "), F.lit("  ")), kind, size)).when(F.col("p_partkey") % 4 == 1, F.concat_ws(" ", F.upper(name), kind))
    edits = edits.when(F.col("p_partkey") % 4 == 2, F.concat_ws(" ", F.replace(name, F.lit("i"), F.lit("ie")), kind, size + 1)).otherwise(F.concat_ws("_", kind, name))
    return tuple(part.select("p_brand", F.col("p_partkey").alias("id"), x.alias("name")) for x in (F.concat_ws(" ", name, kind, size), edits))


SIMILAR = f"select o.p_brand, o.id as old_id, n.id as new_id, cast(round({dice_sql('o.name', 'n.name')}, 6) as double) as similarity from {NAMED} o join {EDITED} n on o.p_brand = n.p_brand where {dice_sql('o.name', 'n.name')} >= 0.85"


@query(SIMILAR)
def similar_part_names(spark, folder):
    """Names against edited names of a brand, by the rarest bigrams instead of all pairs."""
    return similarity.similar_names(*part_names(spark, folder), ["p_brand"], 0.85).withColumn("similarity", F.round("similarity", 6))


@query(f"""with recursive pairs as ({SIMILAR}), cand as (select *, row_number() over (partition by p_brand order by similarity desc, old_id, new_id) as i from pairs),
walk as (select distinct p_brand, cast(0 as bigint) as i, cast([] as bigint[]) as ua, cast([] as bigint[]) as ub, cast(null as bigint) as a, cast(null as bigint) as b, cast(null as double) as s from cand
union all select c.p_brand, c.i, case when list_contains(ua, c.old_id) or list_contains(ub, c.new_id) then ua else list_append(ua, c.old_id) end, case when list_contains(ua, c.old_id) or list_contains(ub, c.new_id) then ub else list_append(ub, c.new_id) end, case when list_contains(ua, c.old_id) or list_contains(ub, c.new_id) then null else c.old_id end, c.new_id, c.similarity from walk w join cand c on c.p_brand = w.p_brand and c.i = w.i + 1)
select p_brand, a as old_id, b as new_id, s as score from walk where a is not null""")
def matched_part_names(spark, folder):
    """The same names one to one, the most alike first."""
    return similarity.matched_names(*part_names(spark, folder), ["p_brand"], 0.85)


OLD_SHEETS = """(select case when cast(substr(p_brand, 7) as int) % 2 = 0 then p_brand else 'old ' || lower(p_brand) end as sheet, cast(substr(p_brand, 7) as int) as place, list_sort(list(distinct replace(p_name, ' ', '_'))) as tables from part where p_size % 10 <> 0 group by all)"""
NEW_SHEETS = "(select p_brand as sheet, list_sort(list(distinct replace(p_name, ' ', '_'))) as tables from part group by 1 union all select 'blank', [])"


def part_sheets(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Sheets of brands, their parts' names as tables: the newer has a blank sheet, the older other names for half of them, and less."""
    part, number = table(spark, folder, "part"), F.substring("p_brand", 7, 9).cast("int")
    none = {c: F.lit(None).cast("string") for c in ("table_logical", "physical", "logical", "comment")}
    made = lambda df, sheet: df.select(sheet.alias("sheet"), number.alias("place"), F.col("p_partkey").cast("int").alias("table_id"), F.col("p_name").alias("table_physical"), F.lit(1).alias("position")).withColumns(none)
    blank = spark.createDataFrame([("blank", 0, None, None, 1)], "sheet string, place int, table_id int, table_physical string, position int").withColumns(none)
    return made(part, F.col("p_brand")).unionByName(blank), made(part.where("p_size % 10 != 0"), F.when(number % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("old "), F.lower("p_brand"))))


MAPPED = f"""select n.sheet, coalesce(max(o.sheet) filter (where o.sheet = n.sheet), case when len(any_value(n.tables)) > 0 then arg_max(o.sheet, struct_pack(s := sc, p := -o.place)) filter (where sc >= 0.2) end, n.sheet) as baseline
from (select *, round(0.75 * len(list_intersect(n.tables, o.tables)) / len(list_distinct(list_concat(n.tables, o.tables))) + 0.25 * {dice_sql('n.sheet', 'o.sheet')}, 9) as sc from {NEW_SHEETS} n cross join {OLD_SHEETS} o) as x(n_sheet, n_tables, o_sheet, place, o_tables, sc), lateral (select n_sheet as sheet, n_tables as tables) n, lateral (select o_sheet as sheet, x.place as place) o group by n.sheet"""


@query(MAPPED)
def part_sheet_baselines(spark, folder):
    """Each sheet's older namesake, or the sheet most like it, the first of equals."""
    return matching.sheet_mapping(*part_sheets(spark, folder))


@query(f"""with s as (select f.c_custkey as id, f.c_custkey as place, round(0.7 * {dice_sql("'Customer#000000500'", 'f.c_name')} + 0.3 * greatest(1 - abs(f.c_nationkey - 7) / 20.0, 0), 9) as score from customer f)
select id, cast(round(score, 6) as double) as score from s order by score desc, place limit 1""")
def chosen_baseline(spark, folder):
    """The best of all candidates; of equal scores the first."""
    name, near = text.dice(F.lit("Customer#000000500"), F.col("c_name")), F.greatest(1 - F.abs(F.col("c_nationkey") - 7) / 20.0, F.lit(0.0))
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("place"), matching.weighted([(0.7, name), (0.3, near)]).alias("score"))
    return matching.baseline(rows).withColumn("score", F.round("score", 6))


@query("select t.kind, t.table_name, t.action, t.name, t.requires_confirmation from " + values_sql([
    ("table", "orders", "changed", "orders", False), ("table", "customer_master", "rename_suggest", "customer_master", True), ("table", "legacy_log", "removed", "legacy_log", False), ("table", "brand_new", "added", "brand_new", False), ("table", "stores", "removed", "stores", False), ("table", "stores", "added", "stores", False),
    ("column", "orders", "modified", "customer_id", False), ("column", "orders", "rename_suggest", "total_amt", True), ("column", "orders", "modified", "note", False), ("column", "orders", "modified", "Memo", False), ("column", "orders", "removed", "old_flag", False), ("column", "orders", "added", "created_at", False),
], "kind, table_name, action, name, requires_confirmation") + f" union all select 'table', tab, 'changed', tab, false from {PART_CHANGES} group by tab union all select 'table', tab, 'removed', tab, false from {PART_GONE} union all select 'column', tab, action, physical, false from {PART_CHANGES}")
def changed_name_list(spark, folder):
    return matching.changed_names(*matching.schema_changes(*versions(spark, folder))).select("kind", "table_name", "action", "name", "requires_confirmation")
