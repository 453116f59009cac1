"""Queries of cells, literals, kinds and type names, on rows that reach each of their branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import cells, text
from quillspark.operators import profile, statements
from quillspark.plans.registry import query, table, values_sql

C = F.col


def also(rows: list[tuple], names: str, more: tuple) -> str:
    """Rows of a constant, and rows of a table."""
    return f"(select * from {values_sql(rows, names, 'x')} union all {more[2]}) as t({names})"


def joined(spark, folder, rows: list[tuple], schema: str, more: tuple):
    made = spark.createDataFrame(rows, schema)
    return made.unionByName(table(spark, folder, more[0]).selectExpr(*(f"cast({e} as {k}) as {n}" for e, (n, k) in zip(more[1], made.dtypes))))


TYPED = [(1, "O'Brien", 5, 2.5, True), (2, "a\\b", -7, 100.0, False), (3, "", 0, 12345678.9, None), (4, None, None, None, True), (5, "two\nlines", 9007199254740993, 0.001, False)]
TYPED_MORE = ("customer", ["c_custkey + 1000", "concat(c_name, '\\'s')", "c_nationkey", "c_acctbal", "c_acctbal > 0"], "select c_custkey + 1000, c_name || '''s', c_nationkey, c_acctbal, c_acctbal > 0 from customer")
TYPED_SQL = also(TYPED, "id, t, i, d, b", TYPED_MORE)
NUMBER_SQL = "case when d is null then 'NULL' when d = floor(d) then cast(cast(d as bigint) as varchar) else cast(d as varchar) end"


def typed(spark, folder):
    return joined(spark, folder, TYPED, "id int, t string, i long, d double, b boolean", TYPED_MORE)


@query(f"""select id, coalesce('''' || replace(replace(t, '''', ''''''), chr(92), chr(92) || chr(92)) || '''', 'NULL') as t_mysql, coalesce('''' || replace(t, '''', '''''') || '''', 'NULL') as t_plain,
coalesce(cast(i as varchar), 'NULL') as i, {NUMBER_SQL} as d, coalesce(upper(cast(b as varchar)), 'NULL') as b from {TYPED_SQL}""")
def sql_literals(spark, folder):
    df = typed(spark, folder)
    plain, mysql = text.literals(df, ["t", "i", "d", "b"]), text.literals(df, ["t"], True)
    return df.select("id", mysql["t"].alias("t_mysql"), plain["t"].alias("t_plain"), plain["i"].alias("i"), plain["d"].alias("d"), plain["b"].alias("b"))


@query("select 'NaN' as given, 'NULL' as literal union all select 'Infinity', 'NULL' union all select '-Infinity', 'NULL' union all select '1.5', '1.5'")
def non_finite_literals(spark, folder):
    df = spark.createDataFrame([("NaN",), ("Infinity",), ("-Infinity",), ("1.5",)], "given string")
    return df.select("given", text.sql_literal(C("given").cast("double"), "double").alias("literal"))


CSV_SQL = "case when {0} is null then '' when contains({0}, ';') or contains({0}, '\"') or contains({0}, chr(10)) or contains({0}, chr(13)) then '\"' || replace({0}, '\"', '\"\"') || '\"' else {0} end"
CSV = [(1, "a;b", 1.0, True), (2, 'say "x"', 2.25, False), (3, "r\rn", None, None), (4, "a,b", -0.5, True)]
CSV_MORE = ('customer', ['c_custkey + 1000', 'concat(c_name, if(c_custkey % 3 = 0, \';"\', \'\'))', 'c_acctbal', 'c_acctbal > 0'], 'select c_custkey + 1000, c_name || case when c_custkey % 3 = 0 then \';"\' else \'\' end, c_acctbal, c_acctbal > 0 from customer')
CSV_ROWS = also(CSV, 'id, t, d, b', CSV_MORE)


@query(f"""select id, cast(id as varchar) || ';' || {CSV_SQL.format('t')} || ';' || coalesce(case when d = floor(d) then cast(cast(d as bigint) as varchar) else cast(d as varchar) end, '') || ';' || coalesce(cast(b as varchar), '') as line from {CSV_ROWS}""")
def csv_client_lines(spark, folder):
    df = joined(spark, folder, CSV, "id int, t string, d double, b boolean", CSV_MORE)
    return df.select("id", text.csv_line(df, ["id", "t", "d", "b"], ";").alias("line"))


SHEET = [("1", "1.5", "2024-01-02", "true", "x", "", "0", "+5", "1", "a" * 30), ("-20", "2", "2024-01-02T10:00:00.5+09:00", "FALSE", "1", " ", "1.", ".5", "true", "b" * 260), ("", "-3.25", "2024-01-02 10:00Z", "True", "2", "", "2", "5", "2", "")]
SHEET_COLUMNS = ["ints", "decimals", "times", "flags", "texts", "blanks", "dots", "signs", "mixed", "long"]
INT, DEC, BOOL = "^-?[0-9]+$", r"^-?[0-9]+\.[0-9]+$", "^(true|false)$"
TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ t][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(z|[+-][0-9]{2}:?[0-9]{2})?)?$"
CELL_SQL = f"case when trim(v) = '' then 'blank' when regexp_matches(trim(v), '{INT}') then 'integer' when regexp_matches(trim(v), '{DEC}') then 'decimal' when regexp_matches(trim(v), '{BOOL}', 'i') then 'boolean' when regexp_matches(trim(v), '{TIME}', 'i') then 'datetime' else 'text' end"
SHEET_SQL = " union all ".join(f"select '{c}' as column_name, {c} as v from {values_sql(SHEET, ', '.join(SHEET_COLUMNS))}" for c in SHEET_COLUMNS)


@query(f"""with k as (select column_name, {CELL_SQL} as k, length(trim(v)) as n from ({SHEET_SQL})),
g as (select column_name, max(n) as max_length, list_sort(list_distinct(list(k) filter (where k <> 'blank'))) as ks from k group by column_name),
f as (select column_name, cast(max_length as int) as max_length, case when ks = ['decimal', 'integer'] then 'decimal' when len(ks) = 1 then ks[1] else 'text' end as kind from g)
select column_name, kind, max_length, case kind when 'integer' then 'int' when 'decimal' then 'decimal(18,6)' when 'datetime' then 'datetime' when 'boolean' then 'tinyint(1)' else (case when max_length = 0 then 'varchar(255)' when max_length > 255 then 'text' else 'varchar(' || least(255, (max_length * 12 + 9) // 10) || ')' end) end as mysql_type,
case kind when 'integer' then 'integer' when 'decimal' then 'numeric(18,6)' when 'datetime' then 'timestamptz' when 'boolean' then 'boolean' else (case when max_length = 0 then 'varchar(255)' when max_length > 255 then 'text' else 'varchar(' || least(255, (max_length * 12 + 9) // 10) || ')' end) end as pg_type from f""")
def csv_column_types(spark, folder):
    rows = profile.column_kinds(spark.createDataFrame(SHEET, ", ".join(f"{c} string" for c in SHEET_COLUMNS)), SHEET_COLUMNS)
    return rows.select("column_name", "kind", "max_length", cells.type_of_kind(C("kind"), C("max_length"), "mysql").alias("mysql_type"), cells.type_of_kind(C("kind"), C("max_length"), "postgres").alias("pg_type"))


GIVEN = [(1, "12", "integer"), (2, "007", "integer"), (3, "9007199254740993", "integer"), (4, " ", "integer"), (5, "1.50", "decimal"), (6, "1.25", "decimal"), (7, "-0.5", "decimal"), (8, "3", "decimal"), (9, "TRUE", "boolean"), (10, "yes", "boolean"), (11, " keep ", "text"), (12, None, "text"), (13, "-4", "integer"), (14, "2024-01-01", "datetime")]
GIVEN_MORE = ('part', ['p_partkey + 1000', 'if(p_partkey % 2 = 0, cast(p_size as string), p_name)', "if(p_partkey % 2 = 0, 'integer', 'text')"], "select p_partkey + 1000, case when p_partkey % 2 = 0 then cast(p_size as varchar) else p_name end, case when p_partkey % 2 = 0 then 'integer' else 'text' end from part")
GIVEN_SQL = also(GIVEN, 'id, c, kind', GIVEN_MORE)


@query(f"""select id, case when trim(c) = '' or c is null then null when kind = 'integer' or (kind = 'decimal' and not contains(c, '.')) then trim(c) when kind = 'decimal' then trim(c) when kind = 'boolean' and lower(trim(c)) in ('true', 'false') then upper(trim(c)) when kind = 'boolean' then trim(c) else c end as value,
case when trim(c) = '' or c is null then false when kind in ('integer', 'decimal') and not contains(c, '.') then not (cast(try_cast(trim(c) as hugeint) as varchar) = trim(c) and abs(try_cast(trim(c) as hugeint)) <= 9007199254740991)
when kind = 'decimal' then regexp_matches(trim(c), '0$') when kind = 'boolean' then lower(trim(c)) not in ('true', 'false') else true end as quoted from {GIVEN_SQL}""")
def csv_coerced_cells(spark, folder):
    df = joined(spark, folder, GIVEN, "id int, c string, kind string", GIVEN_MORE)
    return df.withColumn("x", cells.coerced(C("c"), C("kind"))).select("id", "x.value", "x.quoted")


SEEN = [(1, "f47ac10b-58cc-4372-a567-0e02b2c3d479"), (2, "f47ac10b-58cc-7372-a567-0e02b2c3d479"), (3, "a@b.co"), (4, "2024-01-02"), (5, "2024-01-02T10:00:00Z"), (6, '{"a": 1}'), (7, "[1"), (8, "-12"), (9, "1.5"), (10, "x" * 49), (11, "plain"), (12, " "), (13, None), (14, "+5")]
SEEN_MORE = ('events', ['event_id + 1000', 'if(event_id % 3 = 0, event_type, props)'], 'select event_id + 1000, case when event_id % 3 = 0 then event_type else props end from events')
SEEN_SQL = also(SEEN, 'id, v', SEEN_MORE)
OBSERVED_SQL = r"""case when v is null then 'null' when trim(v) = '' then 'empty-text' when regexp_matches(trim(v), '^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$', 'i') then 'uuid-like' when regexp_matches(trim(v), '^[^\s@]+@[^\s@]+\.[^\s@]+$') then 'email-like'
when regexp_matches(trim(v), '^[0-9]{4}-[0-9]{2}-[0-9]{2}([ t][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(z|[+-][0-9]{2}:[0-9]{2})?)?$', 'i') then 'timestamp-like' when (trim(v) like '{%' or trim(v) like '[%') and (trim(v) like '%}' or trim(v) like '%]') then 'json-like'
when regexp_matches(trim(v), '^-?[0-9]+$') then 'integer-like' when regexp_matches(trim(v), '^-?[0-9]+\.[0-9]+$') then 'number-like' when length(trim(v)) > 48 then 'long-text' else 'text' end"""


@query(f"select id, {OBSERVED_SQL} as kind, case when v is null then 'null' when id % 2 = 0 then 'integer' else 'number' end as number_kind from {SEEN_SQL}")
def observed_values(spark, folder):
    df = joined(spark, folder, SEEN, "id int, v string", SEEN_MORE).withColumn("d", F.when(C("v").isNotNull(), F.when(C("id") % 2 == 0, C("id") * 1.0).otherwise(C("id") + 0.5)))
    return df.select("id", text.observed_kind(C("v")).alias("kind"), text.observed_kind(C("d"), "double").alias("number_kind"))


STATEMENTS = [(1, "SELECT *  FROM T\nWHERE a = 'it''s' AND b IN (1, 2.5)"), (2, 'select "x", `y` from t where ok = TRUE or z is null'), (3, "-- note\n/* more */ insert into t values (1)"), (4, "with a as (select 1) select * from a"), (5, "  "), (6, "UPDATE t SET nullable = false"), (7, "delete from " + "long_name_" * 12), (8, "create table t (a int)")]
STATEMENTS_MORE = ('orders', ['o_orderkey + 1000', 'concat(\'SELECT *  FROM orders WHERE o_orderkey = \', o_orderkey, \' AND o_orderpriority IN (\\\'\', o_orderpriority, \'\\\', "x")\')'], 'select o_orderkey + 1000, \'SELECT *  FROM orders WHERE o_orderkey = \' || o_orderkey || \' AND o_orderpriority IN (\'\'\' || o_orderpriority || \'\'\', "x")\' from orders')
STATEMENTS_SQL = also(STATEMENTS, 'id, s', STATEMENTS_MORE)


@query(rf"""with q as (select id, trim(regexp_replace(s, '\s+', ' ', 'g')) as one, lower(regexp_replace(s, '^(\s|--[^\n]*\n?|/\*.*?\*/)+', '')) as body from {STATEMENTS_SQL})
select id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(one, '''([^'']|'''')*''', '?', 'g'), '"([^"]|"")*"', '?', 'g'), '`[^`]*`', '?', 'g'), '\b[0-9]+(?:\.[0-9]+)?\b', '?', 'g'), '\btrue\b|\bfalse\b|null\b', '?', 'gi')) as pattern,
case when one = '' then '(empty SQL)' when length(one) <= 88 then one else rtrim(substr(one, 1, 85)) || '...' end as summary,
case when body like 'select %' or body like 'with %' then 'select' when body like 'insert %' then 'insert' when body like 'update %' then 'update' when body like 'delete %' then 'delete' else 'unknown' end as kind from q""")
def statement_patterns(spark, folder):
    df = joined(spark, folder, STATEMENTS, "id int, s string", STATEMENTS_MORE)
    return df.select("id", text.sql_pattern(C("s")).alias("pattern"), text.shortened(C("s")).alias("summary"), text.statement_kind(C("s")).alias("kind"))


TYPED_IN = [(1, ""), (2, " NULL "), (3, "True"), (4, "''"), (5, '""'), (6, "1e3"), (7, ".5"), (8, "0x1F"), (9, " text "), (10, "12 a"), (11, "-Infinity"), (12, "5.")]
TYPED_IN_MORE = ('part', ['p_partkey + 1000', 'if(p_partkey % 2 = 0, cast(p_size as string), p_name)'], 'select p_partkey + 1000, case when p_partkey % 2 = 0 then cast(p_size as varchar) else p_name end from part')
TYPED_IN_SQL = also(TYPED_IN, 'id, c', TYPED_IN_MORE)


@query(rf"""select id, case when trim(c) = '' then 'unset' when lower(trim(c)) = 'null' then 'null' when lower(trim(c)) in ('true', 'false') then 'boolean' when trim(c) in ('''''', '""') then 'text' when try_cast(trim(c) as double) is not null or trim(c) = '0x1F' then 'number' else 'text' end as type,
case when trim(c) = '' or lower(trim(c)) = 'null' then null when lower(trim(c)) in ('true', 'false') then lower(trim(c)) when trim(c) in ('''''', '""') then '' when try_cast(trim(c) as double) is not null or trim(c) = '0x1F' then trim(c) else c end as value from {TYPED_IN_SQL}""")
def inserted_cells(spark, folder):
    return joined(spark, folder, TYPED_IN, "id int, c string", TYPED_IN_MORE).withColumn("x", cells.inserted(C("c"))).select("id", "x.type", "x.value")


OVER = [(1, "yes", "x", 1.0, True), (2, "0", "x", 2.0, True), (3, "12.50", "x", 3.0, True), (4, "abc", None, None, None), (5, "", "x", 5.0, False), (6, "", None, None, None), (7, " 7 ", "y", 1.0, False)]
OVER_MORE = ('customer', ['c_custkey + 1000', 'cast(c_nationkey as string)', 'c_name', 'c_acctbal', 'true'], 'select c_custkey + 1000, cast(c_nationkey as varchar), c_name, c_acctbal, true from customer')
OVER_SQL = also(OVER, 'id, raw, s, d, b', OVER_MORE)


@query(f"""select id, case when s is null and raw = '' then null else raw end as as_text, case when d is null then (case when raw = '' then null else raw end) when trim(raw) = '' then '0' when try_cast(raw as double) is null then raw when try_cast(raw as double) = floor(try_cast(raw as double)) then cast(cast(try_cast(raw as double) as bigint) as varchar) else cast(try_cast(raw as double) as varchar) end as as_number,
case when b is null then (case when raw = '' then null else raw end) else cast(lower(trim(raw)) in ('true', '1', 'yes') as varchar) end as as_flag from {OVER_SQL}""")
def edited_cells(spark, folder):
    df = joined(spark, folder, OVER, "id int, raw string, s string, d double, b boolean", OVER_MORE)
    return df.select("id", cells.edited(C("raw"), C("s"), "string").alias("as_text"), cells.edited(C("raw"), C("d"), "double").alias("as_number"), cells.edited(C("raw"), C("b"), "boolean").alias("as_flag"))


HIDDEN = [(1, "plain"), (2, "a b"), (3, "z​z‌"), (4, "tab\there"), (5, None), (6, "﻿bom"), (7, "del\x7f"), (8, "j‍w⁠")]
HIDDEN_MORE = ('part', ['p_partkey + 1000', "translate(p_name, ' ', '\u200b')"], "select p_partkey + 1000, replace(p_name, ' ', chr(8203)) from part")
HIDDEN_SQL = also(HIDDEN, 'id, s', HIDDEN_MORE)
SHOWN_SQL = "s"
for _code, _label in cells.INVISIBLE.items():
    SHOWN_SQL = f"replace({SHOWN_SQL}, chr({_code}), '⟦{_label}⟧')"
SHOWN_SQL = f"replace(replace({SHOWN_SQL}, chr(9), '⟦U+0009⟧'), chr(127), '⟦U+007F⟧')"


@query(f"select id, coalesce({SHOWN_SQL}, '') <> coalesce(s, '') as hidden, coalesce({SHOWN_SQL}, '') as shown from {HIDDEN_SQL}")
def invisible_characters(spark, folder):
    return joined(spark, folder, HIDDEN, "id int, s string", HIDDEN_MORE).select("id", cells.has_invisible(C("s")).alias("hidden"), cells.show_invisible(C("s")).alias("shown"))


TIMES = [(1, "2024-03-01 10:20:30"), (2, "2024-03-01T10:20:30Z"), (3, "2024-03-01T10:20:30.250+09:00"), (4, "2024-03-01"), (5, None), (6, "soon"), (7, "2024-03-01T10:20:30")]
TIMES_MORE = ('orders', ['o_orderkey + 1000', "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')"], "select o_orderkey + 1000, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') from orders")
TIMES_SQL = also(TIMES, 'id, s', TIMES_MORE)


@query(f"select id, case when regexp_matches(s, '^[0-9-]+ [0-9:]+$') then epoch_ms(cast(s as timestamp)) when regexp_matches(s, 'Z$') then epoch_ms(cast(replace(s, 'Z', '') as timestamp)) when regexp_matches(s, '[+]09:00$') then epoch_ms(cast(replace(s, '+09:00', '') as timestamp)) - 32400000 else 0 end as ms from {TIMES_SQL}")
def upload_times(spark, folder):
    return joined(spark, folder, TIMES, "id int, s string", TIMES_MORE).select("id", cells.timestamp_ms(C("s")).alias("ms"))


TYPES = [(i, t, s) for i, (t, s) in enumerate([("VARCHAR", "20"), ("varchar(30)", None), ("char（8）", None), ("Integer", None), ("int(11)", "5"), ("BIGINT", ""), ("decimal", None), ("numeric(8，2)", None), ("bool", None), ("date", "3"), ("datetime", "6"), ("timestamp", None), ("text", None), ("json", "9"), ("double", None), ("float", "7"), ("blob", None), ("geometry", None), ("enum", "'a'"), (None, None), (" ", "40")])]
TYPES_MORE = ('part', ['p_partkey + 1000', 'p_type', 'cast(p_size as string)'], 'select p_partkey + 1000, p_type, cast(p_size as varchar) from part')
TYPES_SQL = also(TYPES, 'id, t, s', TYPES_MORE)
NORM_SQL = "select id, nullif(lower(trim(split_part(raw, '(', 1))), '') as t, coalesce(nullif(trim(coalesce(s, '')), ''), case when raw <> '' and contains(raw, '(') then nullif(trim(rtrim(substr(raw, strpos(raw, '(') + 1), ')')), '') end) as s from (select id, s, replace(replace(replace(trim(coalesce(t, '')), '（', '('), '）', ')'), '，', ',') as raw from {0})"


@query(f"""with n as ({NORM_SQL.format(TYPES_SQL)}), d as (select id, coalesce(t, 'varchar') as t, s, case when s is null then '' else '(' || s || ')' end as p from n)
select id, case when t in ('varchar', 'char') then t || '(' || coalesce(s, '255') || ') CHARACTER SET utf8mb4 COLLATE utf8mb4_bin' when t = 'integer' then 'int' || p when t in ('date', 'longtext', 'mediumtext', 'blob', 'json') then t when t in ('decimal', 'numeric') then 'decimal(' || coalesce(s, '10,2') || ')' when t in ('bool', 'boolean') then 'tinyint(1)' else t || p end as mysql,
case when t = 'varchar' then 'VARCHAR2(' || coalesce(s, '255') || ')' when t = 'char' then 'CHAR(' || coalesce(s, '1') || ')' when t in ('tinyint', 'smallint', 'int', 'integer', 'bigint') then 'NUMBER' || p when t = 'date' then 'DATE' when t in ('datetime', 'timestamp') then 'TIMESTAMP' || p when t in ('text', 'mediumtext', 'longtext', 'json') then 'CLOB'
when t in ('decimal', 'numeric') then 'NUMBER(' || coalesce(s, '10,2') || ')' when t = 'float' then 'FLOAT' || p when t = 'double' then 'BINARY_DOUBLE' when t in ('boolean', 'bool') then 'NUMBER(1)' when t = 'blob' then 'BLOB' else upper(t) || p end as oracle from d""")
def type_maps(spark, folder):
    x = cells.type_and_size(C("t"), C("s"))
    return joined(spark, folder, TYPES, "id int, t string, s string", TYPES_MORE).select("id", cells.mysql_type(x).alias("mysql"), cells.oracle_type(x).alias("oracle"))


NAMES = [(1, "Order Items"), (2, "order_detail"), (3, "customers"), (4, "Invoice-Line"), (5, "odr"), (6, ""), (7, "shipping/address")]
NAMES_MORE = ('part', ['p_partkey + 1000', 'p_name'], 'select p_partkey + 1000, p_name from part')
NAMES_SQL = also(NAMES, 'id, name', NAMES_MORE)
QUERIES_ = ["order", "custmers", "ordit", "od", "shipadr", "Order-Items"]
EDITS = {"order": 3, "custmers": 4, "ordit": 3, "od": 1, "shipadr": 3, "orderitems": 4}


def _fuzzy_sql(q: str) -> str:
    k = q.lower().replace("-", "")
    n = r"regexp_replace(lower(name), '[\s_\-./\\]+', '', 'g')"
    tokens = r"list_filter(regexp_split_to_array(lower(name), '[\s_\-./\\]+'), lambda x: x <> '')"
    sub = f" or regexp_matches({n}, '{'.*'.join(k)}')" if len(k) >= 3 else ""
    return f"select id, '{q}' as query from {NAMES_SQL} where {n} <> '' and (contains({n}, '{k}'){sub} or len(list_filter({tokens}, lambda x: contains(x, '{k}') or levenshtein(x, '{k}') <= {EDITS[k]})) > 0 or levenshtein(substr({n}, 1, {len(k)}), '{k}') <= {EDITS[k]})"


@query(" union all ".join(map(_fuzzy_sql, QUERIES_)))
def fuzzy_tables(spark, folder):
    df = joined(spark, folder, NAMES, "id int, name string", NAMES_MORE)
    out = [df.where(text.fuzzy_match(C("name"), q)).select("id", F.lit(q).alias("query")) for q in QUERIES_]
    for x in out[1:]:
        out[0] = out[0].unionByName(x)
    return out[0]


@query(f"""select id, 'INSERT INTO `shop`.`t` (`t`, `i`) VALUES (' || coalesce('''' || replace(replace(t, '''', ''''''), chr(92), chr(92) || chr(92)) || '''', 'NULL') || ', ' || coalesce(cast(i as varchar), 'NULL') || ');' as insert_sql,
'UPDATE "t" SET "d" = ' || {NUMBER_SQL} || ' WHERE "id" = ' || id || ';' as update_sql, 'DELETE FROM `t` WHERE `id` = ? AND `i` = ?;' as delete_sql, 'SELECT `id`, `t` FROM `t` LIMIT 5;' as select_sql from {TYPED_SQL}""")
def dml_statements(spark, folder):
    df = typed(spark, folder)
    return df.select(
        "id",
        statements.insert_statement(df, "t", ["t", "i"], "mysql", "shop").alias("insert_sql"),
        statements.update_statement(df, "t", ["d"], ["id"], "postgres").alias("update_sql"),
        statements.delete_statement(None, "t", ["id", "i"]).alias("delete_sql"),
        F.lit(statements.select_statement("t", ["id", "t"], limit=5)).alias("select_sql"),
    )


FILES = [(1, "file10.csv"), (2, "file2.csv"), (3, "File1.csv"), (4, "a 7"), (5, "a 07b"), (6, "a 70"), (7, "　x\ty z")]
FILES_MORE = ('customer', ['c_custkey + 1000', 'c_name'], 'select c_custkey + 1000, c_name from customer')
FILES_SQL = also(FILES, 'id, name', FILES_MORE)


@query(f"""select id, row_number() over (order by case when id = 7 then 'z' else lower(regexp_replace(name, '[0-9].*$', '')) end, try_cast(regexp_extract(name, '[0-9]+') as int), lower(regexp_replace(name, '^[^0-9]*[0-9]+', ''))) as place, replace(replace(replace(name, ' ', '·'), '　', '□'), chr(9), '⇥') as shown from {FILES_SQL}""")
def natural_order(spark, folder):
    from pyspark.sql import Window as W

    df = joined(spark, folder, FILES, "id int, name string", FILES_MORE)
    return df.select("id", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(text.natural_key(C("name")))).alias("place"), text.show_whitespace(C("name")).alias("shown"))


ENUMS = [(1, "order status", "in-progress"), (2, "2nd.type", "3 days"), (3, "_", "***"), (4, "AlreadyPascal", "A__b")]
ENUMS_MORE = ('part', ['p_partkey + 1000', 'p_name', 'p_type'], 'select p_partkey + 1000, p_name, p_type from part')
ENUMS_SQL = also(ENUMS, 'id, cls, name', ENUMS_MORE)


@query(f"""select id, case when n = '' then 'UNKNOWN' when regexp_matches(n, '^[0-9]') then '_' || n else n end as constant, case when k = '' then 'UnknownEnum' when regexp_matches(k, '^[0-9]') then '_' || k else k end as class
from (select id, trim(regexp_replace(upper(trim(name)), '[^A-Z0-9]+', '_', 'g'), '_') as n, list_aggregate(list_transform(list_filter(regexp_split_to_array(trim(cls), '[ _.-]+'), lambda x: x <> ''), lambda x: upper(x[1]) || substr(x, 2)), 'string_agg', '') as k from (select id, cls, name from {ENUMS_SQL})) where id <> 3
union all select 3, 'UNKNOWN', 'UnknownEnum'""")
def enum_identifiers(spark, folder):
    return joined(spark, folder, ENUMS, "id int, cls string, name string", ENUMS_MORE).select("id", text.constant_name(C("name")).alias("constant"), text.class_name(C("cls")).alias("class"))
