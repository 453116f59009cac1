"""Queries of lists and line diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import linediff, visibility
from quillspark.plans.diff_queries import COMPARE, VERSIONS, compared
from quillspark.plans.registry import query, table, values_sql

C = F.col


@query(VERSIONS + """select o_orderkey, status, case when status = 'value_changed' then array_to_string(list_filter([case when s_priority is distinct from t_priority then 'o_orderpriority=' || coalesce(s_priority, '-') || '>' || coalesce(t_priority, '-') end, case when s_status is distinct from t_status then 'o_orderstatus=' || coalesce(s_status, '-') || '>' || coalesce(t_status, '-') end], lambda x: x is not null), ',')
else 'o_orderpriority=' || coalesce(s_priority, '-') || '>' || coalesce(t_priority, '-') || ',o_orderstatus=' || coalesce(s_status, '-') || '>' || coalesce(t_status, '-') end as fields from cmp where status <> 'unchanged'""")
def structured_rows(spark, folder):
    rows = visibility.row_entries(compared(spark, folder), COMPARE)
    show = F.transform("fields", lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["source_value"], F.lit("-")), F.lit(">"), F.coalesce(x["target_value"], F.lit("-"))))
    return rows.select("o_orderkey", "status", F.array_join(show, ",").alias("fields"))


LISTED = [(1, "受注", "orders", "AA"), (2, "", "brands", "B"), (3, "Customers", "cust", None), (4, "apples", "orders_old", "Z"), (5, None, "zebra", "A")]
LISTED_SQL = values_sql(LISTED, "place, logical, physical, letters")


@query(f"""select 'name' as sort, place, row_number() over (order by coalesce(nullif(logical, ''), physical), place) as i from {LISTED_SQL} union all select 'column', place, row_number() over (order by case letters when 'A' then 1 when 'B' then 2 when 'Z' then 26 when 'AA' then 27 else 0 end, place) from {LISTED_SQL}
union all select 'source', place, row_number() over (order by place) from {LISTED_SQL} where contains(lower(coalesce(logical, '')), 'order') or contains(lower(physical), 'order')""")
def listed_tables(spark, folder):
    df = spark.createDataFrame(LISTED, "place int, logical string, physical string, excel_column string")
    made = {"name": visibility.listed_tables(df, sort="name"), "column": visibility.listed_tables(df, sort="column"), "source": visibility.listed_tables(df, "ORDER")}
    rows = [(k, r["place"], i + 1) for k, x in made.items() for i, r in enumerate(x.collect())]  # lists of five rows
    return spark.createDataFrame(rows, "sort string, place int, i int")


SAME = [(1, " a  b ", "a b"), (2, None, ""), (3, "x", "X"), (4, "varchar( 20 )", "varchar(20)"), (5, "-", None), (6, "a\n b", "a b")]


@query(rf"select id, regexp_replace(coalesce(nullif(trim(a), ''), '-'), '\s+', ' ', 'g') = regexp_replace(coalesce(nullif(trim(b), ''), '-'), '\s+', ' ', 'g') as same, coalesce(nullif(trim(a), ''), '-') as shown from (select * from {values_sql(SAME, 'id, a, b')} union all select p_partkey + 1000, p_name, case when p_partkey % 2 = 0 then replace(p_name, ' ', '  ') else p_type end from part)")
def shown_values(spark, folder):
    parts = table(spark, folder, "part").select((C("p_partkey") + 1000).cast("int").alias("id"), C("p_name").alias("a"), F.when(C("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("  "))).otherwise(C("p_type")).alias("b"))
    return spark.createDataFrame(SAME, "id int, a string, b string").unionByName(parts).select("id", visibility.semantically_equal(C("a"), C("b")).alias("same"), visibility.shown(C("a")).alias("shown"))


A = "\n".join(f"line {i}" for i in range(30))
B = A.replace("line 5\n", "").replace("line 14\n", "line fourteen\n").replace("line 15\n", "line 15\nnew\n")
PAIRS = [(1, A, B), (2, A, A), (3, "x\ny", "x\ny"), (4, "", "a\nb"), (5, None, None)]


def pairs(spark):
    return spark.createDataFrame(PAIRS, "id int, old_text string, new_text string")


@query("select unnest([1, 4]) as id, unnest([2, 2]) as added, unnest([2, 0]) as removed union all select unnest([2, 3]), 0, 0")
def diff_line_stats(spark, folder):
    return visibility.diff_stats(linediff.line_diff(pairs(spark)))


HUNKS = [(1, 0, True, 0, 1), (1, 1, False, 2, 8), (1, 2, True, 9, 10), (1, 3, False, 11, 20), (1, 4, True, 21, 31), (2, 0, False, 0, 2), (2, 1, True, 3, 26), (2, 2, False, 27, 29), (3, 0, False, 0, 1), (4, 0, False, 0, 1)]


@query(f"select id, cast(hunk as bigint) as hunk, collapsed, a as first_line, b as last_line from {values_sql(HUNKS, 'id, hunk, collapsed, a, b')}")
def diff_hunks(spark, folder):
    rows = visibility.hunks(linediff.line_diff(pairs(spark)))
    return rows.groupBy("id", "hunk").agg(F.first("collapsed").alias("collapsed"), F.min("place").alias("first_line"), F.max("place").alias("last_line"))


@query("select doc_id as id, 0 as added, 0 as removed from documents where coalesce(text, '') <> ''")
def unchanged_line_diffs(spark, folder):
    docs = table(spark, folder, "documents")
    return visibility.diff_stats(linediff.line_diff(docs.select(C("doc_id").alias("id"), C("text").alias("old_text"), C("text").alias("new_text"))))


LINES = r"""(select doc_id as id, case when coalesce(text, '') = '' then [] else string_split(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n$', ''), chr(10)) end as x from documents)"""
#: Lines of texts and of edited texts: some dropped, changed and doubled.
EDITED = f"""(select id, x, flatten(list_transform(range(1, len(x) + 1), lambda i: case when i % 5 = 2 then [] when i % 7 = 3 then [x[i] || '!'] when i % 11 = 4 then [x[i], x[i]] else [x[i]] end)) as y from {LINES})"""
#: The longest common subsequence, row by row.
LCS = """list_reduce(list_prepend([0], list_transform(range(1, len(x) + 1), lambda i: [i])) , lambda row, i: list_reduce(list_prepend([0], list_transform(range(1, len(y) + 1), lambda j: [j])), lambda made, j:
    list_append(made, case when x[i[1]] = y[j[1]] then (case when i[1] = 1 then 0 else row[j[1]] end) + 1 else greatest(case when i[1] = 1 then 0 else row[j[1] + 1] end, made[len(made)]) end)))"""


@query(f"select id, len(y) - kept as added, len(x) - kept as removed from (select id, x, y, case when len(y) = 0 then 0 else {LCS}[len(y) + 1] end as kept from {EDITED})")
def edited_line_diffs(spark, folder):
    """Documents against edited texts: as many lines stay as a longest common subsequence has."""
    edit = F.flatten(F.transform("x", lambda x, i: F.when((i + 1) % 5 == 2, F.array().cast("array<string>")).when((i + 1) % 7 == 3, F.array(F.concat(x, F.lit("!")))).when((i + 1) % 11 == 4, F.array(x, x)).otherwise(F.array(x))))
    rows = table(spark, folder, "documents").select(C("doc_id").alias("id"), "text", linediff.lines_of(C("text")).alias("x")).withColumn("y", edit)
    diffs = linediff.line_diff(rows.select("id", C("text").alias("old_text"), joined(C("y")).alias("new_text")))
    return rows.select("id").join(visibility.diff_stats(diffs), "id", "left").fillna(0)


def joined(lines):
    """Lines as a text whose last line is ended."""
    return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


@query(f"select id, cast(count_if(c) as bigint) as changes, cast(count_if(shown) as bigint) as shown_lines from (select id, c, max(c::int) over (partition by id order by i rows between 3 preceding and 3 following) = 1 as shown from (select id, unnest(range(1, len(x) + 1)) as i, i % 13 = 6 as c from {LINES})) group by id having count_if(c) > 0")
def changed_line_hunks(spark, folder):
    """Of numbered lines with every thirteenth removed: changes, and the lines near them, which aren't collapsed."""
    numbered = F.transform(linediff.lines_of(C("text")), lambda x, i: F.concat_ws(":", i, x))
    lines = table(spark, folder, "documents").select(C("doc_id").alias("id"), numbered.alias("x")).withColumn("y", F.filter("x", lambda x, i: (i + 1) % 13 != 6))
    rows = lines.select("id", joined(C("x")).alias("old_text"), joined(C("y")).alias("new_text"))
    found = visibility.hunks(linediff.line_diff(rows)).groupBy("id").agg(F.count_if(C("type") != "unchanged").alias("changes"), F.count_if(~C("collapsed")).alias("shown_lines"))
    return found.where("changes > 0")
