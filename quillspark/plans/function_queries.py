"""Queries of scalar functions, filters, exports, profiles and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions import cells, text
from quillspark.operators import paging, profile, visibility
from quillspark.plans.registry import query, table

C = F.col


@query("select p_partkey, regexp_replace(lower(trim(p_name)), '\\s+', '_', 'g') as name, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(p_type, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_+', '_', 'g'), '^_|_$', '', 'g') as physical, regexp_matches(p_name, '^[A-Za-z0-9_]+$') as safe from part")
def normalize_names(spark, folder):
    return table(spark, folder, "part").select("p_partkey", text.normalize_name(C("p_name")).alias("name"), text.physical_name(C("p_type")).alias("physical"), text.is_safe_identifier(C("p_name")).alias("safe"))


@query("""select c_custkey, 'INSERT INTO query_result (c_name, c_mktsegment) VALUES (''' || replace(c_name, '''', '''''') || ''', ''' || replace(c_mktsegment, '''', '''''') || ''');' as line from customer""")
def export_insert_lines(spark, folder):
    values = F.concat_ws(", ", text.sql_literal(C("c_name")), text.sql_literal(C("c_mktsegment")))
    return table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("INSERT INTO query_result (c_name, c_mktsegment) VALUES ("), values, F.lit(");")).alias("line"))


@query("""select event_id, cast(user_id as varchar) || ',' || event_type || ',' || case when props is null then '' when regexp_matches(props, '[,"\n]') then '"' || replace(props, '"', '""') || '"' else props end as line from events""")
def export_csv_lines(spark, folder):
    return table(spark, folder, "events").select("event_id", F.concat_ws(",", text.csv_cell(C("user_id")), text.csv_cell(C("event_type")), text.csv_cell(C("props"))).alias("line"))


@query("select n_nationkey, '| ' || cast(n_nationkey as varchar) || ' | ' || replace(n_name, '|', '\\|') || ' |' as line from nation")
def export_markdown_lines(spark, folder):
    return table(spark, folder, "nation").select("n_nationkey", F.concat(F.lit("| "), text.markdown_cell(C("n_nationkey")), F.lit(" | "), text.markdown_cell(C("n_name")), F.lit(" |")).alias("line"))


@query("""select '{"r_regionkey":' || cast(r_regionkey as varchar) || ',"r_name":"' || r_name || '"}' as line from region""")
def export_json_lines(spark, folder):
    return table(spark, folder, "region").select(F.to_json(F.struct("r_regionkey", "r_name")).alias("line"))


@query("select cast(n_nationkey as varchar) || chr(9) || n_name as line from nation")
def export_tsv_lines(spark, folder):
    return table(spark, folder, "nation").select(F.concat_ws("\t", C("n_nationkey").cast("string"), "n_name").alias("line"))


@query("select r_regionkey, (i - 1) // 10 as batch, count(*) as n_rows, string_agg('(' || cast(n_nationkey as varchar) || ', ''' || n_name || ''')', ', ' order by n_nationkey) as tuples from (select n_regionkey as r_regionkey, n_nationkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation) group by r_regionkey, batch")
def export_insert_batches(spark, folder):
    rows = table(spark, folder, "nation").withColumn("i", F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")))
    return profile.insert_batches(rows, "n_regionkey", "i", "n_nationkey", {"n_nationkey": False, "n_name": True}, 10).withColumnRenamed("n_regionkey", "r_regionkey")


@query("select event_id from events where contains(lower(cast(event_id as varchar)), '7') or contains(lower(event_type), '7') or contains(lower(cast(user_id as varchar)), '7')")
def text_filter_any_cell(spark, folder):
    rows = table(spark, folder, "events")
    return rows.where(profile.any_cell_contains(["event_id", "event_type", "user_id"], "7")).select("event_id")


@query("select event_type, case when value is null then 'null' when value = floor(value) then 'integer' else 'number' end as kind, count(*) as n from events group by all")
def observed_kinds(spark, folder):
    return table(spark, folder, "events").groupBy("event_type", text.observed_kind(C("value"), "double").alias("kind")).agg(F.count("*").alias("n"))


@query("""select 'c_name' as column_name, count(*) as n_rows, sum(case when c_name is null then 1 else 0 end) as n_null, max(length(trim(c_name))) as max_length, 'text' as kinds from customer
union all select 'c_custkey', count(*), sum(case when c_custkey is null then 1 else 0 end), max(length(cast(c_custkey as varchar))), 'integer' from customer
union all select 'c_mktsegment', count(*), sum(case when c_mktsegment is null then 1 else 0 end), max(length(trim(c_mktsegment))), 'text' from customer""")
def value_profile(spark, folder):
    return profile.value_profile(table(spark, folder, "customer"), ["c_name", "c_custkey", "c_mktsegment"])


@query("""select 'c_custkey' as column_name, 'integer' as kind, max(length(cast(c_custkey as varchar))) as max_length, 'int' as sql_type from customer
union all select 'c_name', 'text', max(length(c_name)), 'varchar(' || cast(least(255, cast(ceil(1.2 * max(length(c_name))) as bigint)) as varchar) || ')' from customer
union all select 'c_mktsegment', 'text', max(length(c_mktsegment)), 'varchar(' || cast(least(255, cast(ceil(1.2 * max(length(c_mktsegment))) as bigint)) as varchar) || ')' from customer""")
def csv_kind_inference(spark, folder):
    rows = profile.column_kinds(table(spark, folder, "customer"), ["c_custkey", "c_name", "c_mktsegment"])
    return rows.withColumn("sql_type", cells.type_of_kind(C("kind"), C("max_length")))


@query("""select 'SELECT * FROM ' || event_type || ' WHERE user_id = ?' as pattern, count(*) as n, max(ts) as last_seen from events group by event_type""")
def pattern_frequency(spark, folder):
    rows = table(spark, folder, "events").select(F.concat(F.lit("SELECT  * FROM "), "event_type", F.lit(" WHERE user_id = "), "user_id").alias("q"), "ts")
    return rows.groupBy(text.sql_pattern(C("q")).alias("pattern")).agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))


@query("select pattern, n from (select event_type as pattern, count(*) as n, max(ts) as last_seen from events group by event_type) order by n desc, last_seen desc, pattern limit 3")
def top_patterns(spark, folder):
    rows = table(spark, folder, "events").groupBy(C("event_type").alias("pattern")).agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    return rows.orderBy(C("n").desc(), C("last_seen").desc(), "pattern").limit(3).select("pattern", "n")


@query("select conv_id, count(*) as n_statements, sum(case when role = 'user' then 1 else 0 end) as n_failed, min(case when role = 'user' then turn end) as first_failed, case when bool_and(role = 'user') then 'failed' when bool_or(role = 'user') then 'partial' else 'success' end as status from conversations group by conv_id")
def history_rollup(spark, folder):
    return profile.run_rollup(table(spark, folder, "conversations").select("conv_id", "turn", (C("role") == "user").alias("failed")), "conv_id", "turn", "failed")


@query("select c_custkey, version_number, version_count from (select c_custkey, row_number() over (partition by c_mktsegment, c_nationkey order by c_acctbal, c_custkey) as version_number, count(*) over (partition by c_mktsegment, c_nationkey) as version_count from customer)")
def file_version_rank(spark, folder):
    rows = table(spark, folder, "customer").withColumn("name", F.concat_ws("/", "c_mktsegment", "c_nationkey"))
    return paging.numbered_versions(rows, "name", ["c_acctbal", "c_custkey"]).select("c_custkey", "version_number", "version_count")


@query("select o_orderkey, o_custkey from (select * from orders order by o_orderdate, o_orderkey limit 1001 offset 500)")
def page_wrapper(spark, folder):
    return paging.page_frame(table(spark, folder, "orders"), ["o_orderdate", "o_orderkey"], 1000, 500).select("o_orderkey", "o_custkey")


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey desc) as r, o_orderpriority from orders) where r <= 500 or o_orderpriority = '1-URGENT'")
def row_window_trim(spark, folder):
    orders = table(spark, folder, "orders")
    return paging.newest(orders, ["o_orderdate", "o_orderkey"], 500, orders.where("o_orderpriority = '1-URGENT'"), ["o_orderkey"]).select("o_orderkey")


@query("select s_suppkey, c_custkey from (select s_suppkey, c_custkey, row_number() over (partition by s_suppkey order by c_custkey) r from supplier join customer on s_nationkey = c_nationkey) where r = 1")
def exact_pairing_first(spark, folder):
    first = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    return table(spark, folder, "supplier").join(first, C("s_nationkey") == C("c_nationkey")).select("s_suppkey", "c_custkey")


@query("select s_suppkey, c_custkey from (select s_suppkey, s_nationkey, row_number() over (partition by s_nationkey order by s_suppkey) i from supplier) a join (select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) j from customer) b on s_nationkey = c_nationkey and i = j")
def exact_pairing_rownum(spark, folder):
    return profile.pair_in_turn(table(spark, folder, "supplier"), table(spark, folder, "customer"), "s_nationkey", "c_nationkey", "s_suppkey", "c_custkey").select("s_suppkey", "c_custkey")


@query("select a.n_name as a, b.n_name as b, levenshtein(lower(a.n_name), lower(b.n_name)) as edits from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey where levenshtein(lower(a.n_name), lower(b.n_name)) <= 5")
def fuzzy_names(spark, folder):
    n = table(spark, folder, "nation")
    a, b = n.alias("a"), n.alias("b")
    edits = F.levenshtein(F.lower("a.n_name"), F.lower("b.n_name"))
    return a.join(b, (C("a.n_regionkey") == C("b.n_regionkey")) & (C("a.n_nationkey") < C("b.n_nationkey"))).where(edits <= 5).select(C("a.n_name").alias("a"), C("b.n_name").alias("b"), edits.alias("edits"))


@query("select distinct p_brand from part where contains(replace(replace(lower(p_brand), '#', ''), ' ', ''), 'brand1') or levenshtein(lower(p_brand), 'brand#1') <= 1")
def fuzzy_search(spark, folder):
    c = F.regexp_replace(text.search_key(C("p_brand")), "#", "")
    hit = c.contains("brand1") | (F.levenshtein(F.lower("p_brand"), F.lit("brand#1")) <= 1)
    return table(spark, folder, "part").where(hit).select("p_brand").distinct()


DICE = """with names as (select n_nationkey as k, n_regionkey as r, regexp_replace(lower(trim(n_name)), '\\s+', '_', 'g') as x from nation),
grams as (select k, g, count(*) as c from (select k, substr(x, cast(i as bigint), 2) as g from (select k, x, unnest(range(1, length(x))) as i from names)) group by k, g),
sizes as (select k, sum(c) as n from grams group by k)
select a.k as a, b.k as b, cast(round(coalesce(2.0 * (select sum(least(g.c, h.c)) from grams g join grams h on g.g = h.g where g.k = a.k and h.k = b.k), 0) / (sa.n + sb.n), 6) as double) as score
from names a join names b on a.r = b.r and a.k < b.k join sizes sa on sa.k = a.k join sizes sb on sb.k = b.k"""


@query(DICE)
def bigram_dice(spark, folder):
    n = table(spark, folder, "nation")
    x, y = (n.select(C("n_nationkey").alias(k), C("n_name").alias(f"{k}_name"), C("n_regionkey").alias("r")) for k in "ab")
    return x.join(y, "r").where("a < b").select("a", "b", F.round(text.dice(C("a_name"), C("b_name")), 6).alias("score"))


@query("""with s as (select distinct o_custkey as k, o_orderpriority as p from orders), n as (select k, count(*) as c from s group by k),
i as (select a.k as a, b.k as b, count(*) as c from s a join s b on a.p = b.p and b.k = a.k + 1 group by a.k, b.k)
select a, b, cast(round(i.c / cast(x.c + y.c - i.c as double), 6) as double) as score from i join n x on x.k = a join n y on y.k = b""")
def jaccard_sets(spark, folder):
    sets = table(spark, folder, "orders").groupBy(C("o_custkey").alias("k")).agg(F.collect_set("o_orderpriority").alias("p"))
    pairs = sets.select(C("k").alias("a"), C("p").alias("x")).join(sets.select(C("k").alias("b"), C("p").alias("y")), C("b") == C("a") + 1)
    return pairs.withColumn("score", F.round(text.jaccard(C("x"), C("y")), 6)).where("score > 0").select("a", "b", "score")


@query(r"""select doc_id, case when one = '' or one is null then '(empty SQL)' when length(one) <= 40 then one else rtrim(substr(one, 1, 37)) || '...' end as summary from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as one from documents)""")
def shorten_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.shortened(C("text"), 40).alias("summary"))


@query("select doc_id, sha256(text) as digest from documents")
def content_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("select min(doc_id) as doc_id, sha256(text) as digest from documents group by digest")
def import_dedupe(spark, folder):
    """Content-hash dedupe: of equal contents the first record is returned."""
    return table(spark, folder, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"))


@query("select p_partkey, case when p_size <= 10 then 'breaking' when p_size <= 30 then 'non_breaking' else 'metadata' end as impact from part")
def impact_classes(spark, folder):
    fields = F.when(C("p_size") <= 10, F.array(F.lit("dataType"))).when(C("p_size") <= 30, F.array(F.lit("logicalName"))).otherwise(F.array(F.lit("comment")))
    return table(spark, folder, "part").select("p_partkey", visibility.column_impact(F.lit("modified"), fields).alias("impact"))


@query("select p_brand, sum(case when p_size <= 10 then 1 else 0 end) as n_breaking, sum(case when p_size > 10 and p_size <= 30 then 1 else 0 end) as n_non_breaking, sum(case when p_size > 30 then 1 else 0 end) as n_metadata from part group by p_brand")
def impact_groups(spark, folder):
    return impact_classes(spark, folder).join(table(spark, folder, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(*(F.count_if(C("impact") == k).alias(f"n_{k}") for k in ("breaking", "non_breaking", "metadata")))


FNV = "list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(range(1, length(p_name) + 1), lambda i: cast(ascii(substr(p_name, i, 1)) as bigint))), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
PHYSICAL = r"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g')), '_+', '_', 'g'), '^_|_$', '', 'g')"


@query(f"""select p_partkey, substr(lpad(lower(to_hex({FNV})), 8, '0'), 1, 6) as hash, case when length({PHYSICAL}) > 12 then substr({PHYSICAL}, 1, 5) || '_' || substr(lpad(lower(to_hex({FNV.replace('p_name', '(' + PHYSICAL + ')')})), 8, '0'), 1, 6) else {PHYSICAL} end as name from part""")
def short_hashes(spark, folder):
    return table(spark, folder, "part").select("p_partkey", text.short_hash(C("p_name")).alias("hash"), text.clamp_name(text.physical_name(C("p_name")), 12).alias("name"))
