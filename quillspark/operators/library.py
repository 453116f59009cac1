"""What a workbench remembers: runs, recent statements, snippets, suggestions, patterns and profiles; searches over them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text

#: How many entries of each kind are kept, and rows of a batch that profiles look at.
RECENT, HISTORY, SNIPPETS, SUGGESTIONS, PATTERNS, PROFILES, SAMPLED = 30, 40, 50, 120, 80, 96, 50


def same_sql(c: Column) -> Column:
    """Statements that differ in case and white space only are one."""
    return F.lower(text.one_line(c))


def recent(runs: DataFrame, sql: str, at: str, keep: int = RECENT) -> DataFrame:
    """The latest run of each statement (trimmed), newest first; blank statements aren't remembered."""
    rows = runs.withColumn("_key", same_sql(F.col(sql))).where("_key != ''")
    last = rows.groupBy("_key").agg(F.max_by(F.trim(sql), at).alias(sql), F.max(at).alias(at)).drop("_key")
    return last.orderBy(F.col(at).desc(), sql).limit(keep)


def newest(df: DataFrame, at: str, tie: str, keep: int) -> DataFrame:
    return df.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(keep)


def saved(snippets: DataFrame, at: str = "updated_at", keep: int = SNIPPETS) -> DataFrame:
    """name, sql and updated_at of the latest version of each snippet, whatever the case of its name; those without a name or
    statement aren't kept."""
    rows = snippets.withColumn("_key", F.lower(F.trim("name"))).where("_key != '' and trim(sql) != ''")
    last = rows.groupBy("_key").agg(F.max_by(F.struct(F.trim("name").alias("name"), F.trim("sql").alias("sql"), F.col(at).alias(at)), at).alias("x")).select("x.*")
    return newest(last, at, "name", keep)


def entries(snippets: DataFrame, history: DataFrame, recents: DataFrame) -> DataFrame:
    """One list to search: kind, id, title, sql, summary, searchable and updated_at. Recent statements are in it only while there
    is no history."""
    low = lambda *c: F.lower(F.trim(F.concat_ws("\n", *(F.coalesce(x, F.lit("")) for x in c))))
    col = F.col
    a = snippets.select(F.lit("snippet").alias("kind"), "id", col("name").alias("title"), "sql", low(col("name"), col("sql")).alias("searchable"), "updated_at")
    title = F.when(col("mode") == "script", "Script run").otherwise("Statement run")
    b = history.select(F.lit("history").alias("kind"), "id", title.alias("title"), "sql", low(col("sql"), col("status"), col("mode"), col("error_message")).alias("searchable"), col("executed_at").alias("updated_at"))
    none = history.agg((F.count("*") == 0).alias("_none"))
    c = recents.crossJoin(F.broadcast(none)).where("_none")
    c = c.select(F.lit("recent").alias("kind"), "id", F.concat(F.lit("Recent query "), (col("id") + 1).cast("string")).alias("title"), "sql", low(col("sql")).alias("searchable"), F.lit(None).cast("timestamp").alias("updated_at"))
    return a.unionByName(b).unionByName(c).withColumn("summary", text.shortened(col("sql")))


def found(listed: DataFrame, query: str) -> DataFrame:
    q = query.strip().lower()
    return listed.where(F.col("searchable").contains(q)) if q else listed


def run_status(statements: DataFrame, run: str, place: str) -> DataFrame:
    """Statements of a run (error or null, returned, affected, elapsed_ms) as one entry: its status, sums, which failed first and
    with what."""
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    first = F.min(F.when(failed, F.struct(place, "error")))
    return statements.groupBy(run).agg(
        F.count("*").alias("n_statements"),
        F.when(~F.bool_or(failed), "success").when(F.bool_and(failed), "failed").otherwise("partial").alias("status"),
        *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("returned", "affected", "elapsed_ms")),
        first[place].alias("first_failed"),
        first["error"].alias("error_message"),
    )


def identifier(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def accepted(events: DataFrame, keep: int = SUGGESTIONS) -> DataFrame:
    """Accepted suggestions (kind, label, schema, relation, column_name, accepted_at) by what they name: key, label, n and the
    last time; the most frequent are kept."""
    key = F.concat_ws("::", *(identifier(F.col(c)) for c in ("kind", "label", "schema", "relation", "column_name")))
    rows = events.where("trim(label) != ''").groupBy(key.alias("key")).agg(F.max_by(F.trim("label"), "accepted_at").alias("label"), F.count("*").alias("n"), F.max("accepted_at").alias("last_at"))
    return rows.orderBy(F.col("n").desc(), F.col("last_at").desc(), "key").limit(keep)


def patterns(runs: DataFrame, sql: str, at: str, keep: int = PATTERNS) -> DataFrame:
    """Statements by schema, kind and pattern: n, the last time, and the keys of the relations and columns they touch."""
    rows = runs.withColumn("kind", text.statement_kind(F.col(sql))).withColumn("pattern", text.sql_pattern(F.col(sql))).where("pattern != ''")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    rows = rows.groupBy("schema", "kind", "pattern").agg(F.count("*").alias("n"), F.max(at).alias("last_at"), union("relation_keys").alias("relation_keys"), union("column_keys").alias("column_keys"))
    return rows.orderBy(F.col("n").desc(), F.col("last_at").desc(), "pattern").limit(keep)


def value_profiles(df: DataFrame, columns: list[str], batch: str, order: str, sampled: int = SAMPLED) -> DataFrame:
    """column_name, n_rows, n_null and kinds (sorted) over the first ``sampled`` rows of each batch: the feature is a sample."""
    kinds = dict(df.dtypes)
    rows = df.withColumn("_i", F.row_number().over(W.partitionBy(batch).orderBy(order))).where(F.col("_i") <= sampled)
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), text.observed_kind(F.col(c), kinds[c]).alias("kind")) for c in columns))
    rows = rows.select(F.inline(each)).groupBy("column_name", "kind").agg(F.count("*").alias("n"))
    return rows.groupBy("column_name").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("kind") == "null", F.col("n"))), F.lit(0)).alias("n_null"), F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"))


def merged_profiles(runs: DataFrame, keep: int = PROFILES) -> DataFrame:
    """Profiles (key, n_rows, n_null, kinds as an array, at) of many runs as one a key: sums, unions, the last time."""
    rows = runs.groupBy("key").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"), F.max("at").alias("last_at"))
    return rows.orderBy(F.col("n_rows").desc(), F.col("last_at").desc(), "key").limit(keep)


def cleared(memory: DataFrame, category: str, categories: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """What is left of a category (acceptedSuggestions, queryPatterns or valueProfiles) after clearing the given categories, of one
    schema or of all. Patterns belong to a schema by their own and by the keys of what they touch."""
    if categories is not None and category not in categories:
        return memory
    s = (schema or "").strip().lower()
    if not s:
        return memory.where("false")
    mine = identifier(F.col("schema")) == s
    if category == "queryPatterns":
        mine = reduce(or_, (F.exists(k, lambda x: x.startswith(f"{s}.")) for k in ("relation_keys", "column_keys")), mine)
    return memory.where(~mine)


#: What suggestions get for how often they, their relation, column, values and schema were used: most, each.
WEIGHTS = {"accepted": (18, 4), "relation": (14, 2), "column": (16, 3), "schema": (10, 2)}
PROFILE_MOST, BUCKET_MOST = 10, 24
CLAUSES = ("where", "having", "group-by", "order-by", "select")


def ranked(items: DataFrame, clause: str) -> DataFrame:
    """``items`` (sort_text, bucket and counts of past use: accepted, relation, column, schema_uses, sampled) with score and rank:
    a smaller bucket, lowered by the score, comes first, then the higher score, then the sort text."""
    use = lambda name, c: F.least(F.lit(WEIGHTS[name][0]), F.coalesce(c, F.lit(0)) * WEIGHTS[name][1])
    profile = F.when(F.col("sampled").isNotNull(), F.least(F.lit(PROFILE_MOST), 2 + F.floor(F.col("sampled") / 8))).otherwise(0) if clause in CLAUSES else F.lit(0)
    score = use("accepted", F.col("accepted")) + use("relation", F.col("relation")) + use("column", F.col("column")) + use("schema", F.col("schema_uses")) + profile
    rows = items.withColumn("score", score.cast("int"))
    bucket = F.greatest(F.lit(0), F.col("bucket") - F.least(F.lit(BUCKET_MOST), F.col("score")))
    rows = rows.withColumn("lowered", bucket)
    # a list of suggestions is of bounded size: one partition ranks it
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("lowered", F.col("score").desc(), "sort_text")))


def matches(value: Column, filter_: str, mode: str) -> Column:
    x = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return x == filter_ if mode == "exact" else x.startswith(filter_) if mode == "starts_with" else x.contains(filter_)


def comment_references(rows: DataFrame, query: str = "", source: str = "", code: str = "", source_mode: str = "exact", code_mode: str = "contains", bare: bool = True) -> DataFrame:
    """Comment rows (sheet, texts of tables and columns, comment, refs: array of source, code, raw and options as text) that match, with matched
    references. Filters of references decide alone where there are any; a query also matches in the texts; ``bare`` keeps rows
    without references."""
    q, s, k = (x.strip().lower() for x in (query, source, code))

    def holds(r: Column) -> Column:
        tests = [F.lit(True)]
        if s:
            tests.append(matches(r["source"], s, source_mode))
        if k:
            tests.append(matches(r["code"], k, code_mode))
        if q:
            tests.append(F.lower(F.concat_ws(" ", r["source"], r["code"], r["raw"], r["options"])).contains(q))
        return reduce(lambda a, b: a & b, tests)

    texts = ["sheet", "table_logical", "table_physical", "logical", "physical", "comment", "comment_raw"]
    out = rows.withColumn("matched", F.filter("refs", holds))
    some = F.size("matched") > 0
    keep = some if s or k else (F.lower(F.concat_ws(" ", *texts)).contains(q) | some) if q else F.lit(bare) | (F.size("refs") > 0)
    return out.where(keep if bare else keep & (F.size("refs") > 0))


def reference_page(matched: DataFrame, order: list[str], most: int = 500, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of matches, and one row with how many there are and if the page cuts them off."""
    total = matched.agg(F.count("*").alias("matched_rows")).withColumn("truncated", F.col("matched_rows") > offset + most)
    return matched.orderBy(*order).offset(offset).limit(most), total


def comment_rows(definitions: DataFrame) -> DataFrame:
    """Columns that have a comment or references, with the texts that searches look at."""
    return definitions.where((F.coalesce("comment_raw", "comment", F.lit("")) != "") | (F.size("refs") > 0))


def catalog_matches(columns: DataFrame, needle: str) -> DataFrame:
    """Columns of a catalog (table_name, table_comment, column_name, type, comment) to show for a filter: all of a table whose own
    text has it, or else those that have it; by_table says which."""
    n = needle.strip().lower()
    has = lambda *c: F.lower(F.concat_ws(" ", *(F.coalesce(x, F.lit("")) for x in c))).contains(n)
    rows = columns.withColumn("by_table", has(F.col("table_name"), F.col("table_comment")))
    return rows.where(F.col("by_table") | has(F.col("column_name"), F.col("type"), F.col("comment")))


def connections(rows: DataFrame, search: str = "", environment: str = "all", favorites: bool = False) -> DataFrame:
    """Connections that pass the filters, with group_name (a mark of its own for none), and their places: groups by name, those
    without last; favourites first within a group, then by name."""
    keep = F.lit(True)
    if favorites:
        keep &= F.coalesce("favorite", F.lit(False))
    if environment != "all":
        keep &= F.col("environment").eqNullSafe(environment)
    if search.strip():
        said = [F.nullif(F.col(c), F.lit("")) for c in ("name", "driver", "host", "database", "username", "group_name", "environment", "default_schema")]
        keep &= F.lower(F.concat_ws(" ", *said)).contains(search.strip().lower())
    named = F.nullif(F.trim("group_name"), F.lit(""))
    shown = rows.where(keep).withColumn("ungrouped", named.isNull()).withColumn("group_name", F.coalesce(named, F.lit("Ungrouped")))
    by = W.partitionBy("group_name").orderBy(F.coalesce("favorite", F.lit(False)).desc(), F.coalesce(F.nullif("name", F.lit("")), "database"))
    return shown.withColumn("place", F.row_number().over(by))
