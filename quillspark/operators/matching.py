"""Matching of tables and columns of two versions of a schema: exactly by name, then by similarity, one to one.

A schema is a frame of column definitions, a row a column: sheet, table_id, table_logical, table_physical, position, logical,
physical, data_type, size, not_null, is_pk, auto_increment and comment. Equal names are joined, whatever the size of a group (the
tables of a sheet, the columns of a table), and only what is left is compared; the names and comments of a table are one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import similarity
from quillspark.shared import settled

DEFINITION = "sheet string, table_id int, table_logical string, table_physical string, position int, logical string, physical string, data_type string, size string, not_null boolean, is_pk boolean, auto_increment boolean, comment string"
#: Least scores of a rename, of a sheet that stands for another, and how many candidates are looked at in full.
RENAME, SHEET, SHORTLIST = 0.65, 0.2, 24
#: Pairs within scopes that are all scored.
PAIRS = 1_000_000
#: Names of changed fields by column of a definition, in the order in which they are listed.
FIELDS = {"logical": "logicalName", "physical": "physicalName", "data_type": "dataType", "size": "size", "not_null": "notNull", "is_pk": "isPk", "auto_increment": "autoIncrement", "comment": "comment"}
FLAGS = ["not_null", "is_pk", "auto_increment"]


def norm(c: Column) -> Column:
    return text.normalize_name(F.coalesce(c, F.lit("")))


def weighted(parts: list[tuple[float, Column]]) -> Column:
    """The sum of weighted scores, rounded so that sums in another order are equal."""
    return F.round(reduce(lambda a, b: a + b, (w * c for w, c in parts)), 9)


def column_score(o: Column, n: Column) -> Column:
    """Of two structs of a definition: names, type and size, constraints and comment."""
    flag = lambda f: F.coalesce(o[f], F.lit(False)) == F.coalesce(n[f], F.lit(False))
    typed = o["data_type"].eqNullSafe(n["data_type"]) & o["size"].eqNullSafe(n["size"])
    return weighted([
        (0.45, text.dice(o["physical"], n["physical"])),
        (0.20, text.dice(o["logical"], n["logical"])),
        (0.20, typed.cast("double")),
        (0.10, (flag("not_null") & flag("is_pk")).cast("double")),
        (0.05, text.dice(o["comment"], n["comment"])),
    ])


def column_scores(old: DataFrame, new: DataFrame, scope: list[str], places: int = 9) -> DataFrame:
    """scope, old_position, new_position and the score of each column of one side with each of the other in its scope, as by
    ``column_score``. What a column is compared by is made once, as sets, and blocks of columns are compared with blocks."""
    def sets(df: DataFrame) -> DataFrame:
        flags = F.struct(*(F.coalesce(f, F.lit(False)).alias(f) for f in ("not_null", "is_pk")))
        parts = [similarity.name_grams(F.col("physical")), similarity.name_grams(F.col("logical")), F.array(F.to_json(F.struct("data_type", "size"))), F.array(F.to_json(flags)), similarity.name_grams(F.col("comment"))]
        return df.select(*scope, F.col("position").alias("key"), F.array(*parts).alias("sets"))

    rows = similarity.block_scores(sets(old), sets(new), scope, [0.45, 0.20, 0.20, 0.10, 0.05], places=[9, places])
    return rows.withColumnsRenamed({"a": "old_position", "b": "new_position"})


def tables_of(definitions: DataFrame) -> DataFrame:
    """sheet, table_id, logical, physical, names (the set of the columns' names) and comments (joined in order)."""
    name = F.coalesce(F.nullif(norm(F.col("physical")), F.lit("")), norm(F.col("logical")))
    each = F.array_sort(F.collect_list(F.struct("position", F.coalesce("comment", F.lit("")).alias("comment"))))
    rows = definitions.groupBy("sheet", "table_id").agg(F.first("table_logical").alias("logical"), F.first("table_physical").alias("physical"), F.collect_set(F.nullif(name, F.lit(""))).alias("names"), each.alias("c"))
    return rows.select("sheet", "table_id", "logical", "physical", "names", F.array_join("c.comment", "|").alias("comments"))


def table_score(o: Column, n: Column) -> Column:
    """Of two structs of ``tables_of``: names, names of columns, and comments."""
    return weighted([
        (0.35, text.dice(o["physical"], n["physical"])),
        (0.25, text.dice(o["logical"], n["logical"])),
        (0.30, text.jaccard(o["names"], n["names"])),
        (0.10, text.dice(o["comments"], n["comments"])),
    ])


def table_scores(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """scope, old_id, new_id and the score of each table of one side with each of the other in its scope, as by ``table_score``. Both
    sides are ``tables_of`` definitions; the bigrams of a table's names and comments are counted once, not for each pair."""
    texts = ["physical", "logical", "comments"]

    def side(df: DataFrame, name: str) -> DataFrame:
        made = df.select(*scope, F.struct(F.col("table_id").alias("id"), "names", *(text.gram_counts(F.col(c)).alias(c) for c in texts)).alias(name))
        return settled(made, "tables")

    o, n = F.col("o"), F.col("n")
    grams = [text.counts_dice(o[c], n[c]) for c in texts]
    score = weighted([(0.35, grams[0]), (0.25, grams[1]), (0.30, text.jaccard(o["names"], n["names"])), (0.10, grams[2])])
    return side(old, "o").join(side(new, "n"), scope).select(*scope, o["id"].alias("old_id"), n["id"].alias("new_id"), score.alias("score"))


def changed_fields(o: Column, n: Column) -> Column:
    """The fields of a column definition that differ; missing flags are false and a missing comment is empty."""
    def same(f: str) -> Column:
        if f in FLAGS:
            return F.coalesce(o[f], F.lit(False)) == F.coalesce(n[f], F.lit(False))
        return F.coalesce(o[f], F.lit("")) == F.coalesce(n[f], F.lit("")) if f == "comment" else o[f].eqNullSafe(n[f])

    return F.array_compact(F.array(*(F.when(~same(f), F.lit(name)) for f, name in FIELDS.items())))


def paired(old: DataFrame, new: DataFrame, scope: list[str], key: Column) -> DataFrame:
    """scope, o and n: the i-th of equal keys on one side with the i-th on the other, and rows with one of both null for all else, empty
    keys among them. Both sides have scope and x, a struct with id, physical and logical. One join finds what meets and what is left."""
    def numbered(df: DataFrame, side: str) -> DataFrame:
        i = F.row_number().over(W.partitionBy(*scope, "key").orderBy("x.id"))
        return df.select(*scope, key.alias("key"), "x").where("key != ''").select(*scope, "key", i.alias("i"), F.col("x").alias(side))

    met = numbered(old, "o").join(numbered(new, "n"), [*scope, "key", "i"], "full_outer").select(*scope, "o", "n")
    none = F.coalesce(key, F.lit("")) == ""
    blank = [df.where(none).select(*scope, F.col("x").alias(side)) for df, side in ((old, "o"), (new, "n"))]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), blank, met)


def parts_of(score) -> tuple[dict[str, Column], list[float], float]:
    """The parts of a score that candidates are found by, their weights, and the weight of all other parts. A Jaccard similarity is
    never above the Dice similarity of the same sets, so a bound on it holds for that too."""
    named = {f: similarity.name_grams(F.col(f"x.{f}")) for f in ("physical", "logical")}
    if score is column_score:
        return named, [0.45, 0.20], 0.35
    return named | {"names": F.when(F.size("x.names") == 0, F.array(F.lit(""))).otherwise(F.col("x.names"))}, [0.35, 0.25, 0.30], 0.10


def matched(old: DataFrame, new: DataFrame, scope: list[str], score, least: float = RENAME, pairs: int = PAIRS) -> DataFrame:
    """scope, old_id, new_id, phase and score of what ``outcome`` pairs."""
    rows = settled(outcome(old, new, scope, score, least, pairs).where("o is not null and n is not null"), "matches")
    return rows.select(*scope, F.col("o.id").alias("old_id"), F.col("n.id").alias("new_id"), "phase", "score")


def outcome(old: DataFrame, new: DataFrame, scope: list[str], score, least: float = RENAME, pairs: int = PAIRS) -> DataFrame:
    """scope, o, n, phase and score: each row of both sides once, with what it is matched with, or alone. Both sides have scope and x, a
    struct with id, physical, logical and what the score takes. Phases: physical (equal physical names), logical (equal logical names
    where both physical names are empty), fuzzy (the best scores of what is left, from ``least`` on, one to one). Up to ``pairs`` of what
    is left are scored each with each in its scope; beyond that, those that share rare bigrams or names. A row is carried on with what it
    has met, so all rows are joined once, by their names, and only what is left after that again."""
    physical, logical = norm(F.col("x.physical")), norm(F.col("x.logical"))
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    lone = lambda df: [df.where(F.col(other).isNull()).select(*scope, F.col(side).alias("x")) for side, other in ("on", "no")]
    first = settled(paired(old, new, scope, physical), "pairs")
    second = settled(paired(*lone(first), scope, F.when(physical == "", logical).otherwise("")), "pairs")
    old3, new3 = lone(second)
    o, n = old3.select(*scope, F.col("x.id").alias("old_id"), F.col("x").alias("o")), new3.select(*scope, F.col("x.id").alias("new_id"), F.col("x").alias("n"))
    near, weights, free = parts_of(score)
    bound = similarity.pigeonhole(weights, free, least)
    sizes = old3.groupBy(*scope).agg(F.count("*").alias("a")).join(new3.groupBy(*scope).agg(F.count("*").alias("b")), scope)
    if bound > 0 and (sizes.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0) > pairs:  # one of the parts must be alike for the sum to reach the least score
        met = similarity.candidates(old3, new3, scope, near, bound).join(o, [*scope, "old_id"]).join(n, [*scope, "new_id"])
    else:
        met = o.join(n, scope)
    left = met.select(*scope, "old_id", "new_id", score(F.col("o"), F.col("n")).alias("score"))
    third = similarity.one_to_one(left.where(F.col("score") >= least), scope)
    rest = o.join(third, [*scope, "old_id"], "left").join(n, [*scope, "new_id"], "full_outer").select(*scope, "o", "n", F.when(both, "fuzzy").alias("phase"), "score")
    exact = first.where(both).withColumn("phase", F.lit("physical")).unionByName(second.where(both).withColumn("phase", F.lit("logical")))
    return exact.select(*scope, "o", "n", "phase", score(F.col("o"), F.col("n")).alias("score")).unionByName(rest)


def changes(found: DataFrame, scope: list[str], fields, least: float = RENAME) -> DataFrame:
    """scope, action, score, changed_fields, o and n (structs of the sides) of an ``outcome``: removed, added, rename_suggest (both have
    physical names, which differ, and the score is at least ``least``) and modified; pairs without changes have no action."""
    x, y = norm(F.col("o.physical")), norm(F.col("n.physical"))
    changed = F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), fields(F.col("o"), F.col("n"))).otherwise(F.array().cast("array<string>"))
    rows = found.withColumn("changed_fields", changed)
    renamed = (x != "") & (y != "") & (x != y) & (F.col("score") >= least)
    action = F.when(F.col("n").isNull(), "removed").when(F.col("o").isNull(), "added").when(renamed, "rename_suggest").when(F.size("changed_fields") > 0, "modified")
    return rows.select(*scope, action.alias("action"), "score", "changed_fields", "o", "n")


def column_changes(old: DataFrame, new: DataFrame, scope: list[str], least: float = RENAME) -> DataFrame:
    """Changes of columns in each scope; both sides are definitions with the columns of scope."""
    sides = [df.select(*scope, F.struct(F.col("position").alias("id"), *FIELDS).alias("x")) for df in (old, new)]
    return changes(outcome(*sides, scope, column_score, least), scope, changed_fields, least).where("action is not null")


def table_fields(o: Column, n: Column) -> Column:
    return F.array_compact(F.array(F.when(~o["logical"].eqNullSafe(n["logical"]), F.lit("logicalTableName")), F.when(~o["physical"].eqNullSafe(n["physical"]), F.lit("physicalTableName"))))


def schema_changes(old: DataFrame, new: DataFrame, least: float = RENAME) -> tuple[DataFrame, DataFrame]:
    """Changes of tables (sheet, action, score, changed_fields, o, n, n_columns: changed columns) and of the columns of matched
    tables (sheet, old_table, new_table, action, score, changed_fields, o, n). A matched table without any change isn't there."""
    scope = ["sheet"]
    old, new = settled(old, "definitions"), settled(new, "definitions")
    sides = [tables_of(df).select("sheet", F.struct(F.col("table_id").alias("id"), "logical", "physical", "names", "comments").alias("x")) for df in (old, new)]
    found = settled(outcome(*sides, scope, table_score, least), "matches")
    ids = found.where("o is not null and n is not null").select("sheet", F.col("o.id").alias("old_table"), F.col("n.id").alias("new_table"))
    by = ["sheet", "old_table", "new_table"]
    columns = column_changes(old.withColumnRenamed("table_id", "old_table").join(ids, ["sheet", "old_table"]), new.withColumnRenamed("table_id", "new_table").join(ids, ["sheet", "new_table"]), by, least)
    columns = settled(columns, "changes")
    counts = columns.groupBy(*by).agg(F.count("*").alias("n_columns"))
    tables = changes(found, scope, table_fields, least)
    tables = tables.withColumn("old_table", F.col("o.id")).withColumn("new_table", F.col("n.id")).join(counts, by, "left").withColumn("n_columns", F.coalesce("n_columns", F.lit(0)))
    altered = F.col("action").isin("added", "removed") | (F.size("changed_fields") > 0) | (F.col("n_columns") > 0)
    action = F.when(F.col("action") == "modified", "changed").otherwise(F.coalesce("action", F.lit("changed")))
    return settled(tables.where(altered).withColumn("action", action), "changes"), columns


def signatures(definitions: DataFrame) -> DataFrame:
    """sheet, table and the sorted names of its columns, as one text a table."""
    names = F.array_join(F.array_sort("names"), ",")
    return tables_of(definitions).select(F.concat_ws("|", norm(F.col("sheet")), norm(F.col("physical")), names).alias("signature")).distinct()


def baseline_scores(candidates: DataFrame, name: str, uploaded_ms: int, tables: DataFrame | None = None, shortlist: int = SHORTLIST) -> DataFrame:
    """``candidates`` (id, name, ms, signatures) with score, from the name, the distance in time and the signatures that
    ``tables`` (signatures, one row) shares. Only the best ``shortlist`` by name and time are looked at in full."""
    far = F.abs(F.col("ms") - F.lit(uploaded_ms))
    named = text.dice(F.lit(name), F.col("name"))

    def near(df: DataFrame) -> DataFrame:
        most = df.agg(F.greatest(F.max(far), F.lit(1)).alias("most"))
        return df.crossJoin(F.broadcast(most)).withColumn("near", F.greatest(1 - far / F.col("most"), F.lit(0.0))).drop("most")

    rows = near(candidates).orderBy(weighted([(0.7, named), (0.3, F.col("near"))]).desc(), "id").limit(shortlist).drop("near")
    rows = near(rows)
    if tables is None:
        return rows.select("id", weighted([(0.7, named), (0.3, F.col("near"))]).alias("score"))
    rows = rows.crossJoin(F.broadcast(tables.select(F.col("signatures").alias("_own"))))
    return rows.select("id", weighted([(0.35, named), (0.25, F.col("near")), (0.4, text.jaccard(F.col("_own"), F.col("signatures")))]).alias("score"))


def baseline(scores: DataFrame, place: str = "place") -> DataFrame:
    """One row: the id of the highest score, of equal scores the one that comes first by ``place``."""
    return scores.agg(F.max_by("id", F.struct("score", -F.col(place))).alias("id"), F.max("score").alias("score"))


def sheet_mapping(new: DataFrame, old: DataFrame, least: float = SHEET) -> DataFrame:
    """sheet and baseline: the old sheet of the same name, or else the one most alike in its tables and name, the first of equals, or
    else itself. A sheet's place is ``place``, where a side has it, or the order of its name; rows whose table_id is null stand for
    sheets without tables. Only sheets that lack their namesake are compared, with those that share a table or bigrams of the name."""
    def sets(df: DataFrame, side: str) -> DataFrame:
        table = F.coalesce(F.nullif(norm(F.col("physical")), F.lit("")), norm(F.col("logical")))
        found = tables_of(df.where("table_id is not null")).groupBy("sheet").agg(F.collect_set(F.nullif(table, F.lit(""))).alias("tables"), F.lit(True).alias("full"))
        places = df.groupBy("sheet").agg((F.min("place") if "place" in df.columns else F.lit(0)).alias("place"))
        rows = places.join(found, "sheet", "left").withColumn("tables", F.coalesce("tables", F.array().cast("array<string>")))
        return rows.select(F.struct(F.col("sheet").alias("id"), "place", "tables", F.coalesce("full", F.lit(False)).alias("full")).alias("x"))

    own, known = settled(sets(new, "new"), "sheets"), settled(sets(old, "old"), "sheets")
    same = own.select(F.col("x.id").alias("sheet")).join(known.select(F.col("x.id").alias("sheet")), "sheet")
    lone = own.join(same, F.col("x.id") == F.col("sheet"), "left_anti")
    asked = lone.where("x.full")
    bound = similarity.pigeonhole([0.75, 0.25], 0.0, least)
    parts = {"tables": F.when(F.size("x.tables") == 0, F.array(F.lit(""))).otherwise(F.col("x.tables")), "name": similarity.name_grams(F.col("x.id"))}
    scoped = lambda df: df.select(F.lit(0).alias("scope"), "x")
    met = similarity.candidates(scoped(asked), scoped(known), ["scope"], parts, bound)
    met = met.join(asked.select(F.col("x.id").alias("old_id"), F.col("x").alias("n")), "old_id").join(known.select(F.col("x.id").alias("new_id"), F.col("x").alias("o")), "new_id")
    score = weighted([(0.75, text.jaccard(F.col("n.tables"), F.col("o.tables"))), (0.25, text.dice(F.col("n.id"), F.col("o.id")))])
    best = met.withColumn("score", score).where(F.col("score") >= least).groupBy(F.col("n.id").alias("sheet")).agg(F.max_by("o.id", F.struct("score", -F.col("o.place"))).alias("baseline"))
    rest = lone.select(F.col("x.id").alias("sheet")).join(best, "sheet", "left").select("sheet", F.coalesce("baseline", "sheet").alias("baseline"))
    return same.select("sheet", F.col("sheet").alias("baseline")).unionByName(rest)


def hints(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """The sorted keywords of what changes touch: tables, columns, and renames that wait for a decision."""
    words = tables.select(F.concat(F.lit("table:"), shown_name()).alias("keyword")).unionByName(columns.select(F.concat(F.lit("column:"), shown_name()).alias("keyword")))
    waiting = pending(tables, columns).select(F.lit("rename:pending_confirmation").alias("keyword"))
    return words.unionByName(waiting).where("keyword is not null").distinct().orderBy("keyword")


def shown_name() -> Column:
    """The name of a change: the physical one of the new side, of the old side, then the logical ones."""
    return F.coalesce(*(F.nullif(F.col(f"{side}.{f}"), F.lit("")) for f in ("physical", "logical") for side in ("n", "o")))


def pending(tables: DataFrame, columns: DataFrame) -> DataFrame:
    return tables.select("action").unionByName(columns.select("action")).where("action = 'rename_suggest'")


def changed_names(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """kind (table or column), sheet, table_name, action, name, confidence (of what is matched) and whether it waits for a decision."""
    table = tables.select("sheet", F.coalesce("old_table", "new_table").alias("t"), shown_name().alias("table_name"), F.col("old_table"), F.col("new_table"))
    own = tables.select(F.lit("table").alias("kind"), "sheet", shown_name().alias("table_name"), "action", shown_name().alias("name"), F.col("score").alias("confidence"))
    on = [F.col("c.sheet") == F.col("t.sheet"), F.col("c.old_table") == F.col("t.old_table"), F.col("c.new_table") == F.col("t.new_table")]
    inner = columns.alias("c").join(table.alias("t"), on).select(F.lit("column").alias("kind"), F.col("c.sheet"), "t.table_name", "c.action", F.coalesce(*(F.nullif(F.col(f"c.{s}.{f}"), F.lit("")) for f in ("physical", "logical") for s in ("n", "o"))).alias("name"), F.col("c.score").alias("confidence"))
    return own.unionByName(inner).withColumn("requires_confirmation", F.col("action") == "rename_suggest")


#: What is to be done next, with renames that wait for a decision and without.
NEXT_ACTIONS = {True: ["Review rename suggestions and confirm accept/reject.", "Re-run ALTER preview after confirmations."], False: ["No rename confirmations pending.", "Proceed to ALTER preview/export."]}


def next_actions(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """place and action_text of what is to be done next."""
    texts = lambda waits: F.array(*map(F.lit, NEXT_ACTIONS[waits]))
    found = pending(tables, columns).agg((F.count("*") > 0).alias("waits"))
    return found.select(F.posexplode(F.when(F.col("waits"), texts(True)).otherwise(texts(False))).alias("place", "action_text"))


def summary(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One row: tables and columns added, removed and changed, and suggested renames. A suggested rename of a column counts as a
    changed column, one of a table doesn't count as a changed table."""
    count = lambda names: F.count_if(F.col("action").isin(*names))
    t = tables.agg(count(["added"]).alias("added_tables"), count(["removed"]).alias("removed_tables"), count(["changed", "renamed"]).alias("changed_tables"), count(["rename_suggest"]).alias("t"))
    c = columns.agg(count(["added"]).alias("added_columns"), count(["removed"]).alias("removed_columns"), count(["modified", "rename_suggest", "renamed"]).alias("changed_columns"), count(["rename_suggest"]).alias("c"))
    return t.crossJoin(F.broadcast(c)).withColumn("rename_suggestions", F.col("t") + F.col("c")).drop("t", "c")
