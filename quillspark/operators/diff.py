"""Row comparison of two versions of a table on stable keys.

Null keys match null keys. A compare column that only one side has counts as changed in every matched row. Where a key is
repeated on a side, the row with the greatest ordinal wins. One full outer join on null-safe keys does the work, a sort-merge
join. Adaptive execution doesn't split skewed partitions of a full outer join; with one row a key none is skewed.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = {"source_only": "insert", "target_only": "delete", "value_changed": "update", "unchanged": "none"}


def union_columns(source: list[str], target: list[str]) -> list[str]:
    """The source's columns, then those that only the target has."""
    return source + [c for c in target if c not in source]


def compare_columns(requested: list[str] | None, source: list[str], target: list[str], keys: list[str]) -> list[str]:
    """Requested columns that exist on either side, or else all but the keys."""
    known = union_columns(source, target)
    return [c for c in requested if c in known] if requested else [c for c in known if c not in keys]


def stable_key(primary: list[str], unique: list[list[str]], business: list[str]) -> list[str]:
    """The primary key, or else the first unique index, or else the business keys; none of them is an error."""
    found = primary or next((u for u in unique if u), None) or business
    if not found:
        raise ValueError("no stable key")
    return found


def keep_last(df: DataFrame, keys: list[str], ordinal: list[Column], columns: list[str] | None = None) -> DataFrame:
    """One row a key: the one that comes last in the ordinal, with ``columns`` or all. An aggregate, so each task sends one row a key
    and a key that very many rows have is no burden; only what is asked for is carried."""
    columns = columns or df.columns
    rest = [c for c in columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*ordinal)).alias("_row")) if rest else df.select(*keys).distinct()
    return last.select(*(F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in columns))


def suggested_action(status: Column) -> Column:
    return reduce(lambda c, kv: c.when(status == kv[0], F.lit(kv[1])), ACTIONS.items(), F.when(F.lit(False), F.lit("")))


def classify(source: DataFrame, target: DataFrame, keys: list[str], compare: list[str] | None = None) -> DataFrame:
    """keys, status, action, source_row and target_row (structs) and changed (the names of the changed columns).

    Both sides must have one row a key (see keep_last).
    """
    compare = compare_columns(compare, source.columns, target.columns, keys)
    s = source.select(F.struct(*source.columns).alias("source_row"), *(F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)))
    t = target.select(F.struct(*target.columns).alias("target_row"), *(F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)))
    joined = s.join(t, reduce(and_, (F.col(f"_s{i}").eqNullSafe(F.col(f"_t{i}")) for i in range(len(keys)))), "full_outer")
    has_s, has_t = F.col("source_row").isNotNull(), F.col("target_row").isNotNull()

    def differs(c: str) -> Column:
        if c not in source.columns or c not in target.columns:
            return F.lit(True)
        return ~F.col(f"source_row.{c}").eqNullSafe(F.col(f"target_row.{c}"))

    changed = F.array_compact(F.array(*(F.when(differs(c), F.lit(c)) for c in compare))) if compare else F.array().cast("array<string>")
    status = F.when(~has_t, "source_only").when(~has_s, "target_only").when(reduce(or_, map(differs, compare), F.lit(False)), "value_changed").otherwise("unchanged")
    return joined.select(
        *(F.coalesce(f"_s{i}", f"_t{i}").alias(k) for i, k in enumerate(keys)),
        status.alias("status"),
        suggested_action(status).alias("action"),
        "source_row",
        "target_row",
        F.when(has_s & has_t, changed).otherwise(F.array().cast("array<string>")).alias("changed"),
    )


def statuses(source: DataFrame, target: DataFrame, keys: list[str], compare: list[str] | None = None) -> DataFrame:
    """keys and status alone: only keys and compared columns are read and shuffled."""
    compare = compare_columns(compare, source.columns, target.columns, keys)
    kept = lambda df: df.select(*keys, *(c for c in compare if c in df.columns and c not in keys))
    return classify(kept(source), kept(target), keys, compare).select(*keys, "status")


def status_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count("*").alias("n_rows"))


def field_deltas(classified: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each compare column of each row that both sides have: column_name, source_value, target_value, changed."""
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), text("source_row", c).alias("source_value"), text("target_row", c).alias("target_value"), F.array_contains("changed", c).alias("changed")) for c in columns))
    return classified.where("status in ('value_changed', 'unchanged')").select(*keys, F.inline(each))


def detail_page(classified: DataFrame, keys: list[str], limit: int = 100, offset: int = 0, include_unchanged: bool = False) -> DataFrame:
    """A page of rows in the order of their keys as JSON text, one row more than ``limit`` to tell if there is another page."""
    rows = classified if include_unchanged else classified.where("status != 'unchanged'")
    return rows.withColumn("row_key", F.to_json(F.struct(*sorted(keys)), {"ignoreNullFields": "false"})).orderBy("row_key").offset(offset).limit(limit + 1)


def sample_rows(classified: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """The first k changed rows in key order, or, if none is changed, the first k rows."""
    first = classified.withColumn("_same", F.col("status") == "unchanged").orderBy("_same", *keys).limit(max(1, k))
    any_changed = first.agg((F.min(F.col("_same").cast("int")) == 0).alias("_any"))
    return first.join(F.broadcast(any_changed), ~(F.col("_any") & F.col("_same"))).drop("_same", "_any")


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row as JSON, its columns in name order; null isn't the text null."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def snapshot_hash(df: DataFrame) -> DataFrame:
    """n_rows and hash: the sums of the eight 32-bit parts of the row hashes, as text; equal for equal bags of rows, in any order.

    Sums of parts need no single task that sees all rows, unlike a digest of sorted rows.
    """
    h = row_hash(df)
    parts = df.select(*(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)").alias(f"p{i}") for i in range(8)))
    sums = parts.agg(F.count("*").alias("n_rows"), *(F.sum(f"p{i}").cast("decimal(38,0)").cast("string").alias(f"p{i}") for i in range(8)))
    return sums.select("n_rows", F.concat_ws("-", *(F.coalesce(f"p{i}", F.lit("0")) for i in range(8))).alias("hash"))
