"""Profiles of columns, pairing, run history and batches of statements."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text


def any_cell_contains(columns: list[str], needle: str) -> Column:
    """If the text of any of the columns has the needle, whatever its case; wildcards have no meaning."""
    return reduce(or_, (F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")).contains(needle.lower()) for c in columns))


def value_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_rows, n_null, max_length and kinds (sorted, comma-separated; without null) of all rows in one aggregate."""
    types = dict(df.dtypes)
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), text.observed_kind(F.col(c), types[c]).alias("kind"), F.length(F.trim(F.col(c).cast("string"))).alias("n")) for c in columns))
    return df.select(F.inline(each)).groupBy("column_name").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("kind") == "null").alias("n_null"),
        F.max("n").alias("max_length"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))), ",").alias("kinds"),
    )


def column_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, kind and max_length (trimmed): the kind that all non-blank cells of a text column have, decimal for integers and
    decimals, else text."""
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("value")) for c in columns))
    kind = text.kind_of(F.col("value"), text.CELL_KINDS, "blank")
    rows = df.select(F.inline(each)).groupBy("column_name").agg(F.collect_set(kind).alias("k"), F.max(F.length("value")).alias("max_length"))
    k = F.array_remove("k", "blank")
    found = F.when(F.size(k) == 1, F.get(k, 0)).when((F.size(k) == 2) & F.array_contains(k, "integer") & F.array_contains(k, "decimal"), "decimal").otherwise("text")
    return rows.select("column_name", found.alias("kind"), "max_length")


def insert_batches(rows: DataFrame, group: str, place: str, order: str, columns: dict[str, bool], size: int) -> DataFrame:
    """Tuples of INSERT statements, ``size`` rows each; columns say if a value is quoted. A batch is a group of bounded size."""
    cell = lambda c, quoted: text.sql_literal(F.col(c)) if quoted else F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    line = F.concat(F.lit("("), F.concat_ws(", ", *(cell(c, q) for c, q in columns.items())), F.lit(")"))
    made = rows.select(group, F.floor((F.col(place) - 1) / size).alias("batch"), F.struct(F.col(order).alias("o"), line.alias("line")).alias("x"))
    out = made.groupBy(group, "batch").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list("x")).alias("x"))
    return out.select(group, "batch", "n_rows", F.array_join(F.col("x.line"), ", ").alias("tuples"))


def run_rollup(runs: DataFrame, key: str, place: str, failed: str) -> DataFrame:
    """Statements of a run as one entry: how many failed, the first of them, and the status of the whole."""
    f = F.col(failed)
    return runs.groupBy(key).agg(
        F.count("*").alias("n_statements"),
        F.sum(f.cast("long")).alias("n_failed"),
        F.min(F.when(f, F.col(place))).alias("first_failed"),
        F.when(F.bool_and(f), "failed").when(F.bool_or(f), "partial").otherwise("success").alias("status"),
    )


def pair_in_turn(old: DataFrame, new: DataFrame, old_key: str, new_key: str, old_order: str, new_order: str) -> DataFrame:
    """The i-th of equal keys on one side with the i-th on the other; null keys match nothing."""
    a = old.withColumn("_i", F.row_number().over(W.partitionBy(old_key).orderBy(old_order)))
    b = new.withColumn("_j", F.row_number().over(W.partitionBy(new_key).orderBy(new_order)))
    return a.join(b, (F.col(old_key) == F.col(new_key)) & (F.col("_i") == F.col("_j"))).drop("_i", "_j")
