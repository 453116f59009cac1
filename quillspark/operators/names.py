"""Physical names made valid: normalised, reserved words prefixed, long names cut, repeats in a scope told apart."""

from __future__ import annotations

from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.shared import settled

#: Words that no identifier may be.
RESERVED = """add all alter and as asc between by case check column constraint create database default delete desc distinct drop else
exists foreign from group having in index insert into is join key like limit not null on or order primary references select set
table then to union unique update user using values view when where""".split()
LONGEST, SHORTEST_LIMIT, LONGEST_LIMIT, PREFIX = 64, 8, 255, "n_"


def fnv_hash(s: str) -> str:
    """The first six hex digits of the 32-bit FNV-1a hash."""
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return f"{h:08x}"[:6]


def suffixed(name: str, suffix: str, most: int) -> str:
    return name[: max(1, most - len(suffix))] + suffix if len(name) + len(suffix) > most else name + suffix


def told_apart(names: list[str], keys: list[str], most: int, strategy: str) -> tuple[list[str], list[bool]]:
    """Names in order, each changed if an earlier one has it (whatever its case), and which of them couldn't be changed."""
    used, out, stuck, tried = set(), [], [], {}
    for name, key in zip(names, keys):
        tries = [name]
        if strategy == "hash_suffix":
            tries.append(suffixed(name, f"_{fnv_hash(f'{key}:{name}')}", most))
        found = next((x for x in tries if x.lower() not in used), None)
        if found is None and strategy != "abort":
            # numbers that were taken stay taken, so those tried for a name needn't be tried again
            i = next(i for i in count(tried.get(name.lower(), 2)) if suffixed(name, f"_{i}", most).lower() not in used)
            found, tried[name.lower()] = suffixed(name, f"_{i}", most), i + 1
        stuck.append(found is None)
        out.append(name if found is None else found)
        used.add(out[-1].lower())
    return out, stuck


def name_plan(
    names: DataFrame,
    scope: list[str],
    order: str,
    candidates: list[str],
    fallback: str,
    most: int = LONGEST,
    conflict: str = "suffix_increment",
    reserved: str = "prefix",
    overflow: str = "truncate_hash",
    prefix: str = PREFIX,
    key_prefix: str = "col",
) -> DataFrame:
    """``names`` with before (the first of the candidate columns that isn't blank, or the fallback, an SQL expression),
    normalized, after, reasons and conflicts (arrays). Conflicts block: invalid_name, reserved_word, length_overflow, duplicate.

    The strategies are those named, or abort: then the name stays and is a conflict. Names of a scope (the columns of a table,
    the tables of a file) are resolved in their order. Equal names are numbered by Spark; only names that another one may become, by a
    number behind it or by being cut, are a group with it that a task resolves one by one.
    """
    most = min(max(most, SHORTEST_LIMIT), LONGEST_LIMIT)
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    rows = names.withColumn("_fallback", F.expr(fallback)).withColumn("before", F.coalesce(*map(blank, candidates), F.col("_fallback")))
    x = text.physical_name(F.trim("before"), "")
    rows = rows.withColumn("normalized", F.when(x.isin("", "t_"), F.col("_fallback")).otherwise(x))
    is_reserved = F.lower("normalized").isin(RESERVED)
    name = F.when(is_reserved, F.concat(F.lit(prefix.strip() or PREFIX), "normalized")).otherwise(F.col("normalized")) if reserved == "prefix" else F.col("normalized")
    rows = rows.withColumn("_name", name)
    is_long = F.length("_name") > most
    made = [F.when(is_reserved, "reserved_word_prefixed")] if reserved == "prefix" else []
    bad = [F.when(~text.is_valid_name(F.col("normalized")), "invalid_name")]
    bad += [F.when(is_reserved, "reserved_word")] if reserved == "abort" else []
    if overflow == "abort":
        bad.append(F.when(is_long, "length_overflow"))
    else:
        made.append(F.when(is_long, "length_overflow_truncated"))
    compact = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    rows = rows.withColumn("reasons", compact(made)).withColumn("conflicts", compact(bad))
    rows = rows.withColumn("after", F.col("_name") if overflow == "abort" else text.clamp_name(F.col("_name"), most)).drop("_fallback", "_name")

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        keys = [f"{key_prefix}:" + ":".join(map(str, [*(group[s].iloc[i] for s in scope), group[order].iloc[i]])) for i in range(len(group))]
        after, stuck = told_apart(group["after"].tolist(), keys, most, conflict)
        add = lambda column, marks, what: [[*x, what] if m else [*x] for x, m in zip(group[column], marks)]
        changed = [a != b for a, b in zip(after, group["after"])]
        return group.assign(reasons=add("reasons", changed, "duplicate_resolved"), conflicts=add("conflicts", stuck, "duplicate"), after=after)

    if conflict == "hash_suffix":
        return rows.groupBy(*scope).applyInPandas(resolve, rows.schema)
    # a suffix has eleven characters at most, so a name and all it can become share what stands before them, but for numbers at its end
    low = F.lower("after")
    keyed = rows.withColumn("_low", low).withColumn("_stem", F.regexp_replace(F.substring(low, 1, max(1, most - 11)), "[_0-9]+$", ""))
    by = [*scope, "_stem"]
    kinds = settled(keyed.select(*by, "_low").distinct(), "names")
    same = lambda x, y, columns: reduce(lambda c, d: c & d, (x[k].eqNullSafe(y[k]) for k in columns))
    # names meet where one is another with a number behind it, or where they are so long that they are cut
    child, parent = kinds.withColumn("_parent", F.regexp_replace("_low", "_[0-9]+$", "")).where("_parent != _low"), kinds.alias("p")
    met = child.alias("c").join(parent, same(*({k: F.col(f"{x}.{k}") for k in by} for x in "cp"), by) & (F.col("c._parent") == F.col("p._low"))).select(*(F.col(f"c.{k}") for k in by))
    cut = kinds.groupBy(*by).agg(F.count("*").alias("_n"), F.max(F.length("_low")).alias("_most")).where((F.col("_n") > 1) & (F.col("_most") > most - 11)).select(*by)
    tangled = settled(met.unionByName(cut).distinct(), "names")
    side = lambda how: keyed.alias("k").join(tangled.alias("t"), same(*({k: F.col(f"{x}.{k}") for k in by} for x in "kt"), by), how)
    one = side("left_anti").withColumn("_i", F.row_number().over(W.partitionBy(*scope, "_low").orderBy(order)))
    again, suffix = F.col("_i") > 1, F.concat(F.lit("_"), F.col("_i").cast("string"))
    told = F.concat(F.substring(F.col("after"), F.lit(1), F.greatest(F.lit(1), F.least(F.length("after"), most - F.length(suffix)))), suffix)
    column, what = ("conflicts", "duplicate") if conflict == "abort" else ("reasons", "duplicate_resolved")
    one = one.withColumn(column, F.when(again, F.array_append(column, F.lit(what))).otherwise(F.col(column)))
    if conflict != "abort":
        one = one.withColumn("after", F.when(again, told).otherwise(F.col("after")))
    several = side("left_semi").drop("_low")
    return one.select(*rows.columns).unionByName(several.groupBy(*by).applyInPandas(resolve, several.schema).select(*rows.columns))
