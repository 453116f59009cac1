"""Similarity joins of names and sets, and one-to-one matches of what they find.

Two sets with a Dice similarity of at least t share an element among the first of each, if both are ordered alike and so many
of the first are looked at that the rest is too small for t. The rarest elements go first, so few sets meet at each. Only
sets that share such an element, and whose sizes allow t, are compared; each pair of them is, once.

Where elements are so common that this leaves most pairs, blocks of sets are compared with blocks instead, as products of matrices:
a task holds two blocks at a time, whatever the size of a scope, and reads them from where each was written once.
"""

from __future__ import annotations

import heapq
import itertools
import math
import uuid
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quillspark.functions import text
from quillspark.shared import filesystem, fresh_dir, settled

#: Elements whose counts are sent to all tasks; of more of them, counts are joined by a shuffle.
BROADCAST_ELEMENTS = 200_000
#: Sets of a block, and pairs compared by blocks for each pair that would meet at a rare element.
BLOCK, DENSE = 1024, 50
#: Elements that are looked at at once when two blocks are compared, and pairs of blocks that a task is dealt if there are many.
WIDTH, TASK_PAIRS = 8192, 64
#: Links and ids of a scope that one task matches one to one; of more of them, pairs are matched in rounds.
TASK_LINKS = 2_000_000
_SLACK = 1e-9


def name_grams(name: Column) -> Column:
    """The bigrams of a normalised name as a set, told apart by occurrence; an empty name has one element of its own."""
    x = text.normalize_name(F.coalesce(name, F.lit("")))
    return F.when(x == "", F.array(F.lit(""))).otherwise(text.counted(text.bigrams(x)))


def _postings(rows: DataFrame, scope: list[str], counts: DataFrame, least: float, side: str) -> DataFrame:
    """A row for each of the first elements of each set (scope, key, grams): the element, the set, its size and its first elements."""
    each = rows.select(*scope, "key", F.explode("grams").alias("gram")).join(counts, "gram")
    ordered = each.groupBy(*scope, "key").agg(F.array_sort(F.collect_list(F.struct("count", "gram"))).alias("x"))
    n = F.size("grams")
    # a partner has at least n * t / (2 - t) elements, and then at least as many must be shared
    first = n - F.ceil(n * (least / (2 - least)) - _SLACK) + 1
    ordered = ordered.select(*scope, "key", F.col("x.gram").alias("grams"))
    ordered = ordered.withColumn("first", F.slice("grams", F.lit(1), F.least(first, n)))
    return ordered.select(*scope, F.explode("first").alias("gram"), F.struct("key", "grams", "first").alias(side))


def _shared(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many elements each set of one block shares with each of the other, and the sizes of the sets. ``WIDTH`` elements are looked
    at at once, however many there are."""
    x, y = (c.combine_chunks() for c in (left, right))
    n, m = (np.asarray(c.value_lengths()) for c in (x, y))
    found = pa.concat_arrays([x.flatten(), y.flatten()]).dictionary_encode()
    codes, width = np.asarray(found.indices), len(found.dictionary)
    sides = [(len(k), np.repeat(np.arange(len(k)), k), c) for k, c in ((n, codes[: n.sum()]), (m, codes[n.sum() :]))]
    shared = None
    for start in range(0, max(1, width), WIDTH):
        stop = min(width, start + WIDTH)
        marks = []
        for size, row, code in sides:
            mark = np.zeros((size, max(1, stop - start)), np.float32)
            if width <= WIDTH:
                mark[row, code] = 1
            else:
                here = (code >= start) & (code < stop)
                mark[row[here], code[here] - start] = 1
            marks.append(mark)
        part = marks[0] @ marks[1].T
        shared = part if shared is None else shared + part
    return shared, n, m


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """``x`` (not negative) rounded like Spark's round: halves of the shortest decimal go up."""
    scaled = x * 10.0**places
    out = np.floor(scaled + 0.5) / 10.0**places
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3
    if near.any():
        values, at = np.unique(x[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) for v in values])[at]
    return out


def _runs(batches, by: list[str]):
    """A table of the rows of each run of rows that are equal in ``by``, from batches in which such rows follow each other."""
    def pieces():
        for batch in batches:
            table = pa.Table.from_batches([batch])
            names = list(zip(*(table[c].to_pylist() for c in by)))
            for name, run in itertools.groupby(range(len(names)), names.__getitem__):
                places = list(run)
                yield name, table.slice(places[0], len(places))

    for _, run in itertools.groupby(pieces(), lambda x: x[0]):
        yield pa.concat_tables(piece for _, piece in run)


def _stored(rows: DataFrame, scope: list[str], side: str) -> DataFrame:
    """scope of each block of ``rows`` (scope, block and others) and ``side``, a struct of the file in the shared folder that the block
    has been written to and its number there. A file has the blocks of a task."""
    folder, by = fresh_dir(rows.sparkSession, "blocks"), [*scope, "block"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*scope).schema), "path string, number int"])
    declared = to_arrow_schema(StructType.fromDDL(schema))

    def write(batches):
        path, writer, found = f"{folder}/{uuid.uuid4().hex}", None, []
        try:
            for table in _runs(batches, by):
                if writer is None:
                    fs, name = filesystem(path)
                    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(name)
                    writer = pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                writer.write_batch(pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], schema=table.schema))
                found.append(table.select(scope).take([0]))  # a slice would hold on to the block
        finally:
            if writer is not None:
                writer.close()
                out.close()
        if found:
            places = {"path": pa.array([path] * len(found)), "number": pa.array(range(len(found)), pa.int32())}
            first = pa.concat_tables(found)
            yield from pa.table({c: first[c] for c in scope} | places).cast(declared).combine_chunks().to_batches()

    made = rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(write, schema)
    return settled(made, "blocks").select(*scope, F.struct("path", "number").alias(side))


def block_scores(left: DataFrame, right: DataFrame, scope: list[str], weights: list[float], least: float | None = None, places: list[int] | None = None) -> DataFrame:
    """scope, a, b and score of the pairs of keys of each scope: the sum of the Dice similarities of their sets, times ``weights``, and
    rounded to each of ``places`` in turn; all pairs, or those of ``least`` and more. Both sides have scope, key and sets, an array with
    an array without repeated elements (and not empty) for each weight; a key stands once in its scope.

    A scope with a block on either side is compared by one task. Blocks of larger scopes are written once to the shared folder, and
    tasks read the blocks of the pairs that they are dealt: what is shuffled and stored grows with the sets, not with pairs of blocks."""
    parts = [F.col("sets")[i].alias(f"s{i}") for i in range(len(weights))]
    left, right = (settled(df.select(*scope, "key", *parts), "sets") for df in (left, right))

    def dealt(df: DataFrame, blocks: str) -> DataFrame:
        return df.groupBy(*scope).agg(F.ceil(F.count("*") / BLOCK).alias(blocks))

    deals = settled(dealt(left, "p").join(dealt(right, "q"), scope), "deals")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*scope).schema), f"a {left.schema['key'].dataType.simpleString()}", f"b {right.schema['key'].dataType.simpleString()}", "score double"])
    declared = to_arrow_schema(StructType.fromDDL(schema))  # keys that are arrays may come in as arrays without nulls

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return declared.empty_table()
        total = None
        for i, weight in enumerate(weights):
            shared, n, m = _shared(x[f"s{i}"], y[f"s{i}"])
            part = weight * (2.0 * shared / (n[:, None] + m[None, :]).astype(np.float64))
            total = part if total is None else total + part
        i, j = np.nonzero(total >= least - _SLACK) if least is not None else np.divmod(np.arange(total.size), total.shape[1])
        score = total[i, j] if least is not None else total.reshape(-1)
        for p in places or []:
            score = rounded(score, p)
        i, j = pa.array(i), pa.array(j)
        return pa.table({c: x[c].take(i) for c in scope} | {"a": x["key"].take(i), "b": y["key"].take(j), "score": pa.array(score)}).cast(declared)

    def read(batches):
        for batch in batches:
            for pair in batch.select(["left", "right"]).to_pylist():
                tables = []
                for at in (pair["left"], pair["right"]):
                    fs, name = filesystem(at["path"])
                    with fs.open_input_file(name) as file:
                        tables.append(pa.Table.from_batches([pa.ipc.open_file(file).get_batch(at["number"])]))
                yield from run(*tables).to_batches()

    alone = deals.where("p = 1 and q = 1")
    small = (df.join(alone.select(*scope), scope, "left_semi").groupBy(*scope) for df in (left, right))
    found = next(small).cogroup(next(small)).applyInArrow(run, schema)
    many = deals.where("p > 1 or q > 1")
    pairs = many.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
    if not pairs:
        return found
    stored = [_stored(df.join(many, scope).select(*scope, F.pmod(F.xxhash64("key"), n).alias("block"), *df.columns[len(scope) :]), scope, side) for df, n, side in ((left, "p", "left"), (right, "q", "right"))]
    tasks = max(-(-pairs // TASK_PAIRS), min(pairs, 4 * left.sparkSession.sparkContext.defaultParallelism))
    return found.unionByName(stored[0].join(stored[1], scope).select("left", "right").repartition(tasks).mapInArrow(read, schema))


def similar_sets(left: DataFrame, right: DataFrame, scope: list[str], least: float) -> DataFrame:
    """scope, a, b and similarity of the pairs of keys whose sets have a Dice similarity of at least ``least`` (above 0).

    Both sides have scope, key and grams, an array without repeated elements; a key stands once in its scope. Empty arrays and null
    keys or scopes match nothing. Equal sets under many keys are as many pairs: ask for distinct sets and join keys to them.
    """
    if not 0 < least <= 1:
        raise ValueError("the least similarity lies above 0 and is 1 at most")
    sides = [df.select(*scope, "key", "grams") for df in (left, right)]
    counts = settled(sides[0].unionByName(sides[1]).select(F.explode("grams").alias("gram")).groupBy("gram").count(), "elements")
    if counts.count() <= BROADCAST_ELEMENTS:
        counts = F.broadcast(counts)
    a, b = (_postings(df, scope, counts, least, side) for df, side in zip(sides, "ab"))
    if _dense(sides, a, b, scope):
        full = [df.where(F.size("grams") > 0).where(reduce(lambda c, d: c & d, (F.col(k).isNotNull() for k in [*scope, "key"]))).select(*scope, "key", F.array("grams").alias("sets")) for df in sides]
        return block_scores(*full, scope, [1.0], least).withColumnRenamed("score", "similarity")
    n, m = F.size("a.grams"), F.size("b.grams")
    ratio = least / (2 - least)
    sized = (m >= n * ratio - _SLACK) & (n >= m * ratio - _SLACK)
    met = a.join(b, [*scope, "gram"]).where(sized & (F.col("gram") == F.get(F.array_intersect("a.first", "b.first"), F.lit(0))))
    score = 2.0 * F.size(F.array_intersect("a.grams", "b.grams")) / (n + m)
    return met.select(*scope, F.col("a.key").alias("a"), F.col("b.key").alias("b"), score.alias("similarity")).where(F.col("similarity") >= least - _SLACK)


def _dense(sides: list[DataFrame], a: DataFrame, b: DataFrame, scope: list[str]) -> bool:
    """If comparing all sets of each scope by blocks costs less than comparing the pairs that meet at rare elements."""
    def pairs(x: DataFrame, y: DataFrame, by: list[str]) -> int:
        return x.groupBy(*by).agg(F.count("*").cast("double").alias("n")).join(y.groupBy(*by).agg(F.count("*").cast("double").alias("m")), by).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0

    return pairs(*sides, scope) < DENSE * pairs(a, b, [*scope, "gram"])


def _linked_names(left: DataFrame, right: DataFrame, scope: list[str], least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of different names (scope, a, b and similarity), and the ids of each name on both sides (scope, key and id)."""
    named = [df.select(*scope, text.normalize_name(F.coalesce("name", F.lit(""))).alias("key"), "id") for df in (left, right)]
    sets = [settled(df.select(*scope, "key").distinct().withColumn("grams", name_grams(F.col("key"))), "names") for df in named]
    return settled(similar_sets(*sets, scope, least), "links"), *named


def similar_names(left: DataFrame, right: DataFrame, scope: list[str], least: float) -> DataFrame:
    """scope, old_id, new_id and similarity of names alike by bigrams. Both sides have scope, id and name. Names are compared once,
    however many ids they have."""
    found, *named = _linked_names(left, right, scope, least)
    old, new = (df.withColumnsRenamed({"key": key, "id": i}) for df, key, i in zip(named, "ab", ("old_id", "new_id")))
    return found.join(old, [*scope, "a"]).join(new, [*scope, "b"]).select(*scope, "old_id", "new_id", "similarity")


def _greedy(links: list[tuple], old: dict, new: dict):
    """The pairs of ids that taking the best again and again gives, of links (score, a, b) of names and the ids of each name. Of equal
    scores the smallest old id goes first, with the smallest new one."""
    levels = defaultdict(list)
    for score, a, b in links:
        levels[score].append((a, b))
    old, new = ({k: sorted(v, reverse=True) for k, v in x.items()} for x in (old, new))
    for score in sorted(levels, reverse=True):
        ends = defaultdict(list)
        for a, b in levels[score]:
            if old[a] and new[b]:
                ends[a].append(b)
        heads = [(old[a][-1], a) for a in ends]
        heapq.heapify(heads)
        while heads:
            i, a = heapq.heappop(heads)
            ends[a] = [b for b in ends[a] if new[b]]
            if not ends[a]:
                continue
            b = min(ends[a], key=lambda b: new[b][-1])
            old[a].pop()
            yield i, new[b].pop(), score
            if old[a]:
                heapq.heappush(heads, (old[a][-1], a))


def matched_names(left: DataFrame, right: DataFrame, scope: list[str], least: float, places: int = 6) -> DataFrame:
    """scope, old_id, new_id and score: the names alike by bigrams one to one, the most alike first, by similarities rounded to ``places``.

    Names with many ids aren't made pairs of ids first: a task matches the links of names of a scope, with the ids that each name has.
    Scopes with more than ``TASK_LINKS`` links and ids are matched in rounds by Spark."""
    found, old, new = _linked_names(left, right, scope, least)
    links = found.select(*scope, "a", "b", F.round("similarity", places).alias("score"))
    none = F.lit(None)
    kind = left.schema["id"].dataType
    rows = links.select(*scope, "a", "b", "score", none.cast(kind).alias("id"))
    rows = rows.unionByName(old.select(*scope, F.col("key").alias("a"), none.cast("string").alias("b"), none.cast("double").alias("score"), "id"))
    rows = rows.unionByName(new.select(*scope, none.cast("string").alias("a"), F.col("key").alias("b"), none.cast("double").alias("score"), "id"))
    sizes = settled(rows.groupBy(*scope).agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > TASK_LINKS).select(*scope)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*scope).schema), f"old_id {kind.simpleString()}", f"new_id {kind.simpleString()}", "score double"])

    def run(table: pa.Table) -> pa.Table:
        links, old, new = [], defaultdict(list), defaultdict(list)
        for a, b, score, i in zip(*(table[c].to_pylist() for c in ("a", "b", "score", "id"))):
            if score is not None:
                links.append((score, a, b))
            elif b is None:
                old[a].append(i)
            else:
                new[b].append(i)
        columns = list(zip(*_greedy(links, old, new))) or [()] * 3
        made = {c: pa.array([table[c][0].as_py()] * len(columns[0]), table.schema.field(c).type) for c in scope}
        kinds = (table.schema.field("id").type, table.schema.field("id").type, pa.float64())
        return pa.table(made | {c: pa.array(x, k) for c, x, k in zip(("old_id", "new_id", "score"), columns, kinds)})

    small = rows.join(F.broadcast(large), scope, "left_anti").groupBy(*scope).applyInArrow(run, schema)
    if large.isEmpty():
        return small
    pairs = links.join(F.broadcast(large), scope, "left_semi").join(old.withColumnsRenamed({"key": "a", "id": "old_id"}), [*scope, "a"]).join(new.withColumnsRenamed({"key": "b", "id": "new_id"}), [*scope, "b"])
    return small.unionByName(one_to_one(pairs.select(*scope, "old_id", "new_id", "score"), scope))


def pigeonhole(weights: list[float], free: float, least: float) -> float:
    """The similarity that at least one of several parts of a weighted sum must reach for the sum to reach ``least``, if all other
    parts, of weight ``free``, are 1."""
    return max(0.0, (least - free) / math.fsum(weights) - _SLACK)


def candidates(old: DataFrame, new: DataFrame, scope: list[str], parts: dict[str, Column], least: float) -> DataFrame:
    """scope, old_id and new_id of pairs that have at least one part alike by ``least`` or more. Both sides have scope and x, a struct
    with an id; ``parts`` are sets made from x. Equal sets are compared once, under a number, so pairs don't carry them."""
    def found(grams: Column) -> DataFrame:
        sides = [df.select(*scope, F.col("x.id").alias(i), F.array_sort(grams).alias("grams")).where(F.size("grams") > 0) for df, i in ((old, "old_id"), (new, "new_id"))]
        sets = [settled(df.select(*scope, "grams").distinct().withColumn("key", F.monotonically_increasing_id()), "sets") for df in sides]
        a, b = (df.join(x.withColumnRenamed("key", k), [*scope, "grams"]).drop("grams") for df, x, k in zip(sides, sets, "ab"))
        return similar_sets(*sets, scope, least).join(a, [*scope, "a"]).join(b, [*scope, "b"]).select(*scope, "old_id", "new_id")

    return reduce(DataFrame.unionByName, map(found, parts.values())).distinct()


def one_to_one(scores: DataFrame, scope: list[str]) -> DataFrame:
    """The pairs (scope, old_id, new_id, score) that taking the best pair again and again would give, ties by the ids.

    A pair that is the best one of both its ends is among them, whatever else is; those pairs are taken at once, the pairs that
    share an end with one go, and so on. The work of a round is shuffled by both ends; only counts reach the driver.
    """
    left = settled(scores.select(*scope, "old_id", "new_id", "score"), "pairs")
    taken = None
    while not left.isEmpty():
        best = {side: W.partitionBy(*scope, side).orderBy(F.desc("score"), "old_id", "new_id") for side in ("old_id", "new_id")}
        marked = left.withColumns({"o": F.row_number().over(best["old_id"]) == 1, "n": F.row_number().over(best["new_id"]) == 1})
        picked = settled(marked.where("o and n").select(*left.columns), "picked")
        taken = picked if taken is None else taken.unionByName(picked)
        for side in ("old_id", "new_id"):
            left = left.join(picked.select(*scope, side), [*scope, side], "left_anti")
        left = settled(left.select(*scores.select(*scope, "old_id", "new_id", "score").columns), "pairs")
    return left if taken is None else taken

