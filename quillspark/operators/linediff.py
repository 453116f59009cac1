"""Line differences of pairs of texts.

Texts up to ``whole`` lines are compared as they are, by the shortest script of removed and added lines. Longer ones are cut at anchors
first: lines that stand once on each side, as many of them as keep their order. Spark finds those by grouping lines, and the gaps
between them are compared on their own, so that a long text is many rows. Then a script isn't always the shortest: a moved block
may be anchored where fewer lines would stay. Texts are made twice: to set long ones apart, and to compare the others, whose lines
aren't shuffled.

The shortest script of a gap is found in memory in proportion to its lines, by halving it at the middle of a shortest path.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import let
from quillspark.shared import settled

#: Lines of texts that are compared whole, and of the batches that a task hands back.
WHOLE, BATCH = 2_000, 10_000


def lines_of(text: Column) -> Column:
    """The lines of a text; a line feed at its end begins no other, and no text has none."""
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # of the parts the last one is empty if the text ends in a line feed
    cut = lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x)
    return F.coalesce(let(F.split(plain, "\n"), cut), F.array().cast("array<string>"))


def split_lines(text: str | None) -> list[str]:
    """``lines_of`` of a text in a task."""
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return lines if lines[-1] else lines[:-1]


def _middle(a: list, b: list, i: int, n: int, j: int, m: int) -> tuple[int, int, int, int]:
    """Both ends of the snake in the middle of a shortest path through a[i:n] and b[j:m], which differ at both ends."""
    width, height = n - i, m - j
    odd, most = (width - height) % 2, (width + height + 1) // 2
    ahead, back = {1: 0}, {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or k != d and ahead[k - 1] < ahead[k + 1] else ahead[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < width and y < height and a[i + x] == b[j + y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            other = width - height - k
            if odd and abs(other) < d and x + back[other] >= width:
                return i + x0, j + y0, i + x, j + y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or k != d and back[k - 1] < back[k + 1] else back[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < width and y < height and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            other = width - height - k
            if not odd and abs(other) <= d and x + ahead[other] >= width:
                return n - x, m - y, n - x0, m - y0
    raise AssertionError("a path always exists")


def kept_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """The places of lines that stay, in a shortest script from a to b."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if i < n and j < m:
            x, y, u, v = _middle(a, b, i, n, j, m)
            out += [(x + k, y + k) for k in range(u - x)]
            todo += [(i, x, j, y), (u, n, v, m)]
    return sorted(out)


def rising(values: list[int]) -> list[int]:
    """The places of a longest rising run of different numbers."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        before[i] = ends[at - 1] if at else -1
        tops[at:at + 1], ends[at:at + 1] = [v], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _anchors(lines: DataFrame, key: str) -> DataFrame:
    """key, gap (from 1) and the places a and b where each anchor stands."""
    once = lines.groupBy(key, "line").agg(F.count_if("old").alias("n"), F.count_if(~F.col("old")).alias("m"), F.max(F.when(F.col("old"), F.col("i"))).alias("a"), F.max(F.when(~F.col("old"), F.col("i"))).alias("b"))
    found = once.where("n = 1 and m = 1").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("x"))
    kind = dict(lines.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x in zip(batch.column(0), batch.column(1).to_pylist()):
                kept = [x[i] for i in rising([p["b"] for p in x])]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(kept), k.type), pa.array(range(1, len(kept) + 1), pa.int32()), *(pa.array([p[c] for p in kept], pa.int32()) for c in "ab")], [key, "gap", "a", "b"])

    return found.mapInArrow(run, f"{key} {kind}, gap int, a int, b int")


def _gaps(texts: DataFrame, key: str) -> DataFrame:
    """key, first places a and b, and lines x and y of each gap of long texts; an anchor is the first line of its gap."""
    each = texts.select(key, F.lit(True).alias("old"), F.posexplode("x").alias("i", "line")).unionByName(texts.select(key, F.lit(False).alias("old"), F.posexplode("y").alias("i", "line")))
    marks = _anchors(each, key)
    marks = marks.select(key, F.lit(True).alias("old"), F.col("a").alias("i"), "gap").unionByName(marks.select(key, F.lit(False).alias("old"), F.col("b").alias("i"), "gap"))
    order = W.partitionBy(key, "old").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = each.join(marks, [key, "old", "i"], "left").withColumn("gap", F.coalesce(F.last("gap", ignorenulls=True).over(order), F.lit(0)))
    side = lambda old: F.array_sort(F.collect_list(F.when(F.col("old") == old, F.struct("i", "line"))))
    sides = rows.groupBy(key, "gap").agg(side(True).alias("p"), side(False).alias("q"))
    return sides.select(key, F.coalesce(F.get("p.i", F.lit(0)), F.lit(0)).alias("a"), F.coalesce(F.get("q.i", F.lit(0)), F.lit(0)).alias("b"), F.col("p.line").alias("x"), F.col("q.line").alias("y"))


def _script(x: list[str], y: list[str], a: int, b: int) -> Iterator[tuple]:
    """type, old_line, new_line and content of each line of a shortest script; ``a`` and ``b`` lines stand before."""
    i, j = 0, 0
    for p, q in [*kept_pairs(x, y), (len(x), len(y))]:
        yield from (("removed", a + n + 1, None, x[n]) for n in range(i, p))
        yield from (("added", None, b + n + 1, y[n]) for n in range(j, q))
        if p < len(x):
            yield "unchanged", a + p + 1, b + q + 1, x[p]
        i, j = p + 1, q + 1


def _scripts(gaps: Iterator[tuple], key: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The scripts of (key, first places a and b, x, y), with gap (a + b) and at (the place in its script), in batches of many of them."""
    names, kinds = [key, "gap", "at", "type", "old_line", "new_line", "content"], (kind, *[pa.int32()] * 2, pa.string(), *[pa.int32()] * 2, pa.string())
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
    out: list[tuple] = []
    for k, a, b, x, y in gaps:
        out += [(k, a + b, at, *line) for at, line in enumerate(_script(x, y, a, b))]
        if len(out) >= BATCH:
            yield made(out)
            out = []
    if out:
        yield made(out)


def line_diff(texts: DataFrame, old: str = "old_text", new: str = "new_text", key: str = "id", whole: int = WHOLE) -> DataFrame:
    """key, place, type (added, removed or unchanged), old_line, new_line and content of each line of each pair of texts; ``key`` tells
    pairs apart. Lines that go stand before those that come in their place."""
    texts = texts.select(key, old, new)
    kind = dict(texts.dtypes)[key]
    schema = f"{key} {kind}, gap int, at int, type string, old_line int, new_line int, content string"

    def pairs(batch: pa.RecordBatch, long: bool) -> Iterator[tuple]:
        for k, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = split_lines(x), split_lines(y)
            if (max(len(x), len(y)) > whole) == long:
                yield k, x, y

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, x, y in pairs(batch, True):
                yield pa.RecordBatch.from_arrays([pa.array([k], batch.column(0).type), *(pa.array([z], pa.list_(pa.string())) for z in (x, y))], [key, "x", "y"])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _scripts(((k, 0, 0, x, y) for k, x, y in pairs(batch, False)), key, batch.column(0).type)

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _scripts(zip(*(c.to_pylist() for c in batch.columns)), key, batch.column(0).type)

    line = ["type", "old_line", "new_line", "content"]
    rows = texts.mapInArrow(short, schema).select(key, F.col("at").alias("place"), *line)
    long = settled(texts.mapInArrow(apart, f"{key} {kind}, x array<string>, y array<string>"), "long")
    if long.isEmpty():
        return rows
    place = F.row_number().over(W.partitionBy(key).orderBy("gap", "at")) - 1
    return rows.unionByName(_gaps(long, key).mapInArrow(gaps, schema).select(key, place.alias("place"), *line))
