"""Operator 6: removal of byte strings that occur more than once, by distributed prefix doubling.

A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too. Ranking every byte position at each
doubling would write each of them several times (about 20 bytes each), so positions that can be judged in runs are judged
first; the positions left are ranked.

Pruning. The anchor of a string is the place in it whose run of ANCHOR bytes has the least hash (itself made by doubling), so
equal strings have their anchors at the same offset; consecutive strings mostly share theirs. The core of a block of
neighbouring strings is what all of them share, the span all that they cover. A block whose core occurs once is unique and
dropped; one whose span occurs again is past the threshold as a whole, and its bytes go; others are cut into smaller blocks
(STEPS). The first core is the anchor's run.

Doubling. What is left are the strings where a repeat begins or ends, one or two a block. Their positions get the rank of the eighth
of ``length`` that starts there. Then Spark sorts the pairs (rank at p, rank at p + k) for offsets k that double, and numbers
the different pairs in that order: the ranks of strings of twice the length. Positions whose pair occurs once are unique and
go no further; those that still share a rank at ``length`` bytes start repeated strings. The result is exact, up to 128-bit
hashes of the first pieces, cores apart, which only say what goes on.

Defined results: a null text is no bytes; texts shorter than ``length`` lose nothing; texts may be of any length; equal rows
repeat each other; null ids are ids like any other; an empty table gives an empty table; columns named like the outputs are
replaced, all others pass through. What is left of a text may not be valid UTF-8, so it is returned as binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import discard, staged
from quillspark.llm.order import ranks
from quillspark.llm.shingles import mixed

LENGTH, ANCHOR = 400, 32
#: Strings in a block, from round to round.
STEPS = (96, 24, 6, 2)
#: Bytes of a text that are worked on at once; positions within have 24 bits, hashes the other 40.
CHUNK = (1 << 24) - 1
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors(data: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, first, last): the strings that start at first to last have that anchor."""
    for at in range(0, max(1, len(data) - length + 1), CHUNK - length + 1):
        part = data[at : at + CHUNK]
        if len(part) < length:
            return
        h, reach = _BYTES[part], 1
        while reach < ANCHOR:
            h = mixed(h[:-reach] * np.uint64(0xC2B2AE3D27D4EB4F) + h[reach:])
            reach *= 2
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        wide, reach = length - ANCHOR + 1, 1
        while 2 * reach <= wide:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        rest = wide - reach
        key = np.minimum(key[: len(key) - rest], key[rest:])
        place = (key & np.uint64(0xFFFFFF)).astype(np.int64)
        cut = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1, len(place)]
        yield from zip((place[cut[:-1]] + at).tolist(), (cut[:-1] + at).tolist(), (cut[1:] - 1 + at).tolist())


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """t1, t2, anchor, lo, hi, core (of the anchor's run) and span (hashes)."""
    names = ["t1", "t2", "anchor", "lo", "hi", "core", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for k, text in enumerate(batch.column(2).to_pylist()):
                data = _bytes(text)
                for a, lo, hi in anchors(np.frombuffer(data, np.uint8), length):
                    for column, x in zip(out, (k, a, lo, hi, xxhash.xxh3_64_intdigest(data[a : a + ANCHOR]) - (1 << 63), xxhash.xxh3_128_digest(data[lo : hi + length] + (a - lo).to_bytes(4, "big")))):
                        column.append(x)
            rows = pa.array(out[0], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c, pa.int64()) for c in out[1:5]), pa.array(out[5], pa.binary())], names)

    return texts.mapInArrow(run, "t1 long, t2 long, anchor long, lo long, hi long, core long, span binary")


def _contexts(texts: DataFrame, active: DataFrame, length: int) -> DataFrame:
    """The active anchors' bytes: context starts at ``first``, the first byte of the anchor's first string. Equal texts are one
    row here before their anchors are joined to them."""
    texts = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    lists = active.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", "lo", "hi", "known")).alias("list"))
    names = ["t1", "t2", "anchor", "o1", "o2", "known", "first", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = _bytes(batch.column(2)[i].as_py())
                found = batch.column(3)[i].as_py()
                n = len(found)
                a, lo, hi = ([x[c] for x in found] for c in ("anchor", "lo", "hi"))
                columns = [[batch.column(0)[i].as_py()] * n, [batch.column(1)[i].as_py()] * n, a, [x - y for x, y in zip(a, hi)], [x - y for x, y in zip(a, lo)]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([x["known"] for x in found]), pa.array(lo, pa.int64()), pa.array([data[x : y + length] for x, y in zip(lo, hi)], pa.binary())], names)

    return texts.join(lists, ["t1", "t2"]).select("t1", "t2", "text", "list").mapInArrow(run, "t1 long, t2 long, anchor long, o1 long, o2 long, known boolean, first long, context binary")


def _blocks(rows: DataFrame, step: int, length: int) -> DataFrame:
    """The blocks of ``step`` offsets in each context, with their hashes: o1 to o2 is what the anchor has of a block, from the
    context that begins at offset ``of``."""
    names = ["t1", "t2", "anchor", "of", "o1", "o2", "known", "core", "span"]
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("t1", "t2", "anchor", "o1", "o2", "known", "first", "context")]
            out: list[list] = [[] for _ in names]
            for t1, t2, a, o1, o2, known, first, data in zip(*columns):
                for block in range(o1 // step, o2 // step + 1):
                    p, q = max(o1, block * step), min(o2, block * step + step - 1)
                    tag = block.to_bytes(4, "big")
                    # what all strings of the whole block share, so within the context whatever part of the block is here
                    core = xxhash.xxh3_64_intdigest(data[a - block * step - first : a - (block + 1) * step + 1 + length - first] + tag) - (1 << 63)
                    span = xxhash.xxh3_128_digest(data[a - q - first : a - p + length - first] + q.to_bytes(4, "big") + tag)
                    for column, x in zip(out, (t1, t2, a, o1, p, q, known, core, span)):
                        column.append(x)
                if len(out[0]) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return rows.mapInArrow(run, "t1 long, t2 long, anchor long, of long, o1 long, o2 long, known boolean, core long, span binary")


def offsets(length: int) -> tuple[int, tuple[int, int, int]]:
    """The length of the first pieces, and the offsets at which pairs of ranks are taken: two of one length make twice that
    length, but for the last, which overlap where ``length`` isn't eight pieces."""
    piece = -(-length // 8)
    return piece, (piece, 2 * piece, length - 4 * piece)


def _pieces(contexts: DataFrame, length: int) -> DataFrame:
    """t1, t2, p and a hash of the piece that starts at byte p, for all pieces of the strings in the contexts."""
    piece, (_, _, last) = offsets(length)
    starts = sorted({i * piece + j for i in range(4) for j in (0, last)})
    names = ["t1", "t2", "p", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                at, places, keys = [], [], []
                for k, (first, data) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    for p in sorted({x + y for x in starts for y in range(len(data) - length + 1)}):
                        at.append(k)
                        places.append(first + p)
                        keys.append(xxhash.xxh3_128_digest(data[p : p + piece]))
                rows = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(places, pa.int64()), pa.array(keys, pa.binary())], names)

    return contexts.select("t1", "t2", "first", "context").mapInArrow(run, "t1 long, t2 long, p long, key binary").distinct()


def _reranked(rows: DataFrame) -> DataFrame:
    """t1, t2, p and rank: the place of ``key`` in the sorted order of the keys that occur more than once; other rows go."""
    rows = staged(rows, "pairs")
    numbered = staged(ranks(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key"), "ranks")
    out = staged(rows.join(numbered, F.col("key") == F.col("k")).select("t1", "t2", "p", "rank"), "positions")
    discard(rows, numbered)
    return out


def doubled(contexts: DataFrame, length: int) -> DataFrame:
    """t1, t2 and p: the positions at which the contexts' strings start that start elsewhere too."""
    found = _reranked(_pieces(contexts, length))
    for k in offsets(length)[1]:
        after = found.select("t1", "t2", (F.col("p") - k).alias("p"), F.col("rank").alias("next"))
        pairs = found.join(after, ["t1", "t2", "p"]).select("t1", "t2", "p", F.struct("rank", "next").alias("key"))
        longer = _reranked(pairs)
        discard(found)
        found = longer
    return found


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """t1, t2 (hashes of a text) and the sorted spans (from, to) of its bytes that lie in repeated strings; spans may overlap."""
    texts = _hashed(docs).select("t1", "t2", "text")
    every = staged(_anchor_rows(texts, length), "anchors")

    # the anchors' runs: those that occur once are dropped, anchors whose span occurs again are done
    # (tables of hashes are staged before they are joined: beside an aggregate Spark wouldn't split a core with very many rows)
    cores = staged(every.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core"), "cores")
    rows = staged(every.join(cores, "core"), "anchors")
    discard(every, cores)
    spans = rows.groupBy("span").agg(F.count("*").alias("c"), F.min(F.struct("t1", "t2", "anchor", "lo", "hi", "core")).alias("one"))
    spans = staged(spans, "spans")
    again = spans.where("c > 1")
    done = rows.join(again.select("span"), "span").select("t1", "t2", F.col("lo").alias("from"), (F.col("hi") + length).alias("to")).distinct()
    parts = [staged(done, "spans")]
    open_rows = spans.where("c = 1").select("one.*").withColumn("known", F.lit(False))
    sources = again.select("one.*").join(open_rows.select("core").distinct(), "core", "left_semi").withColumn("known", F.lit(True))
    contexts = staged(_contexts(texts, open_rows.unionByName(sources), length), "contexts")
    discard(rows, spans)

    for step in STEPS:
        blocks = staged(_blocks(contexts, step, length), "blocks")
        cores = staged(blocks.groupBy("core").agg(F.count("*").alias("c"), F.min("known").alias("all_known")).where("c > 1 and not all_known").select("core"), "cores")
        kept = staged(blocks.join(cores, "core"), "blocks")
        discard(blocks, cores)
        spans = staged(kept.groupBy("span").agg(F.count("*").alias("c")).where("c > 1").select("span", F.lit(True).alias("again")), "spans")
        judged = staged(kept.join(spans, "span", "left").select("t1", "t2", "anchor", "of", "o1", "o2", "known", "core", F.coalesce("again", F.lit(False)).alias("again")), "judged")
        discard(kept, spans)
        parts.append(staged(judged.where("again and not known").select("t1", "t2", (F.col("anchor") - F.col("o2")).alias("from"), (F.col("anchor") - F.col("o1") + length).alias("to")), "spans"))
        # blocks go on where one of the same core is undecided; those that are decided are sources for it
        undecided = staged(judged.where("not again and not known").select("core").distinct(), "cores")
        blocks = judged.join(undecided, "core", "left_semi").select("t1", "t2", "anchor", F.col("of").alias("o1"), F.col("o1").alias("p"), F.col("o2").alias("q"), (F.col("known") | F.col("again")).alias("done"))
        start = F.col("anchor") - F.col("q")
        piece = F.expr(f"substring(context, cast(anchor - q - first + 1 as int), cast(q - p + {length} as int))")
        smaller = staged(contexts.join(blocks, ["t1", "t2", "anchor", "o1"]).select("t1", "t2", "anchor", F.col("p").alias("o1"), F.col("q").alias("o2"), F.col("done").alias("known"), start.alias("first"), piece.alias("context")), "contexts")
        discard(contexts, judged, undecided)
        contexts = smaller
    last = doubled(contexts, length)
    parts.append(last.select("t1", "t2", F.col("p").alias("from"), (F.col("p") + length).alias("to")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = staged(found.groupBy("t1", "t2").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans")), "repeats")
    discard(contexts, last, *parts[:-1])
    return found


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary)."""
    made = ["n_bytes", "n_removed", "n_spans", "kept"]
    docs = docs.drop(*made)
    names = docs.columns
    found = repeated(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(names.index("text")).to_pylist(), batch.column(len(names)).to_pylist()):
                data, kept, at, removed, runs = _bytes(text), [], 0, 0, 0
                end = -1
                for s in spans or ():
                    i, j = s["from"], s["to"]
                    if i > end:
                        runs += 1
                        kept.append(data[at:i])
                    removed += max(0, j - max(i, at))
                    at = end = max(at, j)
                kept.append(data[at:])
                for column, x in zip(out, (len(data), removed, runs, b"".join(kept))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], [*names, *made])

    schema = docs.select("*", *(F.lit(0).cast("long").alias(c) for c in made[:3]), F.lit(None).cast("binary").alias("kept")).schema
    # the row is one column while it is joined, so that none of its columns clashes with t1, t2 or spans
    rows = _hashed(docs.select(F.struct(*names).alias("row"), "text")).select("row", "t1", "t2").join(found, ["t1", "t2"], "left")
    return rows.select("row.*", F.col("spans").alias("_".join(["spans", *names]))).mapInArrow(run, schema)
