"""Operator 12: ranked lexical search by a two-level quantised index.

The index has a row for each block of documents. Its second level is exact: the terms of the block, and how often each document
holds which. Its first level is small: for each term the documents that hold it, and for each of these one byte, the term's
impact in units of ``STEP``, rounded upwards. An impact is what one unit of a term's weight adds to a score; it depends on the
document only.

Bytes times weights, summed, are an upper bound of a score; one unit less for each term is a lower bound. For all documents of a
block and all items at once that is a product of two matrices of whole numbers, exact in doubles. A task keeps the ``k``th
lower bound of each item that it has met, and gives the documents whose upper bound reaches it; of all tasks' documents those
stay that reach the ``k``th lower bound over all. These are scored exactly, by integers, on the second level, and ranked.
Nothing is cut before: a document with a rank has an upper bound of at least the ``k``th score, which is at least that bound.

Items are taken in chunks, of which each task holds one: their number grows with the number and the bytes of the items.

Defined results: a null text has no terms, and a document without any isn't counted; items without terms have no documents;
rows of items that are equal are one item; repeated documents, and documents that share an id, each have a rank; of equal scores
the smaller id goes first, null ids last; a text may be of any length; empty tables give an empty table; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.bpe import Numbers
from quillspark.llm.cluster import discard, map_arrow, staged, texts_of

#: Fixed values of the score: impacts are below SCALE; B of a hundred parts of the weight of a document's length go by its length.
SCALE, B = 1_000_000, 50
#: The unit of the first level: 255 of them reach SCALE.
STEP = SCALE // 255 + 1
#: Documents and terms with repeats after which a block is closed; items and bytes of items of a chunk.
BLOCK_DOCS, BLOCK_TERMS, CHUNK_ITEMS, CHUNK_BYTES = 1024, 1_000_000, 256, 1 << 22
#: Candidates that a task holds before it gives them out, and candidates that are sent to all tasks (16 bytes each).
HELD, BROADCAST = 1_000_000, 500_000

#: Digits, letters and all that is not ASCII make terms; A to Z in lower case.
_TABLE = bytes((c + 32 if 0x41 <= c <= 0x5A else c) if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


EXACT = "block long, holding long, words long, ids {kind}, n binary, terms binary, at binary, term binary, tf binary"
BYTES = "block long, documents int, terms binary, at binary, document binary, impact binary"


def exact_level(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a block: documents that hold a term, terms with repeats, ids and n of all documents, the distinct terms, and for each
    document, from ``at``, numbers of terms and how often it holds them."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = TaskContext.get().partitionId(), 0
        ids, counts, numbers, number, words_held = [], [], [], Numbers(), 0

        def block() -> pa.RecordBatch:
            n = np.array(counts, np.int64)
            key = np.repeat(np.arange(len(n)), n) * len(number) + np.concatenate(numbers)
            key, tf = np.unique(key, return_counts=True)
            at = np.searchsorted(key, np.arange(len(n) + 1) * len(number)) if len(number) else np.zeros(len(n) + 1, np.int64)
            packed = (n.astype("<u4"), b" ".join(number), at.astype("<u4"), (key % max(1, len(number))).astype("<u4"), tf.astype("<u4"))
            columns = [pa.array([x], pa.int64()) for x in (part << 32 | blocks, int((n > 0).sum()), int(n.sum()))]
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(ids))
            return pa.RecordBatch.from_arrays([*columns, lists, *(pa.array([bytes(x)], pa.binary()) for x in packed)], ["block", "holding", "words", "ids", "n", "terms", "at", "term", "tf"])

        for batch in batches:
            for i, text in enumerate(texts_of(batch.column(1))):
                words = terms_of(text)
                ids.append(batch.column(0).slice(i, 1))
                counts.append(len(words))
                numbers.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                words_held += len(words)
                if len(ids) >= BLOCK_DOCS or words_held >= BLOCK_TERMS:
                    yield block()
                    ids, counts, numbers, number, words_held, blocks = [], [], [], Numbers(), 0, blocks + 1
        if ids:
            yield block()

    return map_arrow(rows, run, EXACT.format(kind=f"array<{dict(rows.dtypes)['id']}>"))


def _array(batch: pa.RecordBatch, name: str, i: int, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[i].as_py(), kind)


def _terms(batch: pa.RecordBatch, i: int) -> list[bytes]:
    return batch.column(batch.schema.get_field_index("terms"))[i].as_py().split()


class Corpus:
    """What scores take from the whole corpus: documents that hold a term, and terms with repeats."""

    def __init__(self, documents: int, words: int):
        self.documents, self.words = documents, words

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """20 times what a document's length adds to its term counts."""
        return np.array([20 * (100 - B + B * x * self.documents // self.words) if x else 0 for x in n.tolist()], np.int64)

    def impacts(self, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.int64)
        return 1000 * SCALE * tf // (1000 * tf + lengths)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


def byte_level(exact: DataFrame, corpus: Corpus) -> DataFrame:
    """A row a block: the number of documents, the distinct terms, and for each term, from ``at``, documents and impacts as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, at, term, tf = (_array(batch, c, i, "<u4") for c in ("n", "at", "term", "tf"))
                document = np.repeat(np.arange(len(n)), np.diff(at.astype(np.int64)))
                impact = -(-corpus.impacts(tf, corpus.lengths(n)[document]) // STEP)
                order = np.argsort(term, kind="stable")
                terms = batch.column(batch.schema.get_field_index("terms"))[i].as_py()
                starts = np.searchsorted(term[order], np.arange(len(terms.split()) + 1))
                packed = (terms, starts.astype("<u4"), document[order].astype("<u4" if len(n) > 1 << 16 else "<u2"), impact[order].astype("u1"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([len(n)], pa.int32()), *(pa.array([bytes(x)], pa.binary()) for x in packed)], ["block", "documents", "terms", "at", "document", "impact"])

    return map_arrow(exact.select("block", "n", "terms", "at", "term", "tf"), run, BYTES)


class Index:
    """Both levels in the shared folder."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text"):
        self.exact = staged(exact_level(docs, doc_id, text), "exact")
        found = self.exact.agg(F.sum("holding"), F.sum("words")).first()
        self.corpus = Corpus(found[0] or 0, found[1] or 0)
        self.bytes = staged(byte_level(self.exact, self.corpus), "impacts")


class Chunk:
    """Some items: the number of each of their terms, and the terms of each."""

    def __init__(self, texts: list[str | None]):
        self.number = Numbers()
        self.of = [sorted({self.number[t] for t in terms_of(text)}) for text in texts]

    def weights(self, by_term: dict[int, int]) -> np.ndarray:
        """Terms by items, zero where an item lacks a term."""
        out = np.zeros((len(self.number), len(self.of)))
        for i, terms in enumerate(self.of):
            out[terms, i] = [by_term.get(t, 0) for t in terms]
        return out


def _document_counts(level: DataFrame, chunk: Chunk) -> dict[int, int]:
    """How many documents hold each term of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(chunk.number), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                each = np.diff(_array(batch, "at", i, "<u4").astype(np.int64))
                terms = [(chunk.number[t], j) for j, t in enumerate(_terms(batch, i)) if t in chunk.number]
                if terms:
                    mine, theirs = map(list, zip(*terms))
                    found[mine] += each[theirs]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["t", "df"])

    rows = map_arrow(level.select("terms", "at"), run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    return {r["t"]: r["df"] for r in rows.collect()}  # a row a term of the chunk


def _candidates(level: DataFrame, chunk: Chunk, weights: np.ndarray, k: int) -> DataFrame:
    """item, block, document, upper and lower of what reaches the task's own kth lower bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(chunk.of), k))
        held, size = [], 0
        reached = lambda c: c[:, c[3] >= np.maximum(best.min(1), 1)[c[0].astype(np.int64)]]

        def batch_of(found: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["item", "block", "document", "upper", "lower"])

        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column(batch.schema.get_field_index("documents"))[i].as_py()
                at = _array(batch, "at", i, "<u4").astype(np.int64)
                terms = [(chunk.number[t], j) for j, t in enumerate(_terms(batch, i)) if t in chunk.number]
                if not terms:
                    continue
                mine, theirs = map(np.array, zip(*terms))
                lengths = at[theirs + 1] - at[theirs]
                stop = np.cumsum(lengths)
                entries = np.repeat(at[theirs] - stop + lengths, lengths) + np.arange(stop[-1])
                document = _array(batch, "document", i, "<u4" if n > 1 << 16 else "<u2")[entries]
                matrix = np.zeros((n, len(mine)))
                matrix[document, np.repeat(np.arange(len(mine)), lengths)] = _array(batch, "impact", i, "u1")[entries]
                own = weights[mine]
                upper = matrix @ own * STEP
                rows, items = np.nonzero(upper >= np.maximum(best.min(1), 1))
                if not len(rows):
                    continue
                some, place = np.unique(rows, return_inverse=True)
                lower = upper[some] - (matrix[some] > 0) @ own * (STEP - 1)
                best = -np.partition(-np.concatenate([best, np.maximum(lower, 0).T], 1), k - 1, 1)[:, :k]
                block = batch.column(0)[i].as_py()
                held.append(np.array([items, np.full(len(rows), block), rows, upper[rows, items], lower[place, items]], np.int64))
                held[-1] = reached(held[-1])
                size += held[-1].shape[1]
                if size > HELD:
                    held = [reached(np.concatenate(held, 1))]
                    size = held[0].shape[1]
                    if size > HELD // 2:
                        yield batch_of(held[0])
                        held, size = [], 0
        if held:
            yield batch_of(reached(np.concatenate(held, 1)))

    return map_arrow(level, run, "item long, block long, document long, upper long, lower long")


def _scores(exact: DataFrame, candidates: DataFrame, corpus: Corpus, chunk: Chunk, weights: np.ndarray) -> DataFrame:
    """item, doc_id and score of candidates, by the second level. A block has at most its documents times the chunk's items."""
    wanted = candidates.groupBy("block").agg(F.collect_list("item").alias("item"), F.collect_list("document").alias("document"))
    if candidates.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    rows = exact.join(wanted, "block").select("ids", "n", "terms", "at", "term", "tf", "item", "document")
    kind = exact.schema["ids"].dataType.elementType
    whole = weights.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, at, term, tf = (_array(batch, c, i, "<u4") for c in ("n", "at", "term", "tf"))
                mine = np.array([chunk.number.get(t, -1) for t in _terms(batch, i)], np.int64)
                items, documents = (batch.column(batch.schema.get_field_index(c))[i].values.to_numpy() for c in ("item", "document"))
                lengths, score = corpus.lengths(n), np.zeros(len(items), np.int64)
                order = np.argsort(documents, kind="stable")
                for d, some in zip(*_groups(documents, order)):
                    own = slice(at[d], at[d + 1])
                    t = mine[term[own]]
                    impact = corpus.impacts(tf[own], lengths[d])[t >= 0]
                    score[some] = impact @ whole[np.ix_(t[t >= 0], items[some])]
                ids = batch.column(0)[i].values.take(pa.array(documents))
                yield pa.RecordBatch.from_arrays([pa.array(items), ids, pa.array(score)], ["item", "doc_id", "score"])

    return map_arrow(rows, run, f"item long, doc_id {kind.simpleString()}, score long")


def _groups(values: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Each different value and the places where it stands."""
    cut = np.flatnonzero(np.diff(values[order])) + 1
    parts = np.split(order, cut)
    return [int(values[p[0]]) for p in parts], parts


def _top(rows: DataFrame, k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _searched(index: Index, items: list[tuple], kind: str, k: int) -> DataFrame:
    spark: SparkSession = index.exact.sparkSession
    chunk = Chunk([text for _, text in items])
    weights = chunk.weights({t: index.corpus.weight(df) for t, df in _document_counts(index.bytes, chunk).items()})
    found = staged(_candidates(index.bytes, chunk, weights, k), "candidates")
    least = _top(found.select("item", "lower"), k, F.desc("lower")).groupBy("item").agg(F.when(F.count("*") == k, F.min("lower")).otherwise(1).alias("least"))
    reached = staged(found.join(F.broadcast(least), "item").where(F.col("upper") >= F.col("least")).select("item", "block", "document"), "reached")
    scores = _scores(index.exact, reached, index.corpus, chunk, weights).where("score > 0")
    top = staged(_top(scores, k, F.desc("score"), F.col("doc_id").asc_nulls_last()), "ranked")
    discard(found, reached)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], f"item long, item_id {kind}")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked(index: Index, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` documents with the highest score above zero for each item."""
    spark, given = items.sparkSession, items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).distinct()
    kind = dict(given.dtypes)["item_id"]
    size = given.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    chunks = max(1, math.ceil(size["n"] / CHUNK_ITEMS), math.ceil((size["bytes"] or 0) / CHUNK_BYTES))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {index.exact.schema['ids'].dataType.elementType.simpleString()}, score long")
    for c in range(chunks):
        some = [tuple(r) for r in given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).collect()]
        if some and index.corpus.words:
            out = out.unionByName(_searched(index, some, kind, k))
    return out
