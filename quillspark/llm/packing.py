"""Operator 11: packing documents into sequences of a fixed length by concatenating and cutting.

The ids of all documents, each with an end id, form one stream in the order of the scan. Two passes give each document its
place in it: the first encodes the texts and writes, for each document, its part (the scan's partition) and the ids before it
in that part; the sums of the parts, one row each, then give every part its place. Windows of ``length`` ids are cut from the
stream. What is left at its end is cut at the powers of two that it is the sum of, so that no sequence needs padding.

No document is shuffled: which windows a document lies in follows from its place. ``sequences`` puts whole windows together
within tasks; only boundary records, the pieces of windows that end in another task's rows, are grouped by a shuffle.

Defined results: null and empty texts are the end id alone; a text of any length is cut wherever windows end; repeated rows and
rows that share an id, or have none, each lie in the stream once; an empty table gives no piece and no sequence; other columns
aren't read. Another layout of the input's files gives another order, and other cuts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bpe import PRE_TOKEN, PairIndexBPE
from quillspark.llm.cluster import map_arrow, staged

LENGTH = 1024
#: Characters of texts whose ids are given out at once.
BLOCK_CHARS = 4_000_000


class WholeTextBPE:
    """A byte-level vocabulary of the tokenizers library, applied by tiktoken, which takes the token with the lowest id first. That is
    the same where ids ascend in the order of merges; other vocabularies are refused. Strings of added tokens become those tokens."""

    def __init__(self, path: str):
        from tiktoken import Encoding

        self.pairs = spec = PairIndexBPE(path)
        if (np.diff(spec.made) <= 0).any() or len(spec.made) and spec.made[0] <= spec.byte_ids.max():
            raise ValueError(f"{path}: ids don't ascend in the order of merges")
        own = set(spec.added.values())
        ranks = {piece: i for i, piece in enumerate(spec.pieces) if piece and i not in own}
        self.encoding = Encoding("vocabulary", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens=spec.added)
        #: 16 bits hold an id of a small vocabulary.
        self.kind = "<u2" if len(spec.pieces) <= 1 << 16 else "<u4"

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all").astype(self.kind)
        except ValueError:  # a run of white space that is too long for its regular expressions
            return np.frombuffer(self.pairs.encode_batch([text])[0], np.int32).astype(self.kind)

    def encode_batch(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end``, and how many each has."""
        last = np.array([end], self.kind)
        found = [x for text in texts for x in (self.encode(text), last)]
        return np.concatenate(found), np.array([len(x) for x in found[::2]], np.int64) + 1


@lru_cache(maxsize=2)
def loaded(path: str) -> WholeTextBPE:
    return WholeTextBPE(path)


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text.as_py() or "")
        size += len(part[-1])
        if size >= BLOCK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_stream(df: DataFrame, vocabulary: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, part, before (ids of its part before it), n_tokens and ids (``width`` bytes each) of each document, in the shared
    folder. The vocabulary file must be at that path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, before = loaded(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            row = 0
            for texts in _blocks(batch.column(1)):
                ids, counts = codec.encode_batch(texts, end)
                stop = np.cumsum(counts)
                width = ids.itemsize
                packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((np.r_[0, stop] * width).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                same = lambda x: pa.array(np.full(len(counts), x, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(counts)), same(part), pa.array(before + stop - counts), pa.array(counts), same(width), packed], ["doc_id", "part", "before", "n_tokens", "width", "ids"])
                before += int(stop[-1])
                row += len(counts)

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return staged(map_arrow(rows, run, f"doc_id {kind}, part int, before long, n_tokens long, width int, ids binary"), "tokens")


def placed(stream: DataFrame) -> tuple[DataFrame, int]:
    """``stream`` with ``place``, the ids of the whole stream before each document, and the ids of all. One row a part reaches
    the driver, and is sent back to tasks; documents don't."""
    sums = sorted(tuple(r) for r in stream.groupBy("part").agg(F.sum("n_tokens")).collect())
    starts, total = [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    starts = stream.sparkSession.createDataFrame(starts, "part int, start long")
    return stream.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("before")).drop("start"), total


class Windows:
    """Where the sequences of a stream of ``total`` ids begin: windows of ``length``, then one for each binary digit of the rest."""

    def __init__(self, total: int, length: int):
        self.length, self.full = length, total // length
        rest, starts = total % length, [self.full * length]
        for bit in range(length.bit_length(), -1, -1):
            if rest >> bit & 1:
                starts.append(starts[-1] + (1 << bit))
        self.rest = np.array(starts, np.int64)

    def of(self, place: np.ndarray) -> np.ndarray:
        """The sequence that each place lies in."""
        return np.where(place < self.rest[0], place // self.length, self.full + np.searchsorted(self.rest, place, "right") - 1)

    def start(self, sequence: np.ndarray) -> np.ndarray:
        return np.where(sequence < self.full, sequence * self.length, self.rest[np.clip(sequence - self.full, 0, len(self.rest) - 1)])

    def cut(self, place: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, sequence, start and stop in the stream of the pieces of documents at ``place`` with ``n`` ids, at least one."""
        first = self.of(place)
        pieces = self.of(place + n - 1) - first + 1
        row = np.repeat(np.arange(len(n)), pieces)
        sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        return row, sequence, np.maximum(place[row], self.start(sequence)), np.minimum((place + n)[row], self.start(sequence + 1))


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    widths = batch.column(batch.schema.get_field_index("width")).to_pylist()
    return [np.frombuffer(x.as_buffer(), f"<u{w}") for x, w in zip(batch.column(batch.schema.get_field_index("ids")), widths)]


def pieces(stream: DataFrame, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece of a document, sequence_id and offset of where it lies, and,
    if asked for, ids (array<int>)."""
    rows, total = placed(stream)
    windows = Windows(total, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("place", "n_tokens"))
            row, sequence, start, stop = windows.cut(place, n)
            found = _ids(batch)
            parts = [found[r][i:j].astype("<u4") for r, i, j in zip(row.tolist(), (start - place[row]).tolist(), (stop - place[row]).tolist())]
            columns = [start - place[row], stop - start, np.array([zlib.crc32(p) for p in parts], np.int64), n[row], sequence, start - windows.start(sequence)]
            columns = [batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(row)), *map(pa.array, columns)]
            if with_ids:
                offsets = pa.array(np.r_[0, np.cumsum(stop - start)].astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*parts, np.empty(0, "<u4")]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    numbers = ", ".join(f"{c} long" for c in names[1:7])
    return map_arrow(rows.select("doc_id", "place", "n_tokens", "width", "ids"), run, f"doc_id {dict(stream.dtypes)['doc_id']}, {numbers}" + ", ids array<int>" * with_ids)


def sequences(stream: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id and ids (array<int>) of each sequence.

    A task joins the pieces of documents that follow each other in the stream; what it holds of a window when they don't, or
    when its rows end, is a boundary record. A sequence has at most ``length`` of them.
    """
    rows, total = placed(stream)
    windows = Windows(total, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin, at = [], 0, -1

        def records(last: bool) -> Iterator[pa.RecordBatch]:
            """The windows of what is held, but for the last one as long as it may go on."""
            nonlocal held, begin
            if held:
                ids = np.concatenate(held)
                _, sequence, start, stop = windows.cut(np.array([begin]), np.array([len(ids)]))
                whole = (start == windows.start(sequence)) & (stop == windows.start(sequence + 1))
                n = len(sequence) if last or whole[-1] else len(sequence) - 1
                done = int(stop[n - 1]) - begin if n else 0
                offsets = pa.array(np.r_[0, (stop - begin)[:n]].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids[:done].astype(np.int32)))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(sequence[:n]), pa.array((start - windows.start(sequence))[:n]), pa.array(whole[:n]), lists], ["sequence_id", "offset", "whole", "ids"])
                held, begin = [ids[done:]] if done < len(ids) else [], begin + done

        for batch in batches:
            for place, ids in zip(batch.column(batch.schema.get_field_index("place")).to_pylist(), _ids(batch)):
                if place != at:
                    yield from records(last=True)
                    begin = place
                held.append(ids)
                at = place + len(ids)
            yield from records(last=False)
        yield from records(last=True)

    made = staged(map_arrow(rows.select("place", "width", "ids"), run, "sequence_id long, offset long, whole boolean, ids array<int>"), "windows")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = made.where("not whole").groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    return made.where("whole").select("sequence_id", "ids").unionByName(joined)
