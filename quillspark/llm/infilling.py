"""Operator 13: fill-in-the-middle transformation over an index of distinct texts.

A text is cut at two of the ends of its lines, drawn by the hash of a seed and the document's id; what stands between them moves
to the end. Texts that are equal have equal ends of lines, so those are computed once for each distinct text: texts are grouped
by their content (by all of it: the hash that goes with it only names the group), and the code point where each line ends
goes into an Elias-Fano list, of about 2 + log2(length / lines) bits a line. Documents meet their list by the hash of their
text, in a join of which Spark splits the documents of a frequent text, and read from it the two ends that were drawn.

A hash that two distinct texts share names no list; the ends of those texts are computed where the documents are.

Defined results: a null text is taken as empty; empty texts, and texts that hold one of the marks, stay plain; a null id counts
as the empty string when it is hashed, and rows that share an id draw by the same hash; repeated rows each give a row;
texts may be of any length; an empty table gives an empty table; other columns pass through, but for those that clash with an
output column's name, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import map_arrow, staged

#: The marks before a prefix, a suffix and a middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def line_ends(text: str) -> np.ndarray:
    """The code points before the end of each line; a line ends after its line feed, the last one with the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(codes == 10) + 1
    return ends if not len(codes) or len(ends) and ends[-1] == len(codes) else np.r_[ends, len(codes)]


class EliasFano:
    """An ascending list of numbers: the low bits of each side by side, the high bits as the places of ones."""

    def __init__(self, n: int, low_bits: int, data: bytes):
        self.n, self.low_bits = n, low_bits
        cut = (n * low_bits + 7) // 8
        self.low, self.high = data[:cut], np.frombuffer(data, np.uint8, offset=cut)

    @staticmethod
    def packed(values: np.ndarray) -> tuple[int, int, bytes]:
        """Length, low bits and bytes of the list of ``values``."""
        n = len(values)
        if not n:
            return 0, 0, b""
        low_bits = max(0, int(values[-1] // n).bit_length() - 1)
        low = (values[:, None] >> np.arange(low_bits)) & 1
        high = np.zeros(int(values[-1] >> low_bits) + n, np.uint8)
        high[(values >> low_bits) + np.arange(n)] = 1
        return n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()

    def select(self, i: int) -> int:
        """The number at place ``i``."""
        ones = np.cumsum(np.bitwise_count(self.high))
        byte = int(np.searchsorted(ones, i, "right"))
        before = int(ones[byte - 1]) if byte else 0
        bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        high = 8 * byte + int(bits[i - before]) - i
        first, last = i * self.low_bits // 8, ((i + 1) * self.low_bits + 7) // 8
        low = int.from_bytes(self.low[first:last], "little") >> i * self.low_bits % 8 & (1 << self.low_bits) - 1
        return high << self.low_bits | low


def text_name(text: Column) -> Column:
    return F.xxhash64(text)


def boundary_lists(texts: DataFrame, name: Callable[[Column], Column] = text_name) -> DataFrame:
    """name, n, low_bits and list for each ``name`` of a column ``text`` that one distinct text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [EliasFano.packed(line_ends(text.as_py())) for text in batch.column(1)]
            n, low_bits, lists = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(low_bits, pa.int32()), pa.array(lists, pa.binary())], ["name", "n", "low_bits", "list"])

    text = F.coalesce("text", F.lit(""))
    # grouped by content: equal texts are merged within tasks before they are shuffled
    distinct = texts.select(text.alias("text")).distinct().select(name(F.col("text")).alias("name"), "text")
    lists = map_arrow(distinct, run, "name long, n long, low_bits int, list binary")
    first = [F.first(c).alias(c) for c in ("n", "low_bits", "list")]
    return lists.groupBy("name").agg(*first, F.count("*").alias("texts")).where("texts = 1").drop("texts")


def draws(doc_id: str | None, seed: int) -> list[int]:
    """Four numbers below 2**32."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def infilled(df: DataFrame, seed: int = 7, rate: int = 100, suffix_first: int = 50, doc_id: str = "doc_id", text: str = "text", name: Callable[[Column], Column] = text_name) -> DataFrame:
    """``df`` with n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    Of a hundred documents ``rate`` are cut, and of those ``suffix_first`` have their suffix first.
    """
    kept = df.drop(*ADDED)
    lists = staged(boundary_lists(df.select(F.col(text).alias("text")), name), "boundaries")
    own, key, found = ("_" * max(map(len, kept.columns)) + x for x in ("name", "id", "list"))  # longer than any column's name
    given = kept.withColumn(own, name(F.coalesce(F.col(text), F.lit("")))).withColumn(key, F.col(doc_id).cast("string"))
    index = lists.select(F.col("name").alias(own), F.struct("n", "low_bits", "list").alias(found))
    joined = given.join(index, own, "left").select(*kept.columns, key, found)
    names, width, at = kept.columns, len(kept.columns), kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, i, ends in zip(batch.column(at), batch.column(width).to_pylist(), batch.column(width + 1)):
                value, ends = value.as_py() or "", ends.as_py()
                n, low_bits, packed = ends.values() if ends else EliasFano.packed(line_ends(value))
                h1, h2, h3, h4 = draws(i, seed)
                if not value or h3 % 100 >= rate or any(m in value for m in MARKS):
                    rows.append((n, "plain", None, None, value))
                    continue
                ends = EliasFano(n, low_bits, packed)
                first, last = (ends.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                prefix, middle, suffix = value[:first], value[first:last], value[last:]
                if h4 % 100 < suffix_first:
                    rows.append((n, "spm", first, last - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
                else:
                    rows.append((n, "psm", first, last - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
            made = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], [*names, *ADDED])

    empty = lambda kind: F.lit(None).cast(kind)
    schema = kept.select("*", *(empty(k).alias(c) for c, k in zip(ADDED, ("long", "string", "long", "long", "string")))).schema
    return map_arrow(joined, run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    first = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    cut, last = F.position(first, output), F.position(F.lit(MIDDLE), output)
    a = F.substring(output, F.lit(4), cut - 4)
    b = F.substring(output, cut + 3, last - cut - 3)
    middle = F.substring(output, last + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(a, middle, b)).otherwise(F.concat(b, middle, a))
