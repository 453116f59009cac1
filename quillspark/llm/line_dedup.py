"""Operator 8: line dedup over the whole corpus by a deletion-neighbourhood join.

A line is what stands between line feeds; it is compared by its words (between ASCII white space, case kept). Edits are
word insertions, deletions and substitutions; the bound is none for lines of fewer than ``least_words`` words and one for
others, which leaves at least four fifths of the words alone. A line is removed if an earlier line, by (doc_id, line
number), is within the bound of it. Blank lines stay.

Equal lines are merged first. Two lines within one edit agree on their first or on their last half, so only lines that
share such a half with another go on. These emit a key for each variant with one word deleted, and one for the line itself:
lines with the same variant and the same deleted place differ by a substitution, a line that equals another's variant by an
insertion. The earliest line of each group is aggregated and compared with the others; pairs within a group are never
listed. The edit distance of what is found is verified on the words.

Defined results: a null text has no lines, and stays null; rows that share an id, or have none, are documents of their own, ordered
by a hash of the text, null ids after all others; rows that are equal in id and text are one document, and keep the same lines; an
empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import discard, map_arrow, staged, texts_of
from quillspark.llm.shingles import WordHashes, mixed

LEAST_WORDS = 5
BLANK = " \t\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_GROWN = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    base = int(_INVERSE) if inverse else _BASE
    while len(_GROWN[inverse]) < n:
        last = _GROWN[inverse]
        _GROWN[inverse] = np.concatenate([last, last * np.uint64(pow(base, len(last), 1 << 64))])
    return _GROWN[inverse][:n]


def _sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash of a word sequence, modulo 2**64."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(len(h)), dtype=np.uint64)])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sequence_hash(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mixed(sums + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def line_keys(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lines whose words' hashes follow each other in ``h``: the hash of each line, and its four half keys, which hold the
    side, the number of words of the shorter line, and the half."""
    starts = np.r_[0, ends[:-1]]
    sums, back = _sums(h), _powers(len(h) + 1, inverse=True)
    part = lambda i, j: (sums[j] - sums[i]) * back[i]
    keys = np.empty((len(ends), 4), np.uint64)
    for i, m in enumerate((ends - starts, ends - starts - 1)):
        tag = (2 * m).astype(np.uint64)
        keys[:, 2 * i] = part(starts, starts + m // 2) + tag
        keys[:, 2 * i + 1] = part(ends - m // 2, ends) + tag + np.uint64(1)
    return _signed(sequence_hash(part(starts, ends), ends - starts)), _signed(mixed(keys))


def variants(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and deleted places: the line itself (-1), then the line without each of its words."""
    n, s = len(h), _sums(h)
    without = s[:n] + (s[n:] - s[1:]) * _INVERSE
    return np.concatenate([_signed(sequence_hash(s[n:], np.array([n]))), _signed(sequence_hash(without, np.array([n - 1])))]), np.arange(-1, n, dtype=np.int32)


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """If two word sequences differ by at most one insertion, deletion or substitution."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _words(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").split()


def lines_of(docs: DataFrame, least_words: int) -> DataFrame:
    """o (order: null id last, doc_id, text hash, line), h, n and halves (null for short lines) of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows, places, words, counts = [], [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n") if text else []):
                        found = line.split()
                        if found:
                            words += found
                            rows.append(k)
                            places.append(i)
                            counts.append(len(found))
                if not rows:
                    continue
                n = np.array(counts)
                h, halves = line_keys(known.of(words), np.cumsum(n))
                full = n >= least_words
                offsets = pa.array(np.r_[0, np.cumsum(4 * full)].astype(np.int32), mask=np.r_[~full, False])
                rows = pa.array(rows, pa.int32())
                halves = pa.ListArray.from_arrays(offsets, pa.array(halves[full].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(2).take(rows), pa.array(places, pa.int32()), pa.array(h), pa.array(n.astype(np.int32)), halves], names)

    names = ["doc_id", "t", "line", "h", "n", "halves"]
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    rows = map_arrow(rows, run, f"doc_id {kind}, t long, line int, h long, n int, halves array<long>")
    return rows.select(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t", "line").alias("o"), "h", "n", "halves")


def later_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """h of the distinct lines that have an earlier line within one edit. ``firsts``: h, o, n, halves."""
    long_lines = firsts.where("halves is not null")
    halves = long_lines.select("h", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").count().where("count > 1").select("half")
    candidates = halves.join(shared, "half", "left_semi").select("h").distinct()
    wanted = long_lines.select("h", "o").join(candidates, "h")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found = [text.split("\n")[i] for text, i in zip(texts_of(batch.column(0)), batch.column(2).field("line").to_pylist())]
            words = [_words(line) for line in found]
            own, _ = line_keys(known.of([x for line in words for x in line]), np.cumsum([len(line) for line in words], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.string())], ["h", "o", "line"]).filter(pa.array(own == batch.column(1).to_numpy()))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = [variants(known.of(_words(line))) for line in part.column(2).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(k) for k, _ in found]))
                keys, places = (pa.array(np.concatenate(x)) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([keys, places, part.column(0).take(at), part.column(1).take(at)], ["key", "place", "h", "o"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within_one_edit(_words(x), _words(y)) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield batch.select([0]).filter(pa.array(ok, pa.bool_()))

    order = wanted.schema["o"].dataType.simpleString()
    by_doc = wanted.select(F.col("o.doc_id").alias("doc_id"), F.col("o.t").alias("t"), "h", "o").groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "o")).alias("lines"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    # of texts that share an id and a hash the one that has the line at that place counts: pick() compares the line's hash
    fetched = texts.join(by_doc, texts["doc_id"].eqNullSafe(by_doc["doc_id"]) & (texts["t"] == by_doc["t"])).select("text", F.explode("lines").alias("x")).select("text", "x.h", "x.o")
    fetched = map_arrow(fetched.where(F.size(F.split("text", "\n")) > F.col("o.line")), pick, f"h long, o {order}, line string")
    lines = staged(fetched.dropDuplicates(["h"]), "lines")  # equal rows have fetched a line more than once
    rows = staged(map_arrow(lines, split, f"key long, place int, h long, o {order}"), "variants")

    earliest = rows.where("place >= 0").groupBy("key", "place").agg(F.min(F.struct("o", "h")).alias("e"), F.count("*").alias("c")).where("c > 1").select("key", "place", F.col("e.h").alias("first"))
    changed = rows.where("place >= 0").join(earliest, ["key", "place"]).where("h != first").select("h", "first")
    whole = rows.where("place = -1").select("key", F.col("h").alias("wh"), F.col("o").alias("wo"))
    inserted = rows.where("place >= 0").join(whole, "key").where("h != wh").select(F.when(F.col("o") > F.col("wo"), F.col("h")).otherwise(F.col("wh")).alias("h"), F.when(F.col("o") > F.col("wo"), F.col("wh")).otherwise(F.col("h")).alias("first"))
    pairs = changed.unionByName(inserted).distinct()
    pairs = pairs.join(lines.select("h", F.col("line").alias("x")), "h").join(lines.select(F.col("h").alias("first"), F.col("line").alias("y")), "first")
    out = staged(map_arrow(pairs.select("h", "x", "y"), verify, "h long").distinct(), "later")
    discard(lines, rows)
    return out


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the lines removed from ``text``, and the columns n_lines (not blank) and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    found = lines_of(docs, least_words)
    firsts = staged(found.groupBy("h").agg(F.min("o").alias("o"), F.first("n").alias("n"), F.first("halves").alias("halves")), "firsts")
    later = later_lines(docs, firsts)
    kept = firsts.select("h", "o").join(later, "h", "left_anti")
    names = docs.columns
    i, t, places = ("_" * max(map(len, names)) + x for x in ("id", "t", "kept"))  # longer than any column's name
    kept = kept.groupBy(F.col("o.doc_id").alias(i), F.col("o.t").alias(t)).agg(F.collect_list("o.line").alias(places))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, keep in zip(texts_of(batch.column(at)), texts_of(batch.column(len(names)))):
                lines, keep = text.split("\n") if text is not None else [], set(keep or ())
                full = [x.strip(BLANK) != "" for x in lines]
                texts.append(None if text is None else "\n".join([x for i, (x, f) in enumerate(zip(lines, full)) if not f or i in keep]))
                counts.append(sum(full))
                removed.append(sum(f and i not in keep for i, f in enumerate(full)))
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"])

    joined = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(t)), "left").select(*names, places)
    return map_arrow(joined, rebuild, docs.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed")).schema)
