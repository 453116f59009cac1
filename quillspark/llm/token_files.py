"""Operator 3: token ids in binary files of independent zstandard frames.

A file is a plain zstandard stream: one frame for each run of whole documents, then two skippable frames. The first holds
the document index (doc_id, number of ids), the last the seek table of the public seekable format: compressed size, plain
size and checksum of every frame, and a fixed footer. A reader fetches the footer, then only the frames it needs, and
checks each one.

The order is that of ascending ids over all files, rows of one id following each other by a hash of the text: rows are
range-partitioned by both and each task writes files under temporary names, which a rename completes. A file that has
grown to ``roll_bytes`` is followed by another. A manifest (one row a file) holds what a reader needs to know.

Defined results: null and empty texts give the end id only; a document of any length lies in one frame; repeated rows and
equal ids are all written; null ids come first; an empty table gives no file and an empty result; other columns aren't read.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bpe import Numbers
from quillspark.llm.cluster import filesystem, fresh_dir

#: Fixed values of the public seekable zstandard format, and the neighbouring magic number for our document index.
SEEK_MAGIC, FOOTER_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A5D
#: Plain bytes after which a frame is closed, bytes after which a file is, and pieces of text that a worker remembers.
FRAME_BYTES, ROLL_BYTES, REMEMBERED = 1 << 18, 1 << 29, 1_000_000
#: Texts that are encoded at once, and pieces that the library is asked for at once.
TEXTS, PIECES = 2_000, 5_000

MANIFEST = "part int, file int, path string, documents long, tokens long, bytes long"


class ChunkEncoder:
    """The tokenizers library, asked once for each piece of text between white space.

    That gives what encoding whole texts gives for vocabularies that drop white space between words: the pattern leaves white
    space out, so no token spans it, and no normalization looks across it. Both are read from the vocabulary file; pieces
    with characters that Python takes for blanks but the pattern doesn't are parted at ASCII white space only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks take the cores
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]] if spec.get("normalizer") else []
        split = [p for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"]
        if set(steps) - {"NFC", "Replace", "Lowercase"} or len(split) != 1 or not split[0]["invert"] or split[0]["behavior"] != "Removed" or r"[^\s\p{L}\p{N}]+" not in split[0]["pattern"]["Regex"]:
            raise ValueError(f"{path} isn't a vocabulary that drops white space between words")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: An added token stands between pieces that are encoded at once; pieces with its first characters are encoded alone.
        self.between = next(t["content"] for t in spec["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]))
        self.between_id = self.tokenizer.token_to_id(self.between)
        self.added = tuple(t["content"] for t in spec["added_tokens"])
        #: For words that need no normalization and no splitting.
        bytes_only = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel")
        self.bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": bytes_only, "truncation": None, "padding": None}))
        self.number, self.ids, self.ends = Numbers(), bytearray(), array("q", [0])

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_pieces(self, tokenizer, pieces: list[str]) -> Iterator[bytes]:
        """The ids of each piece, none of which holds an added token."""
        for i in range(0, len(pieces), PIECES):
            ids = np.array(tokenizer.encode_batch_fast([self.between.join(pieces[i : i + PIECES])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.r_[np.flatnonzero(ids == self.between_id), len(ids)] * 4
            data, start = ids.tobytes(), 0
            for end in ends.tolist():
                yield data[start:end]
                start = end + 4

    def remember(self, new: list[str | int]) -> None:
        """Appends the ids of new pieces, in their order; a number is the end id itself."""
        parts, wanted = [], set()
        for p in new:
            if isinstance(p, int):
                parts.append((p, ""))
                continue
            # marks stand apart only from a letter or digit before them: with other marks they form one run
            core = p.rstrip(MARKS)
            low = core.lower()
            if not low[-1:].isalnum():
                core, low = p, p.lower()
            # the lower case of these letters doesn't depend on what stands around them
            if core.isascii() or max(core) < BEYOND and max(low) < BEYOND:
                parts.append((low, p[len(core) :]))
                wanted.add(low)
            else:
                parts.append((core, p[len(core) :]))
                wanted.add(core)
            if len(core) < len(p):
                wanted.add(p[len(core) :])
        plain, odd, other = [], [], []
        known, before, ids, ends = {"": b""}, len(self.ends) - 1, self.ids, self.ends
        for x in wanted - {""}:
            at = self.number.get(x, before)
            if at < before:
                known[x] = bytes(ids[4 * ends[at] : 4 * ends[at + 1]])
            elif x.isalpha() and (x.isascii() or x == x.lower() and max(x) < BEYOND):
                plain.append(x)
            else:
                (odd if "<" in x and any(a in x for a in self.added) else other).append(x)
        known |= zip(plain, self.encode_pieces(self.bare, plain))
        known |= zip(other, self.encode_pieces(self.tokenizer, other))
        known |= {x: self.packed(self.tokenizer.encode(x, add_special_tokens=False).ids) for x in odd}
        found = [self.packed([core]) if isinstance(core, int) else known[core] + known[tail] if tail else known[core] for core, tail in parts]
        self.ends.extend((np.cumsum([len(x) // 4 for x in found]) + self.ends[-1]).tolist())
        self.ids += b"".join(found)

    def encode_batch(self, texts: list[str | None], end: int) -> list[bytes]:
        """The ids (unsigned 32-bit, little-endian) of each text, and the end id."""
        split = [pieces_of(t) for t in texts]
        for pieces in split:
            pieces.append(end)
        if len(self.number) > REMEMBERED:
            self.number, self.ids, self.ends = Numbers(), bytearray(), array("q", [0])
        sizes = np.array([len(pieces) for pieces in split])
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, sizes.sum())
        before = len(self.ends) - 1
        if len(self.number) > before:
            self.remember(list(islice(self.number, before, None)))
        ends = np.frombuffer(self.ends, np.int64)
        start, lengths = ends[numbers], ends[numbers + 1] - ends[numbers]
        stop = np.cumsum(lengths)
        found = np.frombuffer(self.ids, "<u4")[np.repeat(start - stop + lengths, lengths) + np.arange(stop[-1])].tobytes()
        cuts = np.r_[0, stop[np.cumsum(sizes) - 1]] * 4
        return [found[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


#: Characters that Python's str.split takes for white space and the pattern doesn't.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def pieces_of(text: str | None) -> list[str]:
    """The parts of a text between white space."""
    if not text:
        return []
    if any(c in text for c in SEPARATORS):
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    return text.split()


#: Below it are Latin letters with a code point of their own, which composing leaves alone.
BEYOND = "\u0250"
#: Marks that the pattern parts from letters and digits before them; none begins another of its alternatives or an added token.
MARKS = ".,;:!?#$%&*()-_=+/[]{}@~^"


@lru_cache(maxsize=2)
def loaded(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


class FrameWriter:
    """Writes the frames of one file to a stream that can only be appended to."""

    def __init__(self, out, level: int = 3):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids, self.null, self.counts, self.frame_of = array("q"), array("B"), array("q"), array("L")
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.tokens += len(ids) // 4
        self.frame_of.append(len(self.frames))
        self.open.append(ids)
        self.open_bytes += len(ids)
        if self.open_bytes >= FRAME_BYTES:
            self.close_frame()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def close_frame(self) -> None:
        if self.open:
            plain = b"".join(self.open)
            packed = self.packer.compress(plain)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.write(packed)
            self.open, self.open_bytes = [], 0

    def close(self) -> None:
        self.close_frame()
        columns = zip((self.ids, self.counts, self.frame_of, self.null), ("<i8", "<i8", "<u4", "u1"))
        index = struct.pack("<Q", len(self.ids)) + b"".join(np.array(a, kind).tobytes() for a, kind in columns)
        index = self.packer.compress(index)
        self.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.write(struct.pack("<II", SEEK_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC))


class FrameReader:
    """Reads documents of one file; fetches and checks only the frames that hold them."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, io.SEEK_END)
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        start = size - 9 - 12 * n
        self.frames = list(struct.iter_unpack("<III", self.at(start, 12 * n)))
        self.offsets = np.r_[0, np.cumsum([f[0] for f in self.frames])].astype(int).tolist()
        packed = self.at(self.offsets[-1], start - 8 - self.offsets[-1])
        if struct.unpack("<I", packed[:4])[0] != INDEX_MAGIC:
            raise ValueError("no document index")
        plain = zstandard.ZstdDecompressor().decompress(packed[8:])
        k = struct.unpack("<Q", plain[:8])[0]
        self.counts = np.frombuffer(plain, "<i8", k, 8 + 8 * k)
        self.frame_of = np.frombuffer(plain, "<u4", k, 8 + 16 * k)
        null = np.frombuffer(plain, np.uint8, k, 8 + 20 * k)
        self.ids = [None if z else i for i, z in zip(np.frombuffer(plain, "<i8", k, 8).tolist(), null.tolist())]
        self.first = np.searchsorted(self.frame_of, np.arange(len(self.frames)))

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, i: int) -> bytes:
        packed, plain, check = self.frames[i]
        data = zstandard.ZstdDecompressor().decompress(self.at(self.offsets[i], packed), max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return data

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) of all documents in order."""
        k = 0
        for i in range(len(self.frames)):
            data, at = self.frame(i), 0
            while k < len(self.ids) and self.frame_of[k] == i:
                size = 4 * int(self.counts[k])
                yield self.ids[k], data[at : at + size]
                k, at = k + 1, at + size

    def document(self, k: int) -> bytes:
        """The ids of the document at place ``k``; one frame is decompressed."""
        i = int(self.frame_of[k])
        at = 4 * int(self.counts[self.first[i] : k].sum())
        return self.frame(i)[at : at + 4 * int(self.counts[k])]


def write_tokens(
    df: DataFrame, vocabulary: str, end: int, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, files: int | None = None, roll_bytes: int = ROLL_BYTES
) -> DataFrame:
    """Writes the files (``files`` tasks, or as many as Spark shuffles to) and returns their manifest in order, with ``start``:
    the ids in all files before.

    The manifest has one row a file, so it may pass through the driver; documents don't.
    """
    spark = df.sparkSession
    folder = folder or fresh_dir(spark, "tokens")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = MANIFEST.replace(",", "").split()[::2]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = loaded(vocabulary), TaskContext.get()
        fs, base = filesystem(folder)
        part, file, writer, hidden = task.partitionId(), 0, None, ""
        path = lambda: f"part-{part:06d}-{file:04d}.zst"

        def close() -> pa.RecordBatch:
            writer.close()
            writer.out.close()
            fs.move(hidden, f"{base}/{path()}")  # a second attempt writes the same bytes
            row = {"part": part, "file": file, "path": f"{folder}/{path()}", "documents": len(writer.ids), "tokens": writer.tokens, "bytes": writer.bytes}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([(n, pa.string() if n == "path" else pa.int32() if n in ("part", "file") else pa.int64()) for n in names]))

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                for i, ids in zip(some.column(0).to_pylist(), encoder.encode_batch(some.column(1).to_pylist(), end)):
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        hidden = f"{base}/_{path()}-{task.taskAttemptId()}"
                        writer = FrameWriter(fs.open_output_stream(hidden, compression=None))
                    writer.add(i, ids)
                    if writer.bytes >= roll_bytes:
                        yield close()
                        writer, file = None, file + 1
        if writer is not None:
            yield close()

    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    order = ["id", F.xxhash64("text")]
    rows = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    found = sorted(tuple(r) for r in rows.mapInArrow(write, MANIFEST).collect())
    start, out = 0, []
    for r in found:
        out.append((*r, start))
        start += r[names.index("tokens")]
    return spark.createDataFrame(out, MANIFEST + ", start long")


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array<long>) of all documents in the files."""
    files = max(1, manifest.count())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    part = []
                    for i, ids in FrameReader(f).documents():
                        part.append((i, int(start), len(ids) // 4, zlib.crc32(ids), np.frombuffer(ids, "<u4").astype(np.int64)) if with_ids else (i, int(start), len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(part) >= 2_000:
                            yield frame(part)
                            part = []
                    if part:
                        yield frame(part)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def frame(part: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(part, columns=names)
        out["doc_id"] = pd.array([r[0] for r in part], "Int64")
        return out

    return manifest.repartition(files, "part", "file").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
