"""Operator 2: byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a block of texts are laid out as one symbol sequence. An index maps every mergeable pair
(by its rank) to the positions where it occurs. The lowest active rank is taken again and again, applied at all its
positions at once, and only the neighbours of merged positions get new entries in the index.

Defined results: a null text encodes as the empty text; an empty text gives no ids; texts may be of any length; repeated
rows are encoded alike; an empty table gives an empty table; all other columns pass through, and a column that clashes
with an output column's name is replaced.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import map_arrow

#: The pre-token pattern of byte-level BPE vocabularies of this kind.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that are worked on at once, and pre-tokens that a worker remembers.
BLOCK_CHARS, REMEMBERED = 12_000_000, 250_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte value in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def distinct(a: np.ndarray) -> np.ndarray:
    """The different values of ``a`` in ascending order."""
    a = np.sort(a)
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


class Numbers(dict):
    """Numbers what is looked up, in the order of first appearance."""

    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        return n


class PairIndexBPE:
    """A vocabulary file of the tokenizers library: byte-level BPE without normalizer, prefix space or byte fallback."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or model.get("end_of_word_suffix"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        size = 1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])])
        self.pieces: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.pieces[i] = bytes(value[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.pieces[i] = content.encode()
        self.byte_ids = np.array([ids[c] for c in letters], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        born = np.full(size, -1, np.int64)
        born[self.made[::-1]] = np.arange(len(merges) - 1, -1, -1)
        if len(np.unique(self.made)) != len(merges) or (np.maximum(born[self.left], born[self.right]) >= np.arange(len(merges))).any():
            raise ValueError(f"{path}: a merge comes before the merges that make its parts; ranks can't be applied in ascending order")
        keys = self.left << 32 | self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.pattern = regex.compile(PRE_TOKEN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: The number of each remembered pre-token (an added token is a tuple), and the ids of each number.
        self.number, self.packed = Numbers(), []

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 for a pair that no merge has."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids (int32, as bytes) of each pre-token."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = int(sizes.sum())
        if not n:
            return [b""] * len(words)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(sizes)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[ends[sizes > 0] - 1] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[(ends - sizes)[sizes > 0]] = -1
        live = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Positions whose pair with the next symbol is new go to the list of the pair's rank."""
            rank = self.ranks(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.r_[0, cut]].tolist() if len(rank) else [], np.split(at, cut)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(part)

        enter(np.flatnonzero(nxt >= 0).astype(np.int32))
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            a, b = self.left[r], self.right[r]
            at = parts[0] if len(parts) == 1 else distinct(np.concatenate(parts))
            at = at[live[at] & (sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at):  # in a run of one symbol every second pair goes
                at = np.sort(at)
                joined = np.r_[False, nxt[at[:-1]] == at[1:]]
                first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], live[gone], nxt[at] = self.made[r], False, after
            prv[after[after >= 0]] = at[after >= 0]
            before = prv[at]
            enter(distinct(np.concatenate([before[before >= 0], at[after >= 0]])))
        kept = np.r_[0, np.cumsum(live)][np.r_[0, ends]] * 4
        out = sym[live].tobytes()
        return [out[i:j] for i, j in zip(kept[:-1].tolist(), kept[1:].tolist())]

    def pre_tokens(self, text: str) -> list:
        if not (self.special and any(s in text for s in self.added)):
            return self.pattern.findall(text)
        return [w for i, p in enumerate(self.special.split(text)) for w in ([(p,)] if i % 2 else self.pattern.findall(p))]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids (int32, as bytes) of each text. Strings of added tokens become those tokens, as in the library."""
        if len(self.number) > REMEMBERED:
            self.number.clear()
            self.packed.clear()
        number, packed = self.number, self.packed
        numbered = [array("L", map(number.__getitem__, self.pre_tokens(text))) for text in texts]
        new = list(islice(number, len(packed), None))
        merged = self.merge([b"" if isinstance(w, tuple) else w.encode("utf-8", "surrogatepass") for w in new])
        packed += [np.int32(self.added[w[0]]).tobytes() if isinstance(w, tuple) else ids for w, ids in zip(new, merged)]
        return [b"".join(map(packed.__getitem__, words)) for words in numbered]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 become U+FFFD."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def loaded(path: str) -> PairIndexBPE:
    """One vocabulary for each worker and path."""
    return PairIndexBPE(path)


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in runs of about BLOCK_CHARS characters; what isn't worked on stays in Arrow's memory."""
    part, size = [], 0
    for text in texts:
        part.append(text.as_py() or "")
        size += len(part[-1])
        if size >= BLOCK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _encoded(codec: PairIndexBPE, texts: pa.Array) -> Iterator[list[bytes]]:
    for part in _blocks(texts):
        yield codec.encode_batch(part)


def _lists(found: list[bytes]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(x) // 4 for x in found])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with an array<int> column ``ids``. The vocabulary file must be at that path on every machine."""
    kept = df.drop(ids)
    schema = kept.select("*", F.lit(None).cast("array<int>").alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(vocabulary)
        for batch in batches:
            at = 0
            for found in _encoded(codec, batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(at, len(found))
                at += len(found)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(found)], [*batch.schema.names, ids])

    return map_arrow(kept, run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with a string column ``text`` made from an array<int> column. A null array decodes as the empty text."""
    kept = df.drop(text)
    schema = kept.select("*", F.lit(None).cast("string").alias(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(vocabulary)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            starts, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            ok = column.is_valid().to_pylist()
            out = [codec.decode(values[i:j]) if v else "" for i, j, v in zip(starts[:-1].tolist(), starts[1:].tolist(), ok)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, text])

    return map_arrow(kept, run, schema)


def encode_decode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` by one worker, which holds one vocabulary: ``df`` with ``ids`` and the text decoded from them.
    ``decoded`` may be ``text`` itself, which it then replaces."""
    kept = df.drop(*{ids, decoded} - {text})
    names = [c for c in kept.columns if c != decoded]
    schema = kept.select(*names, F.lit(None).cast("array<int>").alias(ids), F.lit(None).cast("string").alias(decoded)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(vocabulary)
        for batch in batches:
            at, passed = 0, batch.select(names)
            for found in _encoded(codec, batch.column(batch.schema.get_field_index(text))):
                part = passed.slice(at, len(found))
                at += len(found)
                texts = pa.array([codec.decode(np.frombuffer(x, np.int32)) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(found), texts], [*names, ids, decoded])

    return map_arrow(kept, run, schema)
