"""Word shingles as 64-bit hashes, for use within tasks."""

from __future__ import annotations

import numpy as np
import xxhash

REMEMBERED = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words; those of recent words are remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return,
    with A to Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """The sorted hashes of the distinct ``k``-word shingles; the whole sequence is the only one if it is shorter."""
    h = known.of(words_of(text))
    if not len(h):
        return h
    if len(h) < k:
        return mixed(np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64))
    out = mixed(h[: len(h) - k + 1] * _ODD[0])
    for j in range(1, k):
        out = mixed(out + h[j : len(h) - k + 1 + j] * _ODD[j % len(_ODD)])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]
