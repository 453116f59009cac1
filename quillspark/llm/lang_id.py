"""Operator 5: language identification by averaged hashed subword embeddings and a linear softmax.

A word's features are the hashes of its runs of 1 to 4 letters, with marks for its ends, and of the whole word. A document
is the mean of its features' embeddings; a linear layer and softmax follow. Embeddings and layer are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows (``per_language``). A part of the sample is held back: on it
a temperature is fitted, so that scores are calibrated, and the score below which a prediction is rejected, chosen so that
``keep`` of the right predictions stay. For prediction, embeddings and layer are folded into one table of a row a feature.

Defined results: texts that are null or have no letter get ``und``, score 0 and are rejected; texts may be of any length;
repeated rows get equal results; with no labelled row at all everything is ``und``; an empty table gives an empty table;
columns named like the outputs are replaced, others pass through. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import map_arrow, texts_of

UNKNOWN = "und"
BUCKETS, SIZE, PER_LANGUAGE, KEEP = 1 << 16, 16, 400, 0.999
REMEMBERED = 500_000
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def features(word: str) -> list[int]:
    """The buckets of a word."""
    marked = f"<{word}>".encode("utf-8", "surrogatepass").decode("utf-8", "replace")
    parts = {marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1)} | {marked}
    return [zlib.crc32(p.encode()) % BUCKETS for p in sorted(parts)]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text and their shares."""
    found: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for b in features(word):
            found[b] += n
    buckets = np.array(sorted(found), np.int64)
    shares = np.array([found[b] for b in buckets.tolist()], float)
    return buckets, shares / max(1.0, shares.sum())


@dataclass
class LanguageModel:
    """languages; table: a row of logits a bucket; bias; temperature; least: the score below which predictions are rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 1.0, keep: float = KEEP, seed: int = 5) -> LanguageModel:
    """Trains on (lang, buckets, shares). Every fifth example of a language is for calibration."""
    languages = sorted({x[0] for x in examples})
    code = {x: i for i, x in enumerate(languages)}
    seen: Counter = Counter()
    train, held = [], []
    for lang, buckets, shares in examples:
        seen[lang] += 1
        (held if seen[lang] % 5 == 0 else train).append((code[lang], buckets, shares))
    draw = np.random.default_rng(seed)
    e = draw.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE))
    w, bias = draw.normal(0, 0.1, (SIZE, len(languages))), np.zeros(len(languages))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in draw.permutation(len(train)):
            y, buckets, shares = train[i]
            now = rate * (1 - done / steps)
            done += 1
            x = shares @ e[buckets]
            z = x @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= now * np.outer(x, p)
            bias -= 0.1 * now * p
            e[buckets] -= (20 * now) * shares[:, None] * back
    table = e @ w
    best, least = 1.0, 0.0
    if held:
        z = np.array([s @ table[b] + bias for _, b, s in held])
        y = np.array([h[0] for h in held])

        def soft(t: float) -> np.ndarray:
            q = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return q / q.sum(axis=1, keepdims=True)

        best = min(np.geomspace(0.25, 8, 41), key=lambda t: -np.log(np.maximum(soft(t)[np.arange(len(y)), y], 1e-12)).mean())
        p = soft(best)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        least = min(0.5, float(np.quantile(right, 1 - keep))) if len(right) else 0.0
    return LanguageModel(languages, table.astype(np.float32), bias, float(best), least)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, keep: float = KEEP) -> LanguageModel:
    """A model from ``per_language`` rows of each language at most, those with the least hashes of their ids; only rows with
    text and lang. What reaches the driver is bounded by that number times the number of languages."""
    rows = docs.where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    steps = 1 << 30
    share = F.create_map(*(F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, int(min(1.0, 1.5 * per_language / n + 20 / n) * steps))))
    picked = rows.withColumn("rank", F.xxhash64("doc_id", "text")).where(F.pmod("rank", F.lit(steps)) < share[F.col("lang")]).select("rank", "lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counted(t) for t in batch["text"]]
            packed = {"buckets": [b.astype(np.int32).tobytes() for b, _ in found], "shares": [s.astype(np.float32).tobytes() for _, s in found]}
            yield pd.DataFrame({"rank": batch["rank"], "lang": batch["lang"]} | packed)

    top = picked.withColumn("rank", F.pmod("rank", F.lit(steps))).mapInPandas(run, "rank long, lang string, buckets binary, shares binary").orderBy("rank").limit(2 * per_language * len(counts))
    seen: Counter = Counter()
    examples = []
    for r in top.collect():
        seen[r["lang"]] += 1
        if seen[r["lang"]] <= per_language and r["buckets"]:
            examples.append((r["lang"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32)))
    return fit(examples, keep=keep) if examples else LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)


class Scorer:
    """Predicts with a model; the sums of logits of recent words are remembered."""

    def __init__(self, model: LanguageModel):
        self.model, self.at = model, {}
        self.sums = np.zeros((1024, len(model.bias) + 1))

    def place(self, word: str) -> int:
        if len(self.at) >= REMEMBERED:
            self.at.clear()
        i = self.at[word] = len(self.at)
        if i >= len(self.sums):
            self.sums = np.vstack([self.sums, np.zeros_like(self.sums)])
        buckets = features(word)
        self.sums[i, :-1], self.sums[i, -1] = self.model.table[buckets].sum(axis=0), len(buckets)
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        if len(self.at) + len(words) > REMEMBERED:
            self.at.clear()
        at = self.at
        s = self.sums_of([at[w] if w in at else self.place(w) for w in words])
        z = (s[:-1] / s[-1] + self.model.bias) / self.model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        i = int(p.argmax())
        return self.model.languages[i], float(p[i])

    def sums_of(self, places: list[int]) -> np.ndarray:
        return self.sums[places].sum(axis=0)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    kept, shared = docs.select(*names), docs.sparkSession.sparkContext.broadcast(model)  # a table of BUCKETS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t) for t in texts_of(batch.column(names.index("text")))]
            langs, scores = [x[0] for x in found], [x[1] for x in found]
            out = [lang == UNKNOWN or s < shared.value.least for lang, s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    for f in schema:
        f.nullable = True
    return map_arrow(kept, run, schema)
