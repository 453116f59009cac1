"""Packing, lexical search and infilling against brute force, on random texts, odd rows and empty tables."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from awkward_rows import AWKWARD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import infilling, lexical, packing, queries

FOLDER = "/root/testdata/sf0.001"
BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  ", "a \n b", "\n\nx", "x\n\n  y\n", " \t z", "a<|endoftext|> b", " <|endoftext|>", "it's  'll\r\n", "\x1c a \x1d", " b  c", "日本語 テキスト", "<P>x", "y\n<S>\nz", "a\nb\nc", "\n", "one line\n", "<\nS>\nP>\n<P\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE)


def test_ids_are_those_of_the_library(library):
    r, codec = random.Random(3), packing.WholeTextBPE(BYTE)
    made = ["".join(r.choice(["a", "b ", "  ", "\n", "\t", " the", "'s", "9", "é", " ", "　", "<|endoftext|>", ".", "\x1d"]) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    long = ["a" * 30_000, " " * 1_500_000 + "x", "\n" * 20_000, "ab" * 20_000 + "!" * 20_000]
    ids, counts = codec.encode_batch([*ODD, *made, *long], 0)
    at = 0
    for text, n in zip([*ODD, *made, *long], counts.tolist()):
        assert ids[at : at + n].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], text
        at += n
    assert at == len(ids)


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, ids string").repartition(5)


@pytest.mark.parametrize("length", [7, 64, 1024])
def test_packing(spark, library, length):
    texts = [*AWKWARD, *((100 + i, t) for i, t in enumerate(ODD))]
    stream = packing.token_stream(documents(spark, texts), BYTE, end=0)
    rows = [r.asDict() for r in packing.pieces(stream, length).collect()]
    expected = collections.Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in texts)
    by_place, by_sequence = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), collections.defaultdict(list)
    got, open_ids = collections.Counter(), []
    for r in by_place:
        assert r["start"] == len(open_ids) and r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
        assert r["offset"] == len(by_sequence[r["sequence_id"]])
        by_sequence[r["sequence_id"]] += r["ids"]
        open_ids += r["ids"]
        if len(open_ids) == r["doc_tokens"]:
            got[r["doc_id"], tuple(open_ids)] += 1
            open_ids = []
    assert got == expected and not open_ids
    sizes = [len(by_sequence[i]) for i in sorted(by_sequence)]
    assert sorted(by_sequence) == list(range(len(sizes)))
    assert all(n == length or n < length and n.bit_count() == 1 for n in sizes), "no sequence needs padding"
    assert {r["sequence_id"]: r["ids"] for r in packing.sequences(stream, length).collect()} == dict(by_sequence)


def test_packing_of_nothing(spark):
    stream = packing.token_stream(documents(spark, []), BYTE, end=0)
    assert packing.pieces(stream).count() == packing.sequences(stream).count() == 0


def test_packing_query(spark, library):
    rows = collections.defaultdict(list)
    for r in queries.op11_packing(spark, FOLDER).collect():
        rows[r["doc_id"]].append(r)
    for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids, at = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(rows.pop(d["doc_id"]), key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += r["length"]
        assert at == len(ids)
    assert not rows


def ranks_of(docs, items, k):
    """Scores by their definition."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, words = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items:
        scored = []
        for i, c in counts:
            m, score = 50 + 50 * sum(c.values()) * n_docs // max(1, words), 0
            for t in set(terms(text)) & set(c):
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out[item] = [(j, None if null else i, -s) for j, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def found_by(index, items, k):
    out = collections.defaultdict(list)
    for r in lexical.ranked(index, items, k).collect():
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return {i: sorted(v) for i, v in out.items()}


def test_lexical_search(spark, monkeypatch):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "x9", "A"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    make = lambda n: r.choice([" ", "-", ", "]).join(r.choices(vocabulary, weights, k=n))
    docs = [*AWKWARD, *((10 + i, make(r.randint(0, 80))) for i in range(300)), *((1000 + i, "w3 w5 tie") for i in range(40)), (None, "w3 w5 tie"), (1003, "w3 w5 tie")]
    items = [(i, make(r.randint(1, 12))) for i in range(12)] + [(50, None), (51, "..."), (52, "tie W3"), (53, "nowhere"), (None, "w5 w7"), (52, "tie W3")]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    index = lexical.Index(documents(spark, docs))
    given = spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 5, 50, 1000):
        expected = ranks_of(docs, items, k)
        assert found_by(index, given, k) == {i: v for i, v in expected.items() if v}
    monkeypatch.setattr(lexical, "CHUNK_ITEMS", 4)
    monkeypatch.setattr(lexical, "BROADCAST", 0)
    assert found_by(index, given, 5) == {i: v for i, v in ranks_of(docs, items, 5).items() if v}


def test_lexical_bounds_hold():
    corpus, r = lexical.Corpus(1000, 50_000), np.random.default_rng(1)
    tf, lengths = r.integers(1, 500, 10_000), corpus.lengths(r.integers(1, 5000, 10_000))
    exact = corpus.impacts(tf, lengths)
    units = -(-exact // lexical.STEP)
    assert units.max() <= 255 and (units * lexical.STEP >= exact).all() and ((units - 1) * lexical.STEP + 1 <= exact).all()


def test_lexical_search_of_nothing(spark):
    docs, items = documents(spark, []), spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert lexical.ranked(lexical.Index(docs), items).count() == 0
    assert lexical.ranked(lexical.Index(documents(spark, [(1, "x y")])), items.where("false")).count() == 0
    assert lexical.ranked(lexical.Index(documents(spark, [(1, None), (2, "?")])), items).count() == 0


def test_elias_fano_lists():
    r = np.random.default_rng(2)
    for values in ([], [1], [7], [1, 2, 3], [5, 900_000], np.sort(r.choice(10**6, 5000, replace=False)) + 1, np.arange(1, 400)):
        values = np.array(values, np.int64)
        packed = infilling.EliasFano.packed(values)
        read = infilling.EliasFano(*packed)
        assert [read.select(i) for i in range(len(values))] == values.tolist()
        if len(values) > 1000:
            assert 8 * len(packed[2]) / len(values) < 3 + math.log2(values[-1] / len(values))


def cut(i, text, rate=100, suffix_first=50):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[j : j + 8], 16) for j in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < suffix_first else "psm"
    return len(lines), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("name", [infilling.text_name, lambda t: (F.length(t) % 3).cast("long")], ids=["hash", "colliding"])
@pytest.mark.parametrize("rate", [100, 60])
def test_infilling(spark, name, rate):
    """Texts whose hashes collide are told apart by their content."""
    texts = [*AWKWARD, *((100 + i, t) for i, t in enumerate(ODD)), *((200 + i, "same\ntext\nin\nmany\nrows") for i in range(50))]
    docs = documents(spark, texts).withColumnRenamed("ids", "form").withColumn("list", F.lit("kept"))
    rows = infilling.infilled(docs, rate=rate, name=name).withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
    got = collections.Counter((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows)
    assert got == collections.Counter((i, t, *cut(i, t or "", rate)) for i, t in texts)
    assert all(r["back"] == (r["text"] or "") and r["list"] == "kept" for r in rows) and {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert infilling.infilled(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    found = con.execute(queries.SQL[name])
    df = queries.QUERIES[name](spark, FOLDER).select(*[d[0] for d in found.description])
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(found.fetchall(), key=repr)
