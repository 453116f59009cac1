"""The registered queries as they are: against brute force over the smallest tables, on awkward rows and on empty tables."""

import base64
import collections
import hashlib
import struct
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from awkward_rows import AWKWARD
from tokenizers import Tokenizer

from quillspark.llm import lang_id, queries

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}


def rows_of(df, key="doc_id"):
    rows = df.collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


def test_op2_equals_the_library(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows_of(queries.op2_bpe(spark, FOLDER))
    assert got.keys() == documents.keys()
    for i, text in documents.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op3_equals_the_library(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = rows_of(queries.op3_token_files(spark, FOLDER)), 0
    for i in sorted(documents):
        ids = library.encode(documents[i], add_special_tokens=False).ids + [1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_op4_places_all_rows(spark, documents):
    rows = queries.op4_sharding(spark, FOLDER).collect()
    places, load = collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len(documents[r["doc_id"]].encode()) + 16, zlib.crc32(documents[r["doc_id"]].encode()))
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert len(rows) == len(documents) and all(sorted(p) == list(range(len(p))) for p in places.values()) and set(load) <= set(range(40))


def test_op5_folded_table_equals_the_network(spark, documents):
    """The scores of the query are those of a plain pass over each text; most held-out rows are right."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = lang_id.train(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2"))
    got = rows_of(queries.op5_lang_id(spark, FOLDER))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    for i, text in documents.items():
        buckets, shares = lang_id.counted(text)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        if not len(buckets):
            assert (got[i]["lang_pred"], got[i]["rejected"]) == ("und", True)
            continue
        z = (shares @ model.table[buckets] + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i]["lang_pred"] == model.languages[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max(), abs=1e-5)
    held = [i for i in documents if got[i]["held_out"] and truth[i] and got[i]["lang_pred"] != "und"]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.9 * len(held)


def test_op6_equals_brute_force(spark, documents):
    data = {i: t.encode() for i, t in documents.items()}
    seen = collections.Counter(d[k : k + 400] for d in data.values() for k in range(len(d) - 399))
    got, some = rows_of(queries.op6_suffix_repeats(spark, FOLDER)), 0
    for i, d in data.items():
        gone = bytearray(len(d))
        for k in range(len(d) - 399):
            if seen[d[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_kept"], r["repeats"]) == (len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest(), len(kept), any(gone)), i
        some += any(gone)
    assert some > 10


def test_op9_equals_brute_force(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in pq.read_table(f"{FOLDER}/pages.parquet").to_pylist()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = rows_of(queries.op9_warc(spark, FOLDER), "page_id")
    for i, p in pages.items():
        f = first[p]
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)


def test_op10_equals_brute_force(spark, documents):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()

    sets, parent = {i: shingles(t) for i, t in documents.items()}, {i: i for i in documents}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op10_near_duplicates(spark, FOLDER).collect()}
    assert got == {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def tables(spark, folder, docs):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    pages = spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in docs], "page_id long, url string, html string")
    pages.write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(0, "a passage of a benchmark that no text of these tables holds")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_queries_on_odd_tables(spark, tmp_path_factory, name, kind):
    """Rows with null ids, null, empty, blank and long texts, ties and repeated rows each have their result; nothing has none."""
    folder = str(tmp_path_factory.mktemp("odd"))
    tables(spark, folder, AWKWARD if kind == "awkward" else [])
    n = queries.QUERIES[name](spark, folder).count()
    if kind == "awkward" and name in ("op11_packing", "op12_lexical_search"):  # pieces of documents, documents with words of the item
        assert n >= (len(AWKWARD) + 4 if name == "op11_packing" else 1)
    else:
        assert n == (0 if kind == "empty" or name.startswith("op1_") else len(AWKWARD))


def test_pipeline_on_odd_tables(spark, tmp_path_factory):
    for docs in (AWKWARD, []):
        folder = str(tmp_path_factory.mktemp("pipeline"))
        tables(spark, folder, docs)
        rows = corpus_pipeline.run(spark, folder).collect()
        texts = [r["text"] for r in rows]
        assert len(rows) <= len(docs) and len(set(texts)) == len(texts)


def test_pipeline_keeps_one_of_each_and_removes_planted_rows(spark, tmp_path_factory):
    """Clean texts stay; copies, near copies and a text with a benchmark passage go; tokens decode to the text."""
    folder = str(tmp_path_factory.mktemp("planted"))
    r = np.random.default_rng(7)
    syllables = ["ba", "de", "ki", "lo", "mu", "na", "po", "re", "si", "tu"]
    sentence = lambda n: " ".join("".join(r.choice(syllables, 3)) for _ in range(n))
    clean = [sentence(60) for _ in range(30)]
    item = sentence(40)
    near = " ".join([*clean[0].split()[:-1], "other"])
    docs = [*enumerate(clean), (100, clean[1]), (101, near), (102, f"{sentence(20)} {item} {sentence(20)}"), (103, "12 34 !")]
    tables(spark, folder, docs)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    rows = rows_of(corpus_pipeline.run(spark, folder))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(rows) == set(range(30))
    for i, row in rows.items():
        assert row["text"] == clean[i] and row["ids"] == library.encode(clean[i], add_special_tokens=False).ids
