"""Each operator against a brute-force version, on random small texts and on awkward rows."""

import base64
import collections
import hashlib
import random
import struct
import zlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, components, decontaminate, fingerprint, lang_id, line_dedup, near_dup, queries, repeats, sharding, token_files, warc
from quillspark.llm.cluster import filesystem

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts(seed, n, words=60, lines=4):
    """Random texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    make = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    shared, out = [make(30) for _ in range(3)], []
    for _ in range(n):
        kind = r.random()
        if out and kind < 0.15:
            out.append(r.choice(out))
        elif out and kind < 0.45:
            w = r.choice(out).split(" ")
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
        else:
            out.append("\n".join([make(r.randint(1, words)) for _ in range(r.randint(1, lines))] + ([r.choice(shared)] if kind > 0.8 else [])))
    return out


def frame(spark, found):
    return spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(4)


def test_bpe_equals_library(spark, awkward, empty):
    extra = ["a<|endoftext|>b", "aaaaaaa", "hahahaha  x\r\n y", "it's we'll '"] + texts(1, 30)
    library = Tokenizer.from_file(BYTE)
    rows = bpe.decode(bpe.encode(awkward.select("doc_id", "text", "h").unionByName(frame(spark, extra).withColumn("h", F.lit("x"))), BYTE), BYTE)
    found = rows.collect()
    assert len(found) == len(extra) + awkward.count() and rows.columns == ["doc_id", "text", "h", "ids", "decoded"]
    for r in found:
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["decoded"] == (r["text"] or "")
    assert bpe.encode(empty, BYTE).count() == 0


def test_token_files_round_trip(spark, awkward, empty):
    library = Tokenizer.from_file(WORD)
    docs = frame(spark, texts(2, 40) + ["Ünïcode   MIXED’s　case", "don't<|endoftext|>stop", "a'. 'S: say,\". x?!y ...", "İ. ΑΣ, É. ß? 3.14,"])
    manifest = token_files.write_tokens(docs, WORD, end=1, files=3)
    start = 0
    rows = {r["doc_id"]: r for r in token_files.read_tokens(manifest).collect()}
    for r in sorted(docs.collect()):
        ids = library.encode(r["text"], add_special_tokens=False).ids + [1]
        got = rows[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids"]) == (start, len(ids), ids)
        assert got["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    fs, name = filesystem(manifest.first()["path"])
    with fs.open_input_file(name) as f:
        reader = token_files.FrameReader(f)
        each = list(reader.documents())
        assert [reader.document(k) for k in range(len(each))] == [d for _, d in each]
    with fs.open_input_file(name) as f:
        data = bytearray(f.read())
    data[20] ^= 1
    import io

    with pytest.raises(Exception):
        list(token_files.FrameReader(io.BytesIO(bytes(data))).documents())
    assert token_files.read_tokens(token_files.write_tokens(awkward, WORD, end=1)).count() == awkward.count()
    assert token_files.read_tokens(token_files.write_tokens(empty, WORD, end=1)).count() == 0


def test_sharding(spark, awkward, empty):
    docs = frame(spark, texts(3, 500))
    rows = sharding.shard(docs, 7).collect()
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(rows) == 500 and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(load.values()) - min(load.values()) < 1.05 * max(r["size"] for r in rows)
    assert sharding.shard(awkward, 3).count() == awkward.count()
    assert sharding.shard(empty, 3).count() == 0


def test_rebalancing_moves_little():
    sizes = [(s, 100 + s % 7, 1) for s in range(1000)]
    old = sharding.new_map(sizes, 10)
    new = sharding.rebalanced(old, sizes, 11)
    moved = [s for s in old if old[s] != new[s]]
    assert all(new[s] == 10 for s in moved) and 70 < len(moved) < 105
    assert sharding.rebalanced(old, sizes, 10) == old


def test_language(spark, awkward, empty):
    r = random.Random(4)
    words = {"aa": "the and of house tree with".split(), "bb": "der und ein haus baum mit".split(), "cc": "le et un maison arbre avec".split()}
    rows = [(i, " ".join(r.choice(words[k]) + r.choice(["", "s", "en"]) for _ in range(20)), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(docs.where("doc_id % 4 != 0"), per_language=40)
    found = lang_id.predict(docs, model).where("doc_id % 4 = 0").collect()
    assert sum(x["lang_pred"] == x["lang"] for x in found) >= 0.95 * len(found)
    assert all(0 <= x["score"] <= 1 for x in found)
    odd = lang_id.predict(awkward, model)
    assert odd.count() == awkward.count()
    assert {x["lang_pred"] for x in odd.where("doc_id in (3, 4, 5)").collect()} == {"und"}
    assert lang_id.predict(empty, lang_id.train(empty)).count() == 0


def test_repeats(spark, awkward, empty):
    length, r = 40, random.Random(6)
    found = texts(5, 60, words=12) + ["x" * 200, "ab" * 70, "é" * 45]
    found += [found[0] + "Q" + found[1], found[2][10:] + found[3][:60]]
    docs = frame(spark, found)
    data = [t.encode() for t in found]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    rows = {x["doc_id"]: x for x in repeats.remove_repeats(docs, length).collect()}
    for k, d in enumerate(data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        got = rows[k]
        assert (got["n_removed"], got["n_spans"], bytes(got["kept"])) == (sum(gone), runs, bytes(b for b, g in zip(d, gone) if not g)), k
    odd = {(x["doc_id"], x["n_bytes"]): x["n_removed"] for x in repeats.remove_repeats(awkward, 40).collect()}
    assert odd[1, 63] == odd[2, 63] == 63 and odd[9, 25000] == 25000 and odd[3, 0] == 0
    assert repeats.remove_repeats(empty).count() == 0


def weights(text):
    return collections.Counter(w for w in (text or "").lower().split())


def test_fingerprints(spark, awkward, empty):
    found = texts(7, 80)
    rows = fingerprint.with_edited(frame(spark, found)).collect()
    for r in rows:
        t, q = r["text"], len(r["text"]) // 4
        assert r["edited"] == t[: len(t) - q] + found[(r["doc_id"] + 1) % len(found)][:q] and r["n_chars"] == len(t)
    edited = fingerprint.with_edited(frame(spark, found))
    same = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    pairs = fingerprint.fingerprint_pairs(edited, ["doc_id"], "text", "edited", same, 64).join(edited, "doc_id").withColumn("like", fingerprint.likeness(F.col("fingerprint"), F.col("edited_fingerprint"))).collect()
    errors = []
    for r in pairs:
        a, b = weights(r["text"]), weights(r["edited"])
        errors.append(r["like"] - sum((a & b).values()) / sum((a | b).values()))
    assert len(pairs) == 80 and abs(sum(errors) / 80) < 0.03 and max(map(abs, errors)) < 0.35
    alone = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(frame(spark, found), ["doc_id"], samples=64).collect()}
    assert all(alone[r["doc_id"]] == r["fingerprint"] for r in pairs)
    odd = fingerprint.fingerprints(awkward.withColumn("k", F.xxhash64("doc_id", "text")), ["doc_id", "k"]).collect()
    assert len({tuple(r["fingerprint"]) for r in odd if r["doc_id"] in (3, 4, 5)}) == 1
    assert fingerprint.with_edited(awkward).count() == awkward.count() and fingerprint.with_edited(empty).count() == 0


def test_line_dedup(spark, awkward, empty):
    r = random.Random(8)
    pool = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(r.randint(1, 9))) for _ in range(120)]
    found = ["\n".join(r.choice(pool + ["", "  "]) for _ in range(r.randint(1, 8))) for _ in range(80)]

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    order = [(i, k, line.split()) for i, t in enumerate(found) for k, line in enumerate(t.split("\n")) if line.split()]
    gone = {(i, k) for j, (i, k, w) in enumerate(order) if any(near(w, v) for _, _, v in order[:j])}
    rows = {x["doc_id"]: x for x in line_dedup.dedup_lines(frame(spark, found)).collect()}
    for i, t in enumerate(found):
        assert rows[i]["text"] == "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        assert rows[i]["n_removed"] == sum((i, k) in gone for k in range(99))
    odd = line_dedup.dedup_lines(awkward)
    got = {x["doc_id"]: x for x in odd.collect()}
    assert odd.columns == [*awkward.columns, "n_lines", "n_removed"] and odd.count() == awkward.count()
    assert got[3]["text"] is None and got[2]["text"] == "" and got[5]["text"] == " \n\t \n"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_warc(spark, empty):
    r = random.Random(9)
    pages = [(i, f"http://h/{i}", r.choice(["<p>same</p>", "", None, f"<i>é{i}</i>" * r.randint(1, 50)])) for i in range(60)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(5)
    manifests = [warc.write_warc(rows.repartition(n), shard_bytes=4000, roll_bytes=600) for n in (2, 5)]
    first = {}
    for i, _, html in pages:
        first.setdefault(html or "", i)
    got = {x["page_id"]: x for x in warc.read_warc(manifests[0]).collect()}
    for i, url, html in pages:
        p, x = (html or "").encode(), got[i]
        assert (x["url"], x["payload_bytes"], x["payload_digest"]) == (url, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        f = first[html or ""]
        assert (x["record_type"], x["refers_to"]) == (("response", None) if f == i else ("revisit", f))
    def files(m):
        out = {}
        for x in m.collect():
            fs, name = filesystem(x["path"])
            with fs.open_input_file(name) as f:
                out[name.rpartition("/")[2]] = f.read()
        return out
    assert files(manifests[0]) == files(manifests[1]) and len(files(manifests[0])) > 5
    large = warc.read_warc(warc.write_warc(rows, least_bytes=1)).where("payload_bytes = 0").collect()
    assert {x["record_type"] for x in large} == {"response"}
    assert warc.read_warc(warc.write_warc(rows.where("false"))).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (200, 100)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0} and found[200] == found[101] == 100 and 5 in found


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, awkward, empty, words):
    found = texts(10 + words, 120)

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [shingles(t) for t in found]
    parent = list(range(len(found)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = near_dup.near_duplicates(frame(spark, found), words=words).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {(i, len(sets[i]), root(i), root(i) == i) for i in range(len(found))}
    if words == 5:
        odd = {r["doc_id"]: r for r in near_dup.near_duplicates(awkward).collect()}
        assert odd[2]["component_id"] == 1 and odd[4]["component_id"] == 4 and odd[4]["n_shingles"] == 0
        assert near_dup.near_duplicates(empty).count() == 0


def one_region(spark, found):
    """docs and sets, for linked_components() on single words, of (text, component) rows that share the first five values of one tree
    and nothing else. The doc_id of a row is its place."""
    docs = frame(spark, [t for t, _ in found])
    r, rows = random.Random(3), []
    for i, (t, component) in enumerate(found):
        s = near_dup.shingle_set(t, 1, near_dup.WordHashes())
        sig = struct.pack(">5H", *range(5)) + r.randbytes(2 * (near_dup.TREES * near_dup.DEPTH - 5))
        rows.append((near_dup.xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), i, bytearray(sig), len(s), component))
    sets = spark.createDataFrame(rows, "node long, doc_id long, sig binary, n_shingles long, component long")
    return docs, sets.join(docs.select("doc_id", F.xxhash64("text").alias("text_hash")), "doc_id"), [x[0] for x in rows]


def word_set(*spans):
    return " ".join(f"w{i}" for a, b in spans for i in range(a, b))


def test_large_regions_keep_their_depth(spark):
    found = [(word_set((0, 50)), 1), (word_set((0, 49), (50, 51)), 0)] + [(f"x{i} y{i}", 0) for i in range(8300)]
    docs, sets, nodes = one_region(spark, found)
    got = [(r["a"], r["b"]) for r in near_dup.linked_components(docs, sets, 1, 5, 80, 100).collect()]
    assert got == [tuple(sorted(nodes[:2]))]


def test_no_task_holds_a_large_region(spark, monkeypatch):
    """A region of 600 sets in one component, 40 in others, each similar to one of the 600, and a pair outside: cut into cells
    of both kinds, all links are found."""
    monkeypatch.setattr(near_dup, "CELL", 10_000)
    text = lambda i, j: word_set((100 * i, 100 * i + 20)) + f" w{100 * i + j}"
    found = [(text(i, 30), 0) for i in range(600)] + [(text(i, 40), i + 1) for i in range(40)] + [(text(1000, 30), 1000), (text(1000, 40), 1001)]
    docs, sets, nodes = one_region(spark, found)
    region = sets.select(F.lit(1).cast("long").alias("region"), "node")
    cells = near_dup.dealt(region, sets).groupBy("cell").count().collect()
    assert len(cells) > 20 and max(r["count"] for r in cells) < 200
    got = {(r["a"], r["b"]) for r in near_dup.linked_components(docs, sets, 1, 5, 80, 100).collect()}
    assert got == {tuple(sorted((nodes[i], nodes[600 + i]))) for i in range(40)} | {tuple(sorted(nodes[640:]))}


def test_pairs_just_under_the_threshold_hide_no_links(spark):
    """In components 0 and 1, the first sets are at 399 / 499, the second at 410 / 500; the first are looked at first."""
    for k in range(0, 10**6, 10**4):
        under = [(word_set((k, k + 449)), 0), (word_set((k, k + 399), (k + 450, k + 500)), 1)]
        over = [(word_set((k + 1000, k + 1450)), 0), (word_set((k + 1000, k + 1410), (k + 1450, k + 1500)), 1)]
        docs, sets, nodes = one_region(spark, under + over)
        if nodes[1] < nodes[3]:
            break
    got = [(r["a"], r["b"]) for r in near_dup.linked_components(docs, sets, 1, 5, 80, 100).collect()]
    assert got == [tuple(sorted(nodes[2:]))]


def test_decontamination(spark, awkward, empty):
    r = random.Random(13)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 40))) for _ in range(12)]
    found = []
    for k in range(60):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 80))]
        if k % 2:
            passage = r.choice(items).split()
            for _ in range(r.randint(0, 2)):
                passage[r.choice([0, -1])] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = passage
        found.append("  ".join(w).upper() if k % 3 else "\n".join(w))

    def terms(t):
        w = t.lower().split()
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    expected = {}
    for i, t in enumerate(found):
        for k, item in enumerate(items):
            want, have = terms(item), terms(t)
            n = len(want)
            best = 0
            for p in range(len(have)):
                a, b = collections.Counter(have[p : p + n]), collections.Counter(want)
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= 0.8:
                expected[i, k] = best
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, " ")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.contaminated(frame(spark, found), bench).collect()}
    assert got == pytest.approx(expected) and len(got) > 15
    assert decontaminate.decontaminated(frame(spark, found), bench).count() == 60 - len({i for i, _ in expected})
    assert decontaminate.contaminated(awkward, bench).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.decontaminated(awkward, bench).count() == awkward.count()


def test_decontamination_of_shared_ids(spark):
    """Texts that share an id, or have none, are looked at one by one: clean ones don't hide a passage."""
    item = " ".join(f"i{k}" for k in range(30))
    near = " ".join([*(f"i{k}" for k in range(29)), "changed"])
    clean = [" ".join(f"z{n}x{k}" for k in range(40)) for n in range(20)]
    docs = spark.createDataFrame([(i, t) for i in (None, 1) for t in [near, *clean]] + [(2, near), (2, near)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["start"]) for r in got) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert [r["similarity"] for r in got] == pytest.approx([25 / 27] * 3)


@pytest.mark.parametrize("i", [7, None])
def test_lines_of_shared_ids(spark, i):
    """Many texts of one id, or of none, lose the lines that they would lose with ids in the order of their hashes."""
    r = random.Random(21)
    pool = [[r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(5, 9))] for _ in range(60)]
    found = {"\n".join(" ".join(w if r.random() > 0.1 else "other" for w in r.choice(pool)) for _ in range(5)) for _ in range(150)}
    docs = spark.createDataFrame([(i, t, "x") for t in [*found, *list(found)[:20]]], "doc_id long, text string, kept string").repartition(4)
    order = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    own = spark.createDataFrame([(h, t) for t, h in order.items()], "doc_id long, text string")
    expected = {order[t]: r["text"] for t, r in ((t, r) for r in line_dedup.dedup_lines(own).withColumn("h", F.col("doc_id")).collect() for t in order if order[t] == r["h"])}
    lost = line_dedup.dedup_lines(docs.withColumn("n_lines", F.xxhash64("text")).withColumnRenamed("kept", "t").withColumn("before", F.col("text"))).collect()
    assert len(lost) == len(found) + 20 and all(r["text"] == expected[order[r["before"]]] for r in lost)
    assert sum(r["n_removed"] for r in lost) > 100


def test_pipeline_stages_keep_rows_of_shared_ids(spark, tmp_path):
    """Documents that share an id, or have none, go only if their own text is a duplicate or contaminated."""
    item = " ".join(f"i{k}" for k in range(30))
    one, two, three, four = (" ".join(f"{x}{k}" for k in range(20)) for x in "abcd")
    found = [(None, one), (None, two), (None, two), (None, item), (3, three), (3, four), (3, item + " end"), (4, three), (5, one + " more"), (6, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in found], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = lambda df: sorted(((r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert rows(left) == sorted([(0, two), (3, three), (3, four), (3, item + " end"), (5, one + " more"), (6, ""), (0, "")])
    clean = [(i or 0, t or "") for i, t in found if item not in (t or "")]
    assert rows(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == sorted(clean)


def test_fingerprint_query_on_null_ids_and_repeated_rows(spark, tmp_path):
    """Each row has a result, equal texts have equal fingerprints, and null ids are followed by the smallest id."""
    one, two, three = (" ".join(f"{x}{k % 7}" for k in range(n)) for x, n in (("a", 40), ("b", 30), ("c", 50)))
    found = [(1, one), (2, two), (2, two), (3, two), (None, two), (None, two), (None, three), (2, three)]
    spark.createDataFrame(found, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_fingerprints(spark, str(tmp_path)).collect()
    edited = lambda t, follows: hashlib.sha256((t[: len(t) - len(t) // 4] + follows[: len(t) // 4]).encode()).hexdigest()
    follows = {1: two, 2: two, 3: one, None: one}
    assert sorted((r["doc_id"] or 0, r["edited_sha256"]) for r in rows) == sorted((i or 0, edited(t, follows[i])) for i, t in found)
    by_size = {len(t): {r["fingerprint"] for r in rows if r["n_chars"] == len(t)} for _, t in found}
    assert all(len(x) == 1 for x in by_size.values()) and len(set.union(*by_size.values())) == 3
    assert all(r["near_next"] is not None for r in rows) and {r["near_edited"] for r in rows if r["doc_id"] == 3} <= {r["near_edited"] for r in rows if r["doc_id"] is None}


def test_stages_take_columns_of_any_name(spark, tmp_path):
    """Each stage of the pipeline passes columns whose names steps use, and a map."""
    clash = ["h", "i", "o", "t", "node", "kept", "kept_id", "lines", "line", "row", "found", "component", "key", "doc", "own", "similarity"]
    r = random.Random(4)
    text = lambda: " ".join(r.choice(["the", "of", "and", "for", "words", "text"]) + r.choice("abcdefghij") for _ in range(40))
    rows = [(k, text(), ["en", "de"][k % 2], "s", 9, {"a": k}, *clash) for k in range(6)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, n_chars long, more map<string, int>, " + ", ".join(f"{c} string" for c in clash))
    spark.createDataFrame([(0, text())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, str(tmp_path))
        if name == "tokens":
            assert "ids" in out.columns
        else:
            assert out.columns == docs.columns
        assert out.count() == (6 if name == "near_duplicates" else 7), name


def test_sharding_spreads_texts_of_one_id(spark):
    docs = spark.createDataFrame([(5, f"text {k} " * 5) for k in range(4000)], "doc_id long, text string")
    loads = collections.Counter()
    for r in sharding.shard(docs, 8).collect():
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.02 * min(loads.values())
