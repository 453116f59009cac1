"""Operator 1: benchmark decontamination, in DataFrame functions only.

Documents and benchmark items are sequences of words (lower case, between blanks); their terms are runs of ``words`` words,
a whole sequence being the only one if it is shorter. Windows have the size of an item and are cut at the end of the
document. For each window that can reach the threshold a 64-bit SimHash is made, weighted by how often terms occur in it.
Multi-index Hamming blocks find all items of that size within the radius: two fingerprints at most ``radius`` bits apart
agree on one of radius + 1 blocks at least. The candidates are verified by exact weighted similarity, the sum of the smaller
counts over the sum of the larger.

Which windows can reach the threshold s: one of w terms and an item of n terms share at least s * (n + w) / (1 + s), so
the terms of documents are first joined with those of the benchmark, and windows with fewer common places are left out.
Moving a window on to its first common term never makes it less similar, so windows start at common terms only.

Defined results: null and empty texts, and items without words, are in no result; items that share an id are compared one by
one, and the most similar counts; texts may be of any length, a document shorter than an item being a cut window; repeated
rows give one result; texts that share an id, or have a null id, are looked at one by one and have a result each; an empty
table gives an empty table; only ids and texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.cluster import discard, staged

WORDS, SIMILAR, RADIUS = 5, 0.8, 20
#: Rows up to which benchmark tables (24 bytes a row) and lists of windows are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its ``rows`` rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def word_hashes(text: Column) -> Column:
    body = F.lower(F.coalesce(text, F.lit("")))
    for blank in "\t\n\x0b\x0c\r":
        body = F.replace(body, F.lit(blank), F.lit(" "))
    return F.transform(F.array_remove(F.split(body, " "), ""), lambda w: F.xxhash64(w))


def with_terms(df: DataFrame, keys: list[str], text: str, words: int) -> DataFrame:
    """keys and the array ``terms`` of each row; a text without words has one term, the hash of nothing.

    The array of word hashes is a column of its own. No filter may be derived from ``terms`` below it: Catalyst would put
    the hashing of the whole text into the lambda, once a word. Outer generators derive none.
    """
    h = F.col("h")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))
    return df.select(*keys, word_hashes(F.col(text)).alias("h")).select(*keys, runs.alias("terms"))


def simhash(rows: DataFrame, keys: list[str], terms: str, name: str) -> DataFrame:
    """keys and the 64-bit SimHash ``name`` of the array ``terms``. Two bits are counted in each sum, 32 places apart."""
    each = rows.select(*keys, F.explode(terms).alias("x"))
    twice = F.lit(0x0000000100000001)
    sums = each.groupBy(*keys).agg(F.count("*").alias("n_terms"), *(F.sum(F.shiftrightunsigned("x", b).bitwiseAND(twice)).alias(f"ones_{b}") for b in range(32)))
    out = F.lit(0).cast("long")
    for b in range(32):
        low, high = F.col(f"ones_{b}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"ones_{b}", 32)
        for count, place in ((low, b), (high, b + 32)):
            out = out.bitwiseOR(F.shiftleft((2 * count > F.col("n_terms")).cast("long"), place))
    return sums.select(*keys, out.alias(name))


def blocks(fingerprint: Column, radius: int) -> Column:
    """The number and value of each of radius + 1 blocks of the fingerprint, as one long."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(*(F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) + F.lit(i << 32) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))))


def numbered(found: Column) -> Column:
    """Terms told apart by occurrence, so that counts of sets are counts of multisets."""
    return F.transform(F.array_sort(found), lambda x, i: F.xxhash64(x, i - F.array_position(F.array_sort(found), x)))


def contaminated_texts(docs: DataFrame, items: DataFrame, words: int = WORDS, similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, item_id, similarity (of the most similar window) and start (its first word, from 0; the earliest of
    equals) of each text: the id and the hash are its key in all steps, so texts that share an id, or have none, aren't mixed."""
    bench = staged(with_terms(items.where(F.size(word_hashes(F.col("text"))) > 0).dropDuplicates(["item_id", "text"]), ["item_id"], "text", words).withColumn("n", F.size("terms")).withColumn("item", F.xxhash64("item_id", "terms")), "items")
    places = bench.select("item", "n", F.explode("terms").alias("term")).distinct()
    n_items, n_places = bench.count(), places.count()
    texts = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("own"), "text")
    same_text = F.col("doc").eqNullSafe(F.col("d")) & (F.col("own") == F.col("o"))

    # 1. where documents have terms of items
    rows = with_terms(texts, ["doc", "own"], "text", words).select("doc", "own", F.size("terms").alias("size"), F.posexplode_outer("terms").alias("pos", "term"))
    hits = staged(rows.join(bounded(places, n_places), "term").select("doc", "own", "size", "item", "n", "pos").distinct(), "hits")

    # 2. windows with enough of them: the last of so many places, counted from the first, lies in the window too
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("doc", "own", "size", "item").orderBy("pos")))
    cut = F.least("n", F.col("size") - F.col("pos"))
    need = F.ceil((F.col("n") + cut) * (similar / (1 + similar)) - 1e-9).cast("int")
    last = ranked.select(F.col("doc").alias("d"), F.col("own").alias("o"), F.col("size").alias("s"), F.col("item").alias("i"), F.col("rank").alias("r"), F.col("pos").alias("last"))
    same = same_text & (F.col("size") == F.col("s")) & (F.col("item") == F.col("i")) & (F.col("rank") + need - 1 == F.col("r"))
    windows = ranked.join(last, same).where(F.col("last") < F.col("pos") + F.col("n")).select("doc", "own", "n", F.col("pos").alias("start")).distinct()
    windows = staged(windows, "windows")
    n_windows = windows.count()

    # 3. their fingerprints
    holders = windows.select(F.col("doc").alias("d"), F.col("own").alias("o")).distinct()
    held = texts.join(bounded(holders, n_windows), same_text, "left_semi")
    listed = windows.groupBy(F.col("doc").alias("d"), F.col("own").alias("o")).agg(F.collect_list(F.struct("n", "start")).alias("windows"))
    found = with_terms(held, ["doc", "own"], "text", words).join(bounded(listed, n_windows), same_text).select("doc", "own", "terms", F.explode("windows").alias("w"))
    found = found.where(F.col("w.start") < F.size("terms")).select("doc", "own", "w.n", "w.start", F.slice("terms", F.col("w.start") + 1, F.col("w.n")).alias("found"))
    found = staged(found, "found")
    prints = staged(simhash(found, ["doc", "own", "n", "start"], "found", "print"), "prints")

    # 4. items within the radius
    item_prints = bench.select("item", "n").join(simhash(bench, ["item"], "terms", "item_print"), "item").withColumn("block", F.explode(blocks(F.col("item_print"), radius)))
    near = prints.withColumn("block", F.explode(blocks(F.col("print"), radius))).join(bounded(item_prints, n_items * (radius + 1)), ["n", "block"])
    near = near.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius).select("doc", "own", "n", "start", "item").distinct()

    # 5. exact weighted similarity
    near = near.select(F.col("doc").alias("d"), F.col("own").alias("o"), F.col("n").alias("m"), F.col("start").alias("s"), "item")
    both = found.join(near, same_text & (F.col("n") == F.col("m")) & (F.col("start") == F.col("s"))).select("doc", "own", "start", "item", "found")
    both = both.join(bounded(bench.select("item", "item_id", F.col("terms").alias("wanted")), n_items), "item")
    both = both.withColumn("shared", F.size(F.array_intersect(numbered(F.col("found")), numbered(F.col("wanted")))))
    both = both.select("doc", "own", "item_id", "start", (F.col("shared") / (F.size("found") + F.size("wanted") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= similar)
    best = both.groupBy("doc", "own", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    out = staged(best.select(F.col("doc").alias("doc_id"), F.col("own").alias("text_hash"), "item_id", "best.similarity", (-F.col("best.back")).alias("start")), "contaminated")
    discard(bench, hits, windows, found, prints)
    return out


def contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, similarity and start of ``contaminated_texts``."""
    return contaminated_texts(docs, items, **how).drop("text_hash")


def decontaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows whose own text has a window similar to an item."""
    bad = contaminated_texts(docs, items, **how).select(F.col("doc_id").alias("bad"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("bad")) & (F.xxhash64(docs["text"]) == F.col("bad_hash")), "left_anti")
