"""Operator 7: document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document's terms are its words (lower case, between blanks), weighted by how often they occur. For sample k each term
draws r and c from Gamma(2, 1) and b from the unit interval, all three from its hash. With t = floor(ln w / r + b) its value is ln a = ln c - r * (t - b + 1), and the term with the least value
is the sample. Two documents have the same sample with a probability equal to their generalised Jaccard similarity, the
sum of the smaller weights over the sum of the larger. The least value is determined by the term and its t, so a hash of
it serves as the sample.

Defined results: a null text is the empty text; texts without words share a fingerprint of their own; equal texts have
equal fingerprints; texts may be of any length; repeated rows each get a row; rows that share an id are told apart by
their texts; an empty table gives an empty table; columns besides id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.cluster import staged
from quillspark.llm.order import next_keys

#: Samples of a fingerprint, and samples that one row of the aggregate draws.
SAMPLES, RUN = 64, 8


def terms_of(text: Column) -> Column:
    """The words of a text, in lower case, each as often as it occurs; empty strings stand between adjacent blanks."""
    text = F.lower(text)
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.split(text, " ")


def drawn(term: Column, run: Column, k: int) -> tuple[Column, Column, Column]:
    """r, ln c and b of a term (its 64-bit hash) in sample k of a run of samples: five uniform numbers from two hashes."""
    one, two = F.xxhash64(term, run, F.lit(2 * k)), F.xxhash64(term, run, F.lit(2 * k + 1))
    uniform = lambda h, at, bits: (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) * 2.0**-bits
    return -F.log(uniform(one, 43, 21) * uniform(one, 22, 21)), F.log(-F.log(uniform(two, 32, 32) * uniform(two, 0, 32))), uniform(one, 0, 22)


def least_values(weights: DataFrame, keys: list[str], weight_columns: list[str], samples: int) -> DataFrame:
    """``weights`` has keys, term (hash) and weights (0: absent). Gives, for each key and weight column, an array<int> of samples.

    All documents of a partition are summed up together; no list of terms is ever built. Samples are drawn in runs of
    RUN, a row each, which keeps the generated code of the aggregate small enough for the JVM to compile.
    """
    far = -1e30  # a logarithm so small that the term's value is never the least
    logs = {c: F.when(F.col(c) > 0, F.log(F.col(c).cast("double"))).otherwise(F.lit(far)) for c in weight_columns}
    rows = weights.select(*keys, "term", *(v.alias(f"log_{c}") for c, v in logs.items()), F.explode(F.sequence(F.lit(0), F.lit(-(-samples // RUN) - 1))).alias("run"))
    found = []
    for k in range(RUN):
        r, c, b = drawn(F.col("term"), F.col("run"), k)
        for w in weight_columns:
            t = F.floor(F.col(f"log_{w}") / r + b)
            found.append(F.min(c - r * (t - b + 1)).alias(f"{w}_{k}"))
    # samples of a document without terms are all of the size that absent terms have
    sample = lambda w, k: F.when(F.col(f"{w}_{k}") < 1e15, F.xxhash64(f"{w}_{k}").bitwiseAND(F.lit(0x7FFFFFFF))).otherwise(F.lit(-1)).cast("int")
    rows = rows.groupBy(*keys, "run").agg(*found)
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("run", *(F.array(*(sample(w, k) for k in range(RUN))).alias(w) for w in weight_columns)))).alias("runs"))
    return rows.select(*keys, *(F.slice(F.flatten(F.col(f"runs.{w}")), 1, samples).alias(w) for w in weight_columns))


def term_weights(segments: DataFrame, keys: list[str], text_columns: list[str]) -> DataFrame:
    """``segments`` has keys and ``segments``, an array of struct<body string, which int>: pieces of text that end at blanks,
    bit i of ``which`` saying if text i has the piece. Gives keys, term (hash) and for each text the weight of the term."""
    rows = segments.select(*keys, F.explode("segments").alias("x"))
    rows = rows.select(*keys, F.col("x.which").alias("which"), F.explode(terms_of(F.col("x.body"))).alias("word"))
    counts = ((F.col("word") != "").cast("int") * F.shiftright("which", i).bitwiseAND(F.lit(1)) for i in range(len(text_columns)))
    rows = rows.select(*keys, F.xxhash64("word").alias("term"), *(n.alias(c) for n, c in zip(counts, text_columns)))
    return rows.groupBy(*keys, "term").agg(*(F.sum(c).alias(c) for c in text_columns))


def segment(body: Column, which: int) -> Column:
    return F.struct(body.alias("body"), F.lit(which).alias("which"))


def fingerprints(df: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys (which must tell rows apart) and ``fingerprint``, an array<int>. If ``df`` is partitioned by its first key, no
    row is shuffled."""
    rows = df.select(*keys, F.array(segment(F.coalesce(text, F.lit("")), 1)).alias("segments"))
    return least_values(term_weights(rows, keys, ["fingerprint"]), keys, ["fingerprint"], samples)


def fingerprint_pairs(df: DataFrame, keys: list[str], text: str, edited: str, same: Column, samples: int = SAMPLES) -> DataFrame:
    """keys, ``fingerprint`` and ``edited_fingerprint``, where both texts begin with the same ``same`` characters: what comes
    before the last blank of those is split and counted once."""
    tail = F.length(F.substring_index(F.left(F.col(text), same), " ", -1))
    rows = df.withColumn("at", (same - tail).cast("int"))
    rest = lambda c: F.substring(F.col(c), F.col("at") + 1, F.length(c))
    parts = F.array(segment(F.left(F.col(text), F.col("at")), 3), segment(rest(text), 1), segment(rest(edited), 2))
    names = ["fingerprint", "edited_fingerprint"]
    return least_values(term_weights(rows.select(*keys, parts.alias("segments")), keys, names), keys, names, samples)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples, an estimate of generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def as_text(fingerprint: Column) -> Column:
    """A fingerprint as text: eight hex digits a sample."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def with_edited(docs: DataFrame) -> DataFrame:
    """k (a hash of the id, or of the text if the id is null), doc_id, text, text_hash, n_chars, edited, next_id, place (among
    the texts of k in string order, from 1) and fresh (no equal row comes before); rows stay partitioned by k.

    The edited text has its last quarter (in code points, rounded down) replaced by the first as many of the next document,
    or all of it. Only those beginnings are shuffled a second time; the texts' own shuffle serves both. Of documents that share
    the next id, the first text in string order is taken; rows with a null id are followed by the document with the smallest id.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    rows = body.select(own.alias("k"), "doc_id", "text").repartition(parts, "k").withColumn("text_hash", F.xxhash64("text"))
    order = W.partitionBy("k").orderBy("text")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("fresh", ~F.lag("text_hash").over(order).eqNullSafe(F.col("text_hash")))
    follows = next_keys(docs, "doc_id").select(F.xxhash64("k").alias("k"), F.col("k").alias("doc_id"), F.col("next").alias("next_id"))
    lengths = docs.where("doc_id is not null").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"))
    wanted = lengths.join(follows, "doc_id").select(F.xxhash64("next_id").alias("k"), F.col("k").alias("for_k"), "next_id", F.floor(F.col("n") / 4).cast("int").alias("need"))
    # both uses of each shuffle take the same columns and no filter that Spark could move below it: else it would be made twice
    pieces = rows.where("place = 1").join(wanted, "k").select(F.col("for_k").alias("k"), "next_id", F.expr("case when doc_id = next_id then left(text, need) end").alias("piece"))
    # what follows a null id: one row, of no more characters than a null id's text needs
    need = body.where("doc_id is null").agg(F.floor(F.max(F.length("text")) / 4).cast("int").alias("need"))
    least = docs.agg(F.min("doc_id").alias("least"))
    head = body.join(F.broadcast(least), F.col("doc_id") == F.col("least")).agg(F.min("text").alias("text"))
    first = least.crossJoin(F.broadcast(need)).crossJoin(F.broadcast(head)).select("least", F.expr("left(text, need)").alias("head"))
    out = rows.withColumn("n_chars", F.length("text").cast("long")).join(pieces, "k", "left").crossJoin(F.broadcast(first))
    # an id's hash is never looked up for the hash of a null id's text
    null = F.col("doc_id").isNull()
    out = out.withColumn("next_id", F.when(null, F.col("least")).otherwise(F.col("next_id"))).withColumn("piece", F.when(null, F.col("head")).otherwise(F.col("piece")))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.expr("case when next_id is null then '' else left(coalesce(piece, ''), cast(floor(n_chars / 4) as int)) end"))
    return out.select("k", "doc_id", "text", "text_hash", "n_chars", F.when(quarter > 0, edited).otherwise(F.col("text")).alias("edited"), "next_id", "place", "fresh")


def compared(docs: DataFrame) -> DataFrame:
    """For each row doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint and next_fingerprint (array<int>).

    Rows are known by k and the hash of their text; repeated rows are weighed once. What is wanted of the texts besides their
    samples is taken in the same job, so the texts move once; only hashes, numbers and samples are joined.
    """
    rows, keys = with_edited(docs), ["k", "text_hash"]
    same = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    marks = rows.select(*keys, "doc_id", "n_chars", "next_id", "place", F.sha2("edited", 256).alias("edited_sha256"))
    samples = fingerprint_pairs(rows.where("fresh"), keys, "text", "edited", same)
    both = staged(marks.unionByName(samples, allowMissingColumns=True), "fingerprints")
    rows = both.where("edited_sha256 is not null").select(*marks.columns).join(both.where("fingerprint is not null").select(*samples.columns), keys)
    first = rows.where("place = 1").select(F.col("k").alias("next_k"), F.col("fingerprint").alias("next_fingerprint"))
    rows = rows.join(first, F.when(F.col("next_id").isNotNull(), F.xxhash64("next_id")) == F.col("next_k"), "left")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")
