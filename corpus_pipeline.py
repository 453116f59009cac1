"""The corpus pipeline over ``documents``: five stages, each working on all that the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last returns doc_id, lang,
source, n_chars, ids and the text decoded from them. Nothing of this is SQL: the stages are tested against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, lang_id, line_dedup, near_dup
from quillspark.llm.cluster import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go; the model learns from the labelled documents of the input."""
    names = docs.columns
    return lang_id.predict(docs, lang_id.train(docs)).where("not rejected").select(*names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line nearly equals go, and documents of which no word is left; n_chars follows the text."""
    names = docs.columns
    left = line_dedup.dedup_lines(docs).where("n_lines > n_removed")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id. Rows are known by id and text, so
    documents that share an id, or have none, go only for their own texts."""
    return near_dup.without_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_decode(docs, path, decoded="text")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can't express trained models, LSH forests or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = staged(docs, name) if i < len(STAGES) - 1 else docs
    return docs
