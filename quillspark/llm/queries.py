"""The queries of the numbered operators over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, fingerprint, infilling, lang_id, lexical, line_dedup, near_dup, packing, repeats, sharding, token_files, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, item_id, similarity and start of each benchmark item that a document has a window of."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = bpe.encode_decode(table(spark, folder, "documents").select("doc_id", "text"), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_files.write_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_files.read_tokens(manifest, with_ids=False)


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.shard(table(spark, folder, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op5_lang_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = lang_id.train(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    rows = lang_id.predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op6_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Besides the columns asked for: n_kept, the bytes that are left, and repeats, whether any went."""
    rows = repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    kept, repeats_ = (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), (F.col("n_removed") > 0).alias("repeats")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), kept, repeats_)


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Of each row; near_next is null only if no row has an id."""
    rows = fingerprint.compared(table(spark, folder, "documents").select("doc_id", "text"))
    own, edited = F.col("fingerprint"), F.col("edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.as_text(own).alias("fingerprint"),
        fingerprint.as_text(edited).alias("edited_fingerprint"),
        fingerprint.likeness(own, edited).alias("near_edited"),
        fingerprint.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed and the digest of what is left of each text."""
    rows = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, folder, "pages"))
    return warc.read_warc(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), words=2)


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    stream = packing.token_stream(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0)
    return packing.pieces(stream, 1024, with_ids=False)


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(lexical.Index(table(spark, folder, "documents")), table(spark, folder, "benchmark"), 50)


def op13_infilling(spark: SparkSession, folder: str) -> DataFrame:
    rows = infilling.infilled(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infilling.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_OPERATORS = [op1_decontaminate, op2_bpe, op3_token_files, op4_sharding, op5_lang_id, op6_suffix_repeats, op7_fingerprints, op8_line_dedup, op9_warc, op10_near_duplicates, op11_packing, op12_lexical_search, op13_infilling]
QUERIES = {f.__name__: f for f in _OPERATORS}

SQL: dict[str, str] = {
    "op12_lexical_search": r"""
        with split as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
        sizes as (select count(*) as docs, sum(len(terms))::hugeint as words from split where len(terms) > 0),
        counts as (select doc_id, term, n, count(*) as tf from (select doc_id, len(terms) as n, unnest(terms) as term from split) group by all),
        weights as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from counts, sizes group by term, docs),
        items as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
        scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + 50 * n * docs // words))))::bigint as score
            from items join weights using (term) join counts using (term), sizes group by all)
        select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
        from scores where score > 0 qualify rank <= 50""",
    "op13_infilling": r"""
        with lines as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || coalesce(doc_id::varchar, '')) as d from documents),
        drawn as (select *, len(u) as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[25:32])::bigint as h4 from lines),
        cut as (select *, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') as p,
            array_to_string(u[1 + least(h1 % (n + 1), h2 % (n + 1)):greatest(h1 % (n + 1), h2 % (n + 1))], '') as m,
            array_to_string(u[1 + greatest(h1 % (n + 1), h2 % (n + 1)):], '') as s,
            case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from drawn)
        select doc_id, n::bigint as n, form, case when form != 'plain' then length(p) end as prefix_chars, case when form != 'plain' then length(m) end as middle_chars,
            sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
            sha256(text) as restored_sha256 from cut""",
}
