"""Operator 9: a deterministic sharded WARC writer, and its reader.

Pages are range-sorted by id, those of one id or of none by a hash of their html. Shards begin at keys drawn by their hashes,
so they depend on the pages alone and the same pages give the same files, whatever the cluster looks like. Within a shard
files roll when their compressed size passes a limit. Headers, record ids and digests are made anew. Each file is written
under a hidden name and renamed; the manifest, written after all tasks have ended, is what makes files part of an archive: the
reader opens what it lists, nothing else.

Pages with equal payloads (SHA-1) are stored once, in the record with the smallest id; the others are revisit records. Who
refers to whom is found on ids and digests; the html is shuffled once, to its shard, where it meets the references.

Defined results: a null html is an empty payload, a null url an empty target; null ids sort first and are never the
record that others refer to; of repeated rows with the smallest id each is a response; other columns are not written; an
empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quillspark.llm.cluster import discard, filesystem, fresh_dir, staged

MANIFEST = "shard long, file int, path string, records long, bytes long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Bytes of html in a shard: LEAST, more where that makes over MANY shards, MOST at most. Shards beyond ALL don't exist, so the
#: keys that reach the driver, DRAWN a shard, are at most a few hundred thousand.
LEAST, MOST, MANY, ALL, DRAWN = 8 << 20, 1 << 30, 4096, 1 << 17, 8
#: The date of all records: files must not depend on the clock.
DATE = "1970-01-01T00:00:00Z"


def keyed(pages: DataFrame) -> DataFrame:
    """page_id, h (hash of the html), url and html."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.select("page_id", F.xxhash64("html").alias("h"), "url", "html")


def references(digests: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, h, digest and first: the smallest page_id of an equal payload, for pages that aren't that page themselves.

    ``digests`` has page_id, h, digest and bytes. Only these are joined; Spark splits a digest with very many pages.
    """
    large = digests.where(F.col("bytes") >= least_bytes)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    found = digests.join(firsts.select("digest", "first"), "digest").where("not page_id <=> first")
    return found.select("page_id", "h", "digest", "first").distinct()


def shard_bounds(digests: DataFrame, shard_bytes: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys at which shards begin: hashes of those without an id, then ids and hashes of the others, in order."""
    n, total = digests.agg(F.count("*"), F.sum("bytes")).first()
    size = shard_bytes or max(LEAST, min(MOST, (total or 0) // MANY))
    shards = min(ALL, -(-(total or 0) // size))
    picked = []
    if shards > 1:
        share = int(min(1.0, DRAWN * shards / n) * (1 << 30))
        picked = digests.where(F.pmod(F.xxhash64("page_id", "h", F.lit(9)), F.lit(1 << 30)) < share).select("page_id", "h").distinct().collect()
    picked = sorted((r["page_id"] is not None, r["page_id"] or 0, r["h"]) for r in picked)
    bounds = sorted({picked[i * len(picked) // shards] for i in range(1, shards)}) if picked else []
    rest = [x for x in bounds if x[0]]
    return tuple(np.array(x, np.int64) for x in ([h for known, _, h in bounds if not known], [i for _, i, _ in rest], [h for _, _, h in rest]))


def shards_of(ids: pd.Series, hashes: np.ndarray, bounds: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The shard of each key: how many bounds aren't above it."""
    null_h, bound_ids, bound_h = bounds
    known = ids.notna().to_numpy()
    out = np.searchsorted(null_h, hashes, "right")
    i = ids[known].to_numpy().astype(np.int64)
    low, high = np.searchsorted(bound_ids, i, "left"), np.searchsorted(bound_ids, i, "right")
    for k in np.flatnonzero(low < high):
        low[k] += np.searchsorted(bound_h[low[k] : high[k]], hashes[known][k], "right")
    out[known] = low + len(null_h)
    return out


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One WARC record; ``first`` is the page that a revisit record refers to, None for a response."""
    digest = hashlib.sha1(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest.hexdigest())),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join((url or "").splitlines())),
        ("WARC-Payload-Digest", f"sha1:{base32(digest.digest())}"),
        ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-ID", "" if page_id is None else str(page_id)),
        ("Payload-Length", str(len(payload))),
    ]
    if first is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(first, digest.hexdigest())),
            ("Refers-To-Page-ID", str(first)),
        ]
    fields.append(("Content-Length", str(len(block))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(pages: DataFrame, folder: str | None = None, shard_bytes: int | None = None, roll_bytes: int = 64 << 20, least_bytes: int = 0) -> DataFrame:
    """Writes the archive and returns its manifest, a row a file; only those rows and shard bounds pass through the driver."""
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    rows = keyed(pages)
    digests = staged(rows.select("page_id", "h", F.unhex(F.sha1("html")).alias("digest"), F.octet_length("html").cast("long").alias("bytes")), "digests")
    bounds = shard_bounds(digests, shard_bytes)

    @F.pandas_udf("int")
    def shard(ids: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(shards_of(ids, h.to_numpy(), bounds))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        attempt = TaskContext.get().taskAttemptId()
        current, file, out, hidden, name, records, size = -1, 0, None, "", "", 0, 0
        key, firsts = None, {}

        def close() -> pa.RecordBatch:
            out.close()
            fs.move(hidden, f"{base}/{name}")
            return pa.RecordBatch.from_pylist([dict(zip(names, (current, file, f"{folder}/{name}", records, size)))], schema=kinds)

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for s, page, h, digest, first, url, html in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns)):
                    if (page, h) != key:
                        key, firsts = (page, h), {}
                    if digest is not None:  # a reference; it comes before the pages it is for
                        firsts[digest] = first
                        continue
                    if out is not None and (s != current or size >= roll_bytes):
                        yield close()
                        out, file = None, file + 1
                    if s != current:
                        current, file = s, 0
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        name, records, size = f"shard-{current:08d}-{file:05d}.warc.gz", 0, 0
                        hidden = f"{base}/_{name}-{attempt}"
                        out = fs.open_output_stream(hidden, compression=None)
                    payload = html.encode("utf-8", "surrogatepass")
                    data = packed(record(page, url, payload, firsts.get(hashlib.sha1(payload).digest()) if firsts else None))
                    out.write(data)
                    records, size = records + 1, size + len(data)
        if out is not None:
            yield close()

    names = MANIFEST.replace(",", "").split()[::2]
    kinds = pa.schema([("shard", pa.int64()), ("file", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    refs = references(digests, least_bytes).select("page_id", "h", "digest", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    both = rows.select("page_id", "h", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("first"), "url", "html").unionByName(refs)
    # ids travel as text: pandas would turn a long column with nulls into doubles
    both = both.select((shard(F.col("page_id").cast("string"), "h") if sum(map(len, bounds)) else F.lit(0)).alias("shard"), *both.columns)
    both = both.repartition("shard").sortWithinPartitions("shard", "page_id", "h", F.col("digest").desc_nulls_last(), "url", "html")
    found = sorted(map(tuple, both.mapInArrow(write, MANIFEST).collect()))
    discard(digests)
    manifest = f"{folder}/_manifest"
    spark.createDataFrame(found, MANIFEST).coalesce(1).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields and the block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, block


def members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked members of a gzip stream, one at a time."""
    rest = b""
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            rest = rest or stream.read(step)
            if not rest:
                if out:
                    raise ValueError("the file ends within a record")
                return
            out.append(z.decompress(rest))
            rest = z.unused_data if z.eof else b""
        yield b"".join(out)


def read_warc(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the files that the manifest lists; block and payload digests are checked."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, name = filesystem(path)
                rows = []
                with fs.open_input_stream(name, compression=None) as stream:
                    for data in members(stream):
                        fields, block = parsed(data)
                        body = block.partition(b"\r\n\r\n")[2]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and digest != base32(hashlib.sha1(body).digest()):
                            raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
                        row = [fields["Page-ID"], fields["WARC-Target-URI"], fields["Payload-Length"], digest, fields["WARC-Type"], fields.get("Refers-To-Page-ID")]
                        rows.append(row + [body] * payload)
                        if len(rows) >= 500:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    texts = "page_id string, url string, payload_bytes string, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload
    rows = manifest.select("path").repartition(max(1, manifest.count()), "path").mapInPandas(read, texts)
    return rows.withColumns({k: F.expr(f"cast(nullif({k}, '') as long)") for k in ("page_id", "payload_bytes", "refers_to")})
