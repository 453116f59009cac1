"""Operator 4: sharding by fixed virtual slots.

Every record belongs to one of a fixed number of virtual slots by the hash of its id and text. Bytes and rows are summed for each
slot, and a slot-to-shard map, written under a version number, places slots on shards so that the bytes of shards come out
near equal. Rebalancing edits the map: a new version moves as few slots as it can; records keep their slots.

Defined results: a null text has no bytes and the crc32 of the empty text; texts that share an id, or have none, are spread; empty texts
and repeated rows are placed like any others, ties within a slot being ordered by id, checksum and size; an empty table
gives an empty result. Only a map of ``slots`` rows, a number that does not grow with the data, reaches the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.cluster import fresh_dir

SLOTS = 8192
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


def virtual_slot(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text), F.lit(slots)).cast("int")


def slotted(df: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of each record."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + RECORD_BYTES).alias("size"), F.crc32(body).alias("text_crc32"), virtual_slot(F.col(doc_id), body, slots).alias("vslot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """vslot, bytes, rows: summed before the shuffle, so a task sends at most one row a slot."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def new_map(sizes: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Slot to shard for (slot, bytes, rows): the largest slots first, each to the shard with the fewest bytes so far."""
    heap, placed = [(0, s) for s in range(shards)], {}
    for slot, size, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[slot] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def rebalanced(old: dict[int, int], sizes: list[tuple[int, int, int]], shards: int, slack: float = 0.02) -> dict[int, int]:
    """``old`` edited for ``shards`` shards: slots leave only shards above the mean (or that are gone) by over ``slack``."""
    size = {s: b for s, b, _ in sizes}
    placed = {s: old.get(s, -1) for s in size}
    load = {k: 0 for k in range(shards)}
    for s, k in placed.items():
        if k in load:
            load[k] += size[s]
    mean = sum(size.values()) / shards
    moving = []
    for s in sorted(size, key=lambda s: (size[s], s)):
        k = placed[s]
        if k not in load:
            moving.append(s)
        elif load[k] - size[s] >= mean and load[k] > mean * (1 + slack):
            load[k] -= size[s]
            moving.append(s)
    heap = [(b, k) for k, b in load.items()]
    heapq.heapify(heap)
    for s in sorted(moving, key=lambda s: (-size[s], s)):
        b, k = heapq.heappop(heap)
        placed[s] = k
        heapq.heappush(heap, (b + size[s], k))
    return placed


def write_map(spark: SparkSession, placed: dict[int, int], sizes: list[tuple[int, int, int]], folder: str, version: int) -> DataFrame:
    """Stores a version of the map (vslot, shard, bytes, rows, offset: rows of the shard's slots before) and reads it back."""
    before: dict[int, int] = {}
    out = []
    for slot, size, rows in sorted(sizes):
        shard = placed[slot]
        out.append((slot, shard, size, rows, before.get(shard, 0)))
        before[shard] = before.get(shard, 0) + rows
    path, schema = f"{folder}/version={version}", "vslot int, shard int, bytes long, rows long, offset long"
    spark.createDataFrame(out, schema).coalesce(1).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def shard(df: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", slots: int = SLOTS, folder: str | None = None, old: dict[int, int] | None = None, version: int = 1) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard and slot, the record's place in its shard; no gaps, from 0.

    The place is the number of rows in the shard's earlier virtual slots plus the place within the virtual slot, so no
    task sorts a whole shard.
    """
    spark = df.sparkSession
    rows = slotted(df, doc_id, text, slots)
    sizes = [tuple(r) for r in slot_sizes(rows).collect()]
    placed = rebalanced(old, sizes, shards) if old else new_map(sizes, shards)
    table = write_map(spark, placed, sizes, folder or fresh_dir(spark, "slot-map"), version)
    place = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    rows = rows.withColumn("place", place - 1)
    return rows.join(F.broadcast(table.select("vslot", "shard", "offset")), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"))
