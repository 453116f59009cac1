"""Stored jobs, decisions and plans: an append-only log of records that are read as of their latest state.

Every append is a segment of its own, a Parquet folder, and a log entry that names all segments in order. Of records with one
kind and id the latest counts, by time and then by segment; one that is marked as deleted hides those before it. Compaction
writes what counts as one segment and names that instead of those it stands for; appends that came meanwhile stay behind it.
Two writers never lose each other's records: who comes second names the other's segments too.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.versioned import Log, Refused

RECORD = "kind string, id string, at timestamp, payload string, deleted boolean"


class RecordLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Log(spark, f"{folder.rstrip('/')}/log")

    def segments(self) -> tuple[int, list[str]]:
        """The newest entry's number and its segments in order."""
        number = (self.log.numbers() or [0])[-1]
        return number, self.log.read(number)["segments"] if number else []

    def _write(self, records: DataFrame) -> str:
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        records.write.parquet(path)
        return path

    def append(self, records: DataFrame) -> None:
        """Adds records (kind, id, at, payload and, if there is one, deleted)."""
        deleted = F.coalesce("deleted", F.lit(False)) if "deleted" in records.columns else F.lit(False)
        path = self._write(records.select("kind", F.col("id").cast("string").alias("id"), F.col("at").cast("timestamp").alias("at"), "payload", deleted.alias("deleted")))
        while True:
            number, segments = self.segments()
            try:
                return self.log.append(number + 1, {"segments": [*segments, path]})
            except Refused:
                continue

    def _latest(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], RECORD)
        each = [self.spark.read.schema(RECORD).parquet(path).withColumn("place", F.lit(i)) for i, path in enumerate(segments)]
        rows = reduce(DataFrame.unionByName, each).groupBy("kind", "id").agg(F.max_by(F.struct("at", "payload", "deleted"), F.struct("at", "place", "payload")).alias("x"))
        return rows.select("kind", "id", "x.at", "x.payload", "x.deleted")

    def read(self, kind: str | None = None) -> DataFrame:
        """kind, id, at and payload of all records as they are now."""
        rows = self._latest(self.segments()[1])
        rows = rows if kind is None else rows.where(F.col("kind") == kind)
        return rows.where("not deleted").drop("deleted")

    def newest(self, kind: str, limit: int = 25) -> DataFrame:
        """The latest records of a kind, between 1 and 100 of them."""
        return self.read(kind).orderBy(F.desc("at"), F.desc("id")).limit(min(max(limit, 1), 100))

    def compact(self) -> int:
        """Writes one segment in the place of those that are there, and gives how many it stands for."""
        _, seen = self.segments()
        if len(seen) < 2:
            return 0
        # deleted records go: no older segment is left that they could hide
        path = self._write(self._latest(seen).where("not deleted"))
        while True:
            number, segments = self.segments()
            if segments[: len(seen)] != seen:
                raise Refused("another compaction came first")
            try:
                self.log.append(number + 1, {"segments": [path, *segments[len(seen) :]]})
                return len(seen)
            except Refused:
                continue
