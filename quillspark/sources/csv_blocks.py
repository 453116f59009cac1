"""CSV files with quoted line ends, read by many tasks.

A file is scanned as lines, which Spark splits into blocks; but a line is a record's end only outside quotes, and a block alone
doesn't tell whether it begins within them. Quotes are doubled or stand in pairs, so what counts is whether their number is odd.
A first pass adds that up for each block, and the blocks of a file in order say how each begins (one row a block). A second pass
joins the lines of each block to records; of records that go on in another block, or come from one, the fragments, at most two
a block, are put together by a shuffle of those alone. The records are then parsed by Spark's own CSV functions.

Defined results: a record of one empty cell is dropped; line feeds, with or without carriage returns, end records; a byte order
mark goes; a record that is too short has nulls at its end; what is open at the end of a file is a record; empty files have no
rows. A file whose quotes are odd within a record (not doubled, in an unquoted cell) isn't valid, and is read otherwise.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.shared import settled

_BLOCK = ["file", "start"]
RECORDS = "file string, start long, place long, part string, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the block) and value of each line; lines keep a carriage return at their end."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return spark.read.option("lineSep", "\n").text(path).select(*at, "value")


def _openings(lines: DataFrame) -> DataFrame:
    """file, start, whether a block begins within quotes, and number, its place in its file. One row a block."""
    sums = lines.groupBy(*_BLOCK).agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    order = W.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("quotes").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*_BLOCK, (before % 2 == 1).alias("opened"), F.row_number().over(order).alias("number"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, number (of the block where the record begins), place (in the block) and text of each record of the files at ``path``."""
    lines = _lines(spark, path)
    openings = settled(_openings(lines), "blocks")
    known = {(r["file"], r["start"]): (r["opened"], r["number"]) for r in openings.collect()}  # one row a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, opened, place, first = None, [], False, 0, ""
        rows: list[tuple] = []

        def closed() -> None:
            """What is held of a block at its end goes on in the next one, if quotes are open."""
            if held:
                rows.append((here[0], known[here][1], place, first if opened else "whole" if first == "head" else "tail", "\n".join(held)))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "place", "part", "text"])
            rows.clear()
            return made

        for batch in batches:
            for file, start, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != here:
                    closed()
                    here, held, place = (file, start), [], 0
                    if here not in known:
                        raise ValueError("the files or the size of splits have changed since the first pass")
                    opened = known[here][0]
                    first = "middle" if opened else "head"
                held.append(value)
                if value.count('"') % 2:
                    opened = not opened
                if not opened:
                    # the end of a record that another block began, or a whole one
                    rows.append((file, known[here][1], place, "tail" if first == "middle" else "whole", "\n".join(held)))
                    held, first, place = [], "head", place + 1
            yield out()
        closed()
        yield out()

    parts = lines.mapInArrow(run, RECORDS)
    parts = settled(parts, "records").withColumnRenamed("start", "number")
    # heads begin a record, middles and tails go on with the one before them in the file
    order = W.partitionBy("file").orderBy("number", "place")
    torn = parts.where("part != 'whole'").withColumn("record", F.sum((F.col("part") == "head").cast("long")).over(order))
    each = F.array_sort(F.collect_list(F.struct("number", "place", "text")))
    mended = torn.groupBy("file", "record").agg(F.min(F.struct("number", "place")).alias("at"), F.array_join(each["text"], "\n").alias("text"))
    return parts.where("part = 'whole'").select("file", "number", "place", "text").unionByName(mended.select("file", "at.number", "at.place", "text"))


def read_csv_blocks(spark: SparkSession, path: str, schema: str | None = None, delimiter: str = ",", header: bool = True) -> DataFrame:
    """The rows of CSV files. Without a schema all columns are text, named by the first file's header, or column_1 and so on."""
    found = records(spark, path)
    found = found.withColumn("text", F.regexp_replace(F.when(F.col("number") == 1, F.regexp_replace("text", "^﻿", "")).otherwise(F.col("text")), "\r$", ""))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "nullValue": "", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "lineSep": "\n"}
    if schema is None:
        # one record tells the number of cells, and their names
        top = (found.where("number = 1 and place = 0") if header else found.where("text not in ('', '\"\"')")).orderBy("file", "number", "place").select("text").first()
        cells = next(csv.reader(io.StringIO(top["text"], newline=""), delimiter=delimiter), []) if top else []
        schema = ", ".join(f"`{c.replace('`', '``')}` string" if header else f"column_{i + 1} string" for i, c in enumerate(cells or [""])) if cells or not header else "column_1 string"
    if header:
        found = found.where("not (number = 1 and place = 0)")
    return found.where("text not in ('', '\"\"')").select(F.from_csv("text", schema, options).alias("row")).select("row.*")
