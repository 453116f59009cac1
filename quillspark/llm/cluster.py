"""Where shared files go, and how intermediate tables are cut from their lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.shared import fresh_dir

__all__ = ["discard", "filesystem", "fresh_dir", "map_arrow", "staged", "texts_of"]


#: Lets Spark delete a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: short lineage that survives lost executors.

    Once the table is written its shuffle files serve nothing, so they go at once.
    """
    spark, path = df.sparkSession, fresh_dir(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            fs, path = filesystem(folder)
            fs.delete_dir(path)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` whose workers give back what Arrow holds for reuse once a task is done: idle workers wait for a minute, and
    their memory counts with that of the executor's later stages."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(lean, schema)


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column one by one: of a batch only one is a string of Python's at a time."""
    return (x.as_py() for x in column)


def filesystem(uri: str):
    """(file system, path) by pyarrow for a shared URI, so tasks can write files that Spark has no writer for."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file:///" + uri.removeprefix("file:").lstrip("/"))
