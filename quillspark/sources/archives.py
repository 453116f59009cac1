"""Zip archives as a data source of Spark: tasks deflate members side by side, the commit joins them.

Rows are (member, place, text): the lines of a member in the order of place. A member's rows must follow each other in one
partition (``write_archive`` sees to that). Each task writes its members as an archive of its own under a hidden name; these are
joined by copying their compressed bytes as they are, a stretch at a time, and writing one directory behind them. The archive
appears by a rename when all is done; an attempt that fails leaves nothing. Reading makes a partition of each member.
"""

from __future__ import annotations

import io
import itertools
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quillspark.shared import filesystem

#: Bytes that are copied at once.
STRETCH = 1 << 20
SCHEMA = "member string, place long, text string"
#: Fixed value: the time that members bear, so that equal contents give equal archives.
AT = (1980, 1, 1, 0, 0, 0)


@dataclass
class Part(WriterCommitMessage):
    path: str | None
    first: str | None


@dataclass
class Member(InputPartition):
    name: str


class ArchiveWriter(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri, self.attempt = uri, uuid.uuid4().hex

    def _hidden(self) -> str:
        folder, _, name = self.uri.rpartition("/")
        return f"{folder}/_{name}-{self.attempt}"

    def write(self, rows: Iterator) -> Part:
        fs, base = filesystem(self._hidden())
        groups = itertools.groupby(rows, key=lambda r: r[0])
        first = next(groups, None)
        if first is None:
            return Part(None, None)
        fs.create_dir(base, recursive=True)
        path, seen = f"{base}/{uuid.uuid4().hex}", set()
        with fs.open_output_stream(path, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, lines in itertools.chain([first], groups):
                if name in seen:
                    raise ValueError(f"the rows of member {name} don't follow each other")
                seen.add(name)
                info = zipfile.ZipInfo(name, AT)
                info.compress_type = zipfile.ZIP_DEFLATED
                with archive.open(info, "w", force_zip64=True) as member:
                    for row in lines:
                        member.write(f"{row[2]}\n".encode())
        return Part(path, first[0])

    def commit(self, messages: list[Part | None]) -> None:
        fs, target = filesystem(self.uri)
        parts = sorted((m for m in messages if m and m.path), key=lambda m: m.first)
        fs.create_dir(target.rpartition("/")[0], recursive=True)
        hidden = f"{target.rpartition('/')[0]}/_{self.attempt}.zip"
        with fs.open_output_stream(hidden, compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as joined:
            at = 0
            for part in parts:
                with fs.open_input_file(part.path) as file, zipfile.ZipFile(file) as archive:
                    members, size = archive.infolist(), archive.start_dir
                    file.seek(0)
                    for i in range(0, size, STRETCH):
                        joined.fp.write(file.read(min(STRETCH, size - i)))
                for info in members:
                    if info.filename in joined.NameToInfo:
                        raise ValueError(f"member {info.filename} was written by two tasks")
                    info.header_offset += at
                    joined.filelist.append(info)
                    joined.NameToInfo[info.filename] = info
                at += size
            joined.start_dir, joined._didModify = at, True
        fs.move(hidden, target)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs as kinds

        fs, base = filesystem(self._hidden())
        if fs.get_file_info(base).type != kinds.FileType.NotFound:
            fs.delete_dir(base)


class ArchiveReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[Member]:
        fs, path = filesystem(self.uri)
        with fs.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
            return [Member(i.filename) for i in archive.infolist()]

    def read(self, partition: Member) -> Iterator[tuple]:
        fs, path = filesystem(self.uri)
        with fs.open_input_file(path) as file, zipfile.ZipFile(file) as archive, archive.open(partition.name) as member:
            for place, line in enumerate(io.TextIOWrapper(member, "utf-8", newline="\n")):
                yield partition.name, place, line.removesuffix("\n")


class Archive(DataSource):
    """Format ``archive``, option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def write_archive(members: DataFrame, path: str) -> None:
    """Writes rows of member, place and text as one archive, each text a line or more. Members are dealt over tasks by their name."""
    spark = members.sparkSession
    spark.dataSource.register(Archive)
    rows = members.select("member", F.col("place").cast("long").alias("place"), "text").repartition("member").sortWithinPartitions("member", "place")
    rows.write.format("archive").option("path", path).mode("append").save()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """member, place and text of each line of an archive."""
    spark.dataSource.register(Archive)
    return spark.read.format("archive").option("path", path).load()
