"""CSV in blocks, archives and dumps: odd contents, many tasks, failed attempts."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import dumps
from quillspark.shared import filesystem, fresh_dir
from quillspark.sources import archives, csv_blocks


def file_of(spark, data: bytes) -> str:
    fs, path = filesystem(f"{fresh_dir(spark, 'csv')}/one.csv")
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(data)
    return "file://" + path


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["700", "128m"])
def test_csv_in_blocks(spark, newline, size):
    r = random.Random(6)
    cell = lambda: "".join(r.choice(["a", "b", ",", '"', "\n", "\r\n", " ", "é", "line\n" * 20]) for _ in range(r.randint(0, 12)))
    rows = [(str(i), cell(), cell()) for i in range(60)] + [("", "", "x")]
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c
    text = newline.join(["﻿id,\"first\nname\",c", *(",".join(map(quoted, row)) for row in rows[:30]), "", '""', *(",".join(map(quoted, row)) for row in rows[30:])])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        path = file_of(spark, text.encode())
        found = csv_blocks.read_csv_blocks(spark, path)
        assert found.columns == ["id", "first\nname", "c"]
        got = sorted(tuple(x or "" for x in row) for row in found.collect())
        if size != "128m":
            assert csv_blocks.records(spark, path).select("number").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(rows)


def test_csv_of_nothing(spark):
    assert csv_blocks.read_csv_blocks(spark, file_of(spark, b"")).count() == 0
    assert csv_blocks.read_csv_blocks(spark, file_of(spark, b"a,b\n")).columns == ["a", "b"]
    assert [tuple(r) for r in csv_blocks.read_csv_blocks(spark, file_of(spark, b'1,"open\nrecord'), header=False).collect()] == [("1", "open\nrecord")]


def names_in(fs, folder):
    from pyarrow import fs as kinds

    return [i.path for i in fs.get_file_info(kinds.FileSelector(folder, recursive=True))]


def test_archives_are_plain_zip_files(spark):
    rows = [(f"m{k}.txt", i, f"line {i} é\nmore") for k in range(7) for i in range(k)]
    members = spark.createDataFrame(rows, "member string, place int, text string").repartition(5)
    path = fresh_dir(spark, "zip") + "/x.zip"
    archives.write_archive(members, path)
    fs, name = filesystem(path)
    with fs.open_input_file(name) as f:
        archive = zipfile.ZipFile(io.BytesIO(f.read()))
    assert archive.testzip() is None and sorted(archive.namelist()) == [f"m{k}.txt" for k in range(1, 7)]
    assert archive.read("m3.txt").decode() == "".join(f"line {i} é\nmore\n" for i in range(3))
    back = archives.read_archive(spark, path)
    assert back.rdd.getNumPartitions() == 6
    assert [r["text"] for r in back.where("member = 'm2.txt'").orderBy("place").collect()] == ["line 0 é", "more", "line 1 é", "more"]
    assert names_in(fs, name.rpartition("/")[0]) == [name]


def test_failed_attempts_leave_nothing(spark):
    rows = spark.range(100).select(F.concat(F.lit("m"), F.col("id") % 5).alias("member"), F.col("id").alias("place"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise("x").alias("text"))
    folder = fresh_dir(spark, "zip")
    with pytest.raises(Exception, match="broken"):
        archives.write_archive(rows, f"{folder}/x.zip")
    fs, path = filesystem(folder)
    from pyarrow import fs as kinds

    assert fs.get_file_info(path).type == kinds.FileType.NotFound or not names_in(fs, path)


def test_dumps_of_literals_and_of_nothing(spark):
    df = spark.createDataFrame([(2, "it's", None), (1, None, 1.5)], "k int, v string, d double")
    rows = dumps.dump(df, "t", ["k"], files=1).orderBy("member", "place").collect()
    assert [r["member"] for r in rows] == ["t/data-000000.sql", "t/structure.sql", "t/structure.sql"]
    assert rows[0]["text"] == "INSERT INTO `t` (`k`, `v`, `d`) VALUES\n  (1, NULL, 1.5),\n  (2, 'it''s', NULL);"
    assert rows[1]["text"] == "DROP TABLE IF EXISTS `t`;" and rows[2]["text"].startswith("CREATE TABLE `t` (\n  `k` INT NOT NULL,")
    assert [r["member"] for r in dumps.dump(df.where("false"), "t", ["k"], drop=False).collect()] == ["t/structure.sql"]
