"""Pages by ranges, stored records and folded names."""

import datetime
import threading

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators.range_index import RangeIndex
from quillspark.shared import fresh_dir
from quillspark.sources.records import RecordLog


def test_pages_open_their_ranges_only(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(4)
    index = RangeIndex(df, ["k"], ranges=8)
    assert index.n_rows == 1000 and len(index.parts) == 8
    for offset, limit in ((0, 10), (123, 50), (480, 300), (990, 50), (999, 1), (1000, 5), (5000, 5)):
        page = index.page(limit, offset)
        assert [r["k"] for r in page.collect()] == list(range(offset, min(1000, offset + limit + 1)))
        assert page.columns == ["k", "v"]
    assert len(index.ranges_of(700, 11)[0]) <= 2 and "PartitionFilters: [" in (plan := index.page(10, 700)._jdf.queryExecution().toString()) and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert RangeIndex(df.where("false"), ["k"]).page(10).count() == 0


def test_records_of_two_writers(spark):
    log = RecordLog(spark, fresh_dir(spark, "records"))
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = lambda *found: spark.createDataFrame(list(found), "kind string, id string, at timestamp, payload string")
    assert log.read().count() == 0 and log.compact() == 0
    frames = [rows(("job", str(i), at(1), f"first {i}"), ("job", "x", at(i), f"state {i}")) for i in range(4)]
    threads = [threading.Thread(target=log.append, args=(f,)) for f in frames]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    state = lambda: {r["id"]: r["payload"] for r in log.read("job").collect()}
    expected = {**{str(i): f"first {i}" for i in range(4)}, "x": "state 3"}
    assert state() == expected
    assert log.compact() == 4 and state() == expected and len(log.segments()[1]) == 1
    log.append(rows(("job", "x", at(2), "late"), ("plan", "x", at(1), "a plan")))
    log.append(rows(("job", "0", at(5), None)).withColumn("deleted", F.lit(True)))
    del expected["0"]
    assert state() == expected and [r["payload"] for r in log.newest("job", 1).collect()] == ["state 3"] and log.read("plan").count() == 1
    assert log.compact() == 3 and state() == expected


def test_compatibility_forms(spark):
    df = spark.createDataFrame([(1, "Ｏｒｄｅｒ＿Ｎｏ"), (2, "ﾃﾞｰﾀ"), (3, "①ﬁ"), (4, "plain"), (5, None)], "id int, name string")
    assert [r["x"] for r in df.select("id", text.nfkc(F.col("name")).alias("x")).orderBy("id").collect()] == ["Order_No", "データ", "1fi", "plain", None]
    assert [r["id"] for r in df.where(text.fuzzy_match(F.col("name"), "ＯＲＤＥＲ no")).collect()] == [1]
