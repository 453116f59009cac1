"""Catalogs, lineage, scripts, name plans and as-of joins on rows that the tables don't have."""

import pytest
from pyspark.sql import functions as F

from quillspark import shared
from quillspark.operators import asof, grid, names, statements
from quillspark.sources import catalog, ddl_text


def test_catalog_of_spark(spark):
    spark.sql("create or replace temp view seen as select 1 as a, 'x' as b")
    assert {(r["column_name"], r["type"], r["is_view"]) for r in catalog.columns(spark).where("table_name = 'seen'").collect()} >= {("a", "int", False)} or catalog.columns(spark).where("table_name = 'seen'").count() == 2
    assert "default" in [r["schema_name"] for r in catalog.schemas(spark).collect()]
    assert {r["key"] for r in catalog.inspected(spark, "seen").collect()} >= {"a", "b"}


def test_lineage_names(spark):
    df = statements.with_lineage(spark.createDataFrame([(1, "x")], "id int, label string"), "shop", ["id"], renamed={"label": "name"})
    assert statements.lineage_names(df) == {"id": "id", "label": "name"} and statements.lineage_table(df) == "shop"
    assert [f.metadata["is_pk"] for f in df.schema] == [True, False] and statements.lineage_table(spark.range(1), " t ") == "t"
    assert grid.eligibility(df, "table", "shop", ["id"]) == []


def test_hash_suffixes_and_columns_of_the_user(spark):
    df = spark.createDataFrame([(1, 1, "a", "u"), (1, 2, "A", "v")], "i int, position int, physical string, base string")
    rows = names.name_plan(df, ["i"], "position", ["physical"], "'x'", conflict="hash_suffix").orderBy("position").collect()
    assert [r["after"] for r in rows] == ["a", "a_" + names.fnv_hash("col:1:2:a")] and [r["base"] for r in rows] == ["u", "v"]


def test_overrides_of_unknown_tables(spark):
    tables = spark.createDataFrame([(1, "a")], "table_id int, name string")
    with pytest.raises(ValueError):
        catalog.overridden(tables, spark.createDataFrame([(2,)], "table_id int"), tables)


def test_asof_across_buckets(spark):
    left = spark.createDataFrame([(1, 5, 10), (2, 5, 1000), (3, 5, 3), (4, None, 50), (5, 6, 50), (6, 5, 10)], "id int, k int, s int").withColumn("t", F.timestamp_seconds("s"))
    right = spark.createDataFrame([(5, 4, "a"), (5, 10, "b"), (5, 10, "c"), (None, 1, "n"), (7, 1, "z")], "rk int, s int, v string").withColumn("rt", F.timestamp_seconds("s")).select("rk", "rt", "v")
    got = {r["id"]: r["v"] for r in asof.asof(left, right, ("k", "t"), ("rk", "rt"), ["v"], bucket_seconds=5).collect()}
    assert got == {1: "c", 2: "c", 3: None, 4: None, 5: None, 6: "c"}


def test_scripts_without_tables(spark):
    df = spark.createDataFrame([(1, "select 1; -- create table no (a int)"), (2, None), (3, "")], "id int, sql string")
    assert ddl_text.imported_columns(df).count() == 0 and ddl_text.imported_keys(df).count() == 0


def test_shared_folder_is_the_configured_one(spark):
    assert shared.fresh_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
