"""Semantics that the tables don't show: nulls, duplicates, drift, guards and text."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import apply, diff, matching, paging
from quillspark.plans import sqltext
from quillspark.sources import files
from quillspark.streaming import windows


def test_null_keys_match(spark):
    s = spark.createDataFrame([(None, "a"), (1, "b")], "id long, v string")
    t = spark.createDataFrame([(None, "a"), (2, "b")], "id long, v string")
    assert {(r["id"], r["status"]) for r in diff.classify(s, t, ["id"]).collect()} == {(None, "unchanged"), (1, "source_only"), (2, "target_only")}


def test_column_on_one_side_is_a_change(spark):
    s = spark.createDataFrame([(1, None)], "id long, extra string")
    t = spark.createDataFrame([(1,)], "id long")
    assert diff.classify(s, t, ["id"]).first()["status"] == "value_changed"
    assert diff.classify(s.drop("extra"), t, ["id"]).first()["status"] == "unchanged"


def test_changed_field_only(spark):
    s = spark.createDataFrame([(1, "new@example.com", True)], "id long, email string, active boolean")
    t = spark.createDataFrame([(1, "old@example.com", True)], "id long, email string, active boolean")
    row = diff.classify(s, t, ["id"]).first()
    assert (row["changed"], row["action"]) == (["email"], "update")


def test_apply_reaches_the_source(spark):
    s = spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "id long, v string")
    t = spark.createDataFrame([(1, "x"), (2, "b"), (3, "c")], "id long, v string")
    made = apply.apply_changes(t, diff.classify(s, t, ["id"]), ["id"])
    assert sorted(made.collect()) == sorted(s.collect())
    assert diff.snapshot_hash(made).first() == diff.snapshot_hash(s).first() != diff.snapshot_hash(t).first()


def test_sample_falls_back_to_unchanged(spark):
    s = spark.range(5).withColumn("v", F.lit("a"))
    assert diff.sample_rows(diff.classify(s, s, ["id"]), ["id"], 3).count() == 3


def test_stable_key():
    assert diff.stable_key([], [[], ["code"]], ["b"]) == ["code"] and diff.stable_key(["id"], [["code"]], []) == ["id"]
    with pytest.raises(ValueError):
        diff.stable_key([], [], [])
    assert diff.compare_columns(None, ["id", "name"], ["id", "name"], ["id"]) == ["name"]


def test_pages(spark):
    page = paging.fetch_page(spark.range(10), ["id"], 4, 4)
    assert ([r["id"] for r in page.rows], page.has_more, page.next_offset) == ([4, 5, 6, 7], True, 8)
    assert paging.fetch_page(spark.range(10), ["id"], 4, 8).next_offset is None
    rows, cut = paging.export_rows(spark.range(10), ["id"], 7)
    assert rows.count() == 7 and cut


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (text.normalize_name, "  Order  Item ", "order_item"),
        (text.physical_name, "orderItemId", "order_item_id"),
        (text.physical_name, "2nd-value", "t_2nd_value"),
        (text.physical_name, "日本", "unnamed"),
        (text.sql_literal, "O'Brien\\", "'O''Brien\\'"),
        (lambda c: text.sql_literal(c, backslashes=True), "a\\b", "'a\\\\b'"),
        (text.sql_literal, None, "NULL"),
        (text.csv_cell, 'say "hi", x', '"say ""hi"", x"'),
        (text.sql_pattern, "SELECT *  FROM t WHERE a = 'x' AND b IN (1, 2);", "SELECT * FROM t WHERE a = ? AND b IN (?, ?);"),
        (text.comment_meaning, " a \r\n\r\n b", "a\nb"),
        (text.class_name, "order item_id", "OrderItemId"),
        (text.constant_name, "order item-id", "ORDER_ITEM_ID"),
        (lambda c: text.kind_of(c, text.CELL_KINDS, "blank"), "2024-01-02 10:00", "datetime"),
        (lambda c: text.kind_of(c, text.CELL_KINDS, "blank"), "2.5", "decimal"),
        (lambda c: text.kind_of(c, text.VALUE_KINDS, "blank"), "a@b.co", "email-like"),
    ],
)
def test_text(spark, f, given, expected):
    assert one(spark, given, f) == expected


def test_short_hash(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return f"{h:08x}"[:6]

    for s in ("", "orders", "日本語"):
        assert one(spark, s, text.short_hash) == fnv(s)


def test_dice_counts_repeats(spark):
    rows = spark.createDataFrame([("aaaa", "aa"), ("", ""), ("a", ""), ("Night", "nacht")], "a string, b string")
    assert [round(r["s"], 4) for r in rows.select(text.dice(F.col("a"), F.col("b")).alias("s")).collect()] == [0.5, 1.0, 0.0, 0.25]


def test_greedy_pairs_are_one_to_one(spark):
    scores = spark.createDataFrame([("t", 1, 1, 0.9), ("t", 1, 2, 0.8), ("t", 2, 1, 0.85), ("t", 2, 2, 0.3)], "scope string, old_id int, new_id int, score double")
    assert {(r["old_id"], r["new_id"]) for r in matching.similarity.one_to_one(scores, ["scope"]).collect()} == {(1, 1), (2, 2)}


def test_statements():
    assert sqltext.split_statements("select ';' ; -- a;b\n; select \"x;y\" /* ; */") == ["select ';'", "select \"x;y\" /* ; */"]
    assert sqltext.statement_at("select 1; select 2", 14) == "select 2"
    assert sqltext.parameters("select :a, '{{no}}', {{b}}, x::int -- :c") == ["a", "b"]
    assert sqltext.single_expression("  ") is None and sqltext.single_expression("id = 1") == "id = 1"
    with pytest.raises(ValueError):
        sqltext.single_expression("id = 1; DELETE FROM users")


@pytest.mark.parametrize(
    ("statement", "expected"),
    [("drop table t", "DROP"), ("truncate table t", "TRUNCATE"), ("delete from t", "DELETE_WITHOUT_WHERE"), ("delete from t where a = 1", None), ("update t set a = 1", "UPDATE_WITHOUT_WHERE"), ("update t set a = 1 where b = 2", None), ("alter table t add columns (a int)", "ALTER_TABLE"), ("select 1", None), ("selec 1", "UNPARSED")],
)
def test_danger(spark, statement, expected):
    assert sqltext.danger(spark, statement) == expected


def test_guards(spark):
    assert sqltext.read_only(spark, "with a as (select 1) select * from a") and not sqltext.read_only(spark, "insert into t select 1")
    assert sqltext.mode(spark, "select 1") == "pageable" and sqltext.mode(spark, "show tables") == "result" and sqltext.mode(spark, "drop table t") == "command"
    assert sqltext.guarded(spark, "select 1 as x").first()["x"] == 1
    with pytest.raises(PermissionError):
        sqltext.guarded(spark, "drop table t")
    assert sqltext.bound(spark, "select {{a}} as x, :b as y", {"a": 1, "b": "q"}).first().asDict() == {"x": 1, "y": "q"}


def test_connection_text():
    c = files.parse_connection("postgres://me:p%40ss@db.example:6000/shop?sslmode=require")
    assert (c["driver"], c["port"], c["password"], c["tls"]) == ("postgresql", 6000, "p@ss", "require")
    assert files.jdbc_options(c, "t", ("id", 0, 100, 4))["numPartitions"] == "4"
    with pytest.raises(ValueError):
        files.parse_connection("http://x")


def test_csv_with_quotes_and_line_ends(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'hello, "world"'), (2, "two\nlines"), (3, None)], "id int, note string")
    files.write_csv(rows, f"file://{tmp_path}/x")
    assert sorted(files.read_csv(spark, f"file://{tmp_path}/x", "id int, note string").collect()) == sorted(rows.collect())


def test_blockers():
    assert apply.blockers(10, 5, "a", "a", False, 3, 100, 0) == []
    assert apply.blockers(1, 5, "a", "b", True, 300, 100, 2) == [("compare_expired", "error"), ("target_changed", "error"), ("readonly_target", "error"), ("empty_key", "error"), ("many_deletes", "warning")]


def test_stream_counts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, k string")
    rows.write.parquet(f"file://{tmp_path}/in")
    q = windows.upsert_counts(spark, spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), "k", "counts_k")
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counts_k").collect()} == {("a", 2), ("b", 1)}
