"""What grew faster than its input: many copies of a name, common bigrams, long texts, and pages and files in one task."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import matching, names, range_index, similarity
from quillspark.plans import registry, transfer_queries

WORDS = ["large ring", "small ring", "hot bolt", "hot bolts", "cold plate", "x"]


def copies(seed, n=90):
    r = random.Random(seed)
    ids = r.sample(range(1000), n)
    return [(k % 2, i, r.choice(WORDS) + r.choice(["", " 1", " 2"])) for k, i in enumerate(ids)]


@pytest.mark.parametrize("most", [0, 10**6])
def test_names_with_many_ids_match_one_to_one(spark, monkeypatch, most):
    """By a task a scope and by rounds of pairs: the same as taking the best pair again and again."""
    monkeypatch.setattr(similarity, "TASK_LINKS", most)
    sides = [spark.createDataFrame(copies(s), "s int, id long, name string") for s in (1, 2)]
    pairs = similarity.similar_names(*sides, ["s"], 0.6).collect()
    expected, old, new = set(), set(), set()
    for s, a, b, score in sorted(((p["s"], p["old_id"], p["new_id"], round(p["similarity"], 6)) for p in pairs), key=lambda p: (p[0], -p[3], p[1], p[2])):
        if (s, a) not in old and (s, b) not in new:
            old.add((s, a))
            new.add((s, b))
            expected.add((s, a, b, score))
    assert {tuple(r) for r in similarity.matched_names(*sides, ["s"], 0.6).select("s", "old_id", "new_id", "score").collect()} == expected


def test_blocks_link_what_rare_elements_link(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    sides = [spark.createDataFrame(copies(s), "s int, id long, name string") for s in (3, 4)]
    found = []
    for dense in (0, 10**9):
        monkeypatch.setattr(similarity, "DENSE", dense)
        found.append({tuple(r) for r in similarity.similar_names(*sides, ["s"], 0.7).collect()})
    assert found[0] == found[1] and found[0]


def test_halves_are_rounded_like_spark(spark):
    x = [0.0140625, 0.45 * 5 / 32, 0.1234565, 0.5, 1.0, 0.0, 1 / 3, 0.2 * 0.7 + 0.45]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round(F.round("v", 9), 6)).collect()
    assert similarity.rounded(similarity.rounded(np.array(x), 9), 6).tolist() == [r[0] for r in rows]


def test_column_scores_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 2)
    old, new = registry.matching_queries.fixed_versions(spark)
    scope = ["sheet", "table_id"]
    struct = lambda df, side: df.select(*scope, F.struct("position", *matching.FIELDS).alias(side))
    each = struct(old, "o").join(struct(new, "n"), scope).select(*scope, "o.position", "n.position", matching.column_score(F.col("o"), F.col("n"))).collect()
    got = matching.column_scores(old, new, scope).select(*scope, "old_position", "new_position", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, each)) and len(got) > 20


def test_long_texts_are_compared_in_proportion(spark):
    """Equal bigrams are numbered without looking for the first of them each time."""
    n = 120_000
    began = time.perf_counter()
    row = spark.range(1).select(text.dice(F.repeat(F.lit("ab"), n // 2), F.concat(F.repeat(F.lit("ab"), n // 2 - 1), F.lit("b"))).alias("d")).first()
    assert row["d"] == pytest.approx(2 * (n - 3) / (2 * n - 3), abs=1e-12) and time.perf_counter() - began < 20


@pytest.mark.parametrize("most", [64, 13])
def test_names_told_apart_by_spark_as_one_by_one(spark, most):
    r = random.Random(6)
    found = ["a", "a_2", "A", "b", "b_7", "a_2_2", "brand_1", "brand_2", "abcdefghijkl", "abcdefghijkm", "x_9_"]
    rows = [(k % 2, k, r.choice(found)) for k in range(120)]
    got = {x["k"]: (x["after"], list(x["reasons"])) for x in names.name_plan(spark.createDataFrame(rows, "s int, k int, name string"), ["s"], "k", ["name"], "'x'", most=most).collect()}
    plain = {x["k"]: x["p"] for x in spark.createDataFrame(rows, "s int, k int, name string").select("k", text.physical_name(F.col("name"), "").alias("p")).collect()}
    for s in (0, 1):
        keys = [k for t, k, _ in rows if t == s]
        used = set()
        for k in keys:
            tries = [plain[k], *(names.suffixed(plain[k], f"_{i}", most) for i in range(2, 200))]
            expected = next(x for x in tries if x not in used)
            used.add(expected)
            assert got[k] == (expected, ["duplicate_resolved"] if expected != plain[k] else [])


def test_more_than_ten_thousand_equal_names():
    after, stuck = names.told_apart(["a"] * 12_000, [""] * 12_000, 64, "suffix_increment")
    assert after[-1] == "a_12000" and not any(stuck)


def test_pages_over_many_ranges_are_no_single_task(spark, monkeypatch):
    monkeypatch.setattr(range_index, "RANGE_ROWS", 50)
    index = range_index.RangeIndex(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"], ranges=5)
    assert len(index.parts) >= 18
    for offset, limit in ((0, 999), (130, 500), (700, 400), (49, 51)):
        page = index.page(limit, offset)
        assert [x["k"] for x in page.collect()] == list(range(offset, min(1000, offset + limit + 1)))


def test_csv_is_written_by_many_tasks(spark):
    df = spark.range(40).select(F.col("id"), F.concat(F.lit('a "b",\n'), "id").alias("t")).repartition(4)
    path = transfer_queries.csv_file(df)
    assert spark.read.text(path).select(F.input_file_name()).distinct().count() == 4
    rows = transfer_queries.csv_blocks.read_csv_blocks(spark, path, "id long, t string", header=False).collect()
    assert sorted(map(tuple, rows)) == [(i, f'a "b",\n{i}') for i in range(40)]


def counting(df, seen):
    """``df``, and in ``seen`` how many of its rows were made."""
    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_definitions_are_made_once_for_all_changes(spark):
    old, new = registry.matching_queries.fixed_versions(spark)
    seen = spark.sparkContext.accumulator(0)
    tables, columns = matching.schema_changes(counting(old, seen), counting(new, seen))
    expected = old.count() + new.count()
    assert matching.summary(tables, columns).first()["changed_columns"] == 4 and len(matching.changed_names(tables, columns).collect()) == 12
    assert seen.value == expected


def test_each_row_has_one_outcome(spark):
    """Equal, empty and missing names, and ids that stand twice: a row is matched once or stays alone."""
    schema = "s int, x struct<id: int, physical: string, logical: string, data_type: string, size: string, not_null: boolean, is_pk: boolean, comment: string>"
    row = lambda s, i, p, l: (s, (i, p, l, "int", None, True, False, None))
    old = [row(1, 1, "a", "A"), row(1, 2, "a", "A"), row(1, 3, "", "L"), row(1, 4, None, "L"), row(1, 5, None, None), row(1, 6, "order_number", "N"), row(2, 1, "a", "A"), row(2, 7, "b", "B"), row(2, 7, "b", "B"), row(3, 1, "z", "Z")]
    new = [row(1, 1, "A ", "A"), row(1, 3, "", "l"), row(1, 8, "order_numbers", "N"), row(1, 9, "", None), row(2, 1, "b", "B"), row(2, 2, "", "A"), row(4, 1, "z", "Z")]
    sides = [spark.createDataFrame(rows, schema) for rows in (old, new)]
    got = [((r["s"], r["o"] and r["o"]["id"]), (r["s"], r["n"] and r["n"]["id"]), r["phase"]) for r in matching.outcome(*sides, ["s"], matching.column_score).collect()]
    assert sorted(a for a, _, _ in got if a[1]) == sorted((s, x[0]) for s, x in old) and sorted(b for _, b, _ in got if b[1]) == sorted((s, x[0]) for s, x in new)
    pairs = sorted((a, b[1], p) for a, b, p in got if a[1] and b[1])
    assert pairs == [((1, 1), 1, "physical"), ((1, 3), 3, "logical"), ((1, 5), 9, "fuzzy"), ((1, 6), 8, "fuzzy"), ((2, 7), 1, "physical")]
    assert all(p is None for a, b, p in got if not (a[1] and b[1]))
