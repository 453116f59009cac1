"""Similarity joins and one-to-one matches against brute force."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import matching, similarity
from quillspark.plans import registry


def grams(name):
    x = "_".join((name or "").strip().lower().split())
    return collections.Counter([x] if len(x) < 2 else [x[i : i + 2] for i in range(len(x) - 1)])


def dice(a, b):
    x, y = grams(a), grams(b)
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


@pytest.mark.parametrize("least", [0.3, 0.6, 0.85, 1.0])
def test_similar_names(spark, monkeypatch, least):
    monkeypatch.setattr(similarity, "BROADCAST_ELEMENTS", 0 if least == 0.6 else 200_000)
    r = random.Random(3)
    words = ["order", "orders", "customer", "custmer", "item", "line", "aaaa", "x", "日本", "a b"]
    name = lambda: r.choice(["_", " ", ""]).join(r.choice(words) for _ in range(r.randint(1, 3)))
    left = [(k % 2, k, name()) for k in range(60)] + [(0, 100, None), (0, 101, ""), (1, 102, "Order")]
    right = [(k % 2, k, name()) for k in range(60)] + [(0, 100, ""), (0, 101, " "), (1, 102, "ORDER")]
    rows = similarity.similar_names(*(spark.createDataFrame(x, "s int, id long, name string") for x in (left, right)), ["s"], least).collect()
    got = {(x["s"], x["old_id"], x["new_id"]): x["similarity"] for x in rows}
    assert len(got) == len(rows)
    assert got == pytest.approx({(s, i, j): d for s, i, a in left for t, j, b in right if s == t and (d := dice(a, b)) >= least - 1e-12})


def test_one_to_one_is_greedy(spark):
    r = random.Random(4)
    pairs = [(r.randint(0, 1), r.randint(0, 15), r.randint(0, 15), r.choice([0.5, 0.7, 0.9])) for _ in range(150)] + [(2, k, k + d, 0.5 + (2 * k + d) / 100) for k in range(12) for d in (0, 1)]
    pairs = sorted({p[:3]: p for p in pairs}.values())
    expected, old, new = set(), set(), set()
    for s, a, b, score in sorted(pairs, key=lambda p: (p[0], -p[3], p[1], p[2])):
        if (s, a) not in old and (s, b) not in new:
            old.add((s, a))
            new.add((s, b))
            expected.add((s, a, b, score))
    df = spark.createDataFrame(pairs, "s int, old_id int, new_id int, score double")
    assert {tuple(x) for x in similarity.one_to_one(df, ["s"]).collect()} == expected
    assert similarity.one_to_one(df.where("false"), ["s"]).count() == 0


def test_candidates_lose_no_match(spark):
    """Matches of tables are the same whether all pairs are scored or those that share rare parts."""
    sides = [matching.tables_of(df).select("sheet", F.struct(F.col("table_id").alias("id"), "logical", "physical", "names", "comments").alias("x")) for df in registry.matching_queries.fixed_versions(spark)]
    found = [{tuple(x) for x in matching.matched(*sides, ["sheet"], matching.table_score, pairs=n).collect()} for n in (10**6, -1)]
    assert found[0] == found[1] and any("fuzzy" in x for x in found[0])


def test_blocks_of_sets_under_keys_that_are_arrays(spark, monkeypatch):
    monkeypatch.setattr(similarity, "DENSE", 10**9)
    sides = [spark.createDataFrame([(1, x) for x in names], "s int, x string").select("s", F.split("x", "").alias("key")).withColumn("grams", F.col("key")) for names in (["abc", "xyz"], ["abd", "xyz"])]
    rows = similarity.similar_sets(*sides, ["s"], 0.5).collect()
    assert {("".join(r["a"]), "".join(r["b"])): r["similarity"] for r in rows} == pytest.approx({("abc", "abd"): 2 / 3, ("xyz", "xyz"): 1})


def test_candidates_of_two_sides_of_one_table(spark, monkeypatch):
    """Equal sets under several ids, ids that are texts, and both sides from one frame; by rare elements and by blocks."""
    rows = [(1, "a", "order", None), (1, "b", "order", None), (1, "c", None, "orders"), (1, "d", None, "zz"), (2, "e", "zz", None), (2, "f", None, "zz"), (None, "g", "zz", "zz")]
    df = spark.createDataFrame(rows, "s int, id string, o string, n string")
    sides = [df.where(F.col(c).isNotNull()).select("s", F.struct("id", F.col(c).alias("name")).alias("x")) for c in "on"]
    for dense in (0, 10**9):
        monkeypatch.setattr(similarity, "DENSE", dense)
        found = similarity.candidates(*sides, ["s"], {"name": similarity.name_grams(F.col("x.name"))}, 0.5).collect()
        assert sorted(map(tuple, found)) == [(1, "a", "c"), (1, "b", "c"), (2, "e", "f")]


def test_blocks_are_shuffled_once_and_not_for_each_other_block(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 8)
    r = random.Random(5)
    rows = [[(s, k, r.choice(["", "a ", "b "]) + str(r.randint(0, 60))) for s, n in ((1, 300), (2, 5), (3, 20 * side), (None, 9)) for k in range(n)] for side in (0, 1)]
    sides = [spark.createDataFrame(x, "s int, key int, name string").select("s", "key", F.array(similarity.name_grams(F.col("name"))).alias("sets")) for x in rows]
    sc, java = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def written():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(java.double, 0), java.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(found.apply, range(found.size()))}

    before = written()
    got = {(x["s"], x["a"], x["b"]): x["score"] for x in similarity.block_scores(*sides, ["s"], [1.0]).collect()}
    assert got == pytest.approx({(s, a, b): 1.0 if x == y else dice(x, y) for s, a, x in rows[0] for t, b, y in rows[1] if s == t is not None})
    assert 600 < sum(n for k, n in written().items() if k not in before) < 6000  # 600 sets and 1,444 pairs of blocks; with a copy for each other block 22,800 sets


def test_wide_blocks_are_looked_at_in_stretches(monkeypatch):
    r = random.Random(7)
    x, y = ([r.sample(range(40), r.randint(1, 30)) for _ in range(n)] for n in (9, 5))
    for width in (1, 7, 40, 100):
        monkeypatch.setattr(similarity, "WIDTH", width)
        shared, n, m = similarity._shared(*(pa.chunked_array([pa.array([[str(e) for e in s] for s in z])]) for z in (x, y)))
        assert shared.tolist() == [[len({*a} & {*b}) for b in y] for a in x] and [*n, *m] == [*map(len, x + y)]


def test_runs_reach_over_batches():
    rows = [(1, None), (1, None), (1, "a"), (2, "a"), (2, "a"), (2, "a"), (2, "b")]
    table = pa.table({"s": [a for a, _ in rows], "t": [b for _, b in rows], "v": range(len(rows))})
    for size in (1, 2, 3, 7):
        assert [x["v"].to_pylist() for x in similarity._runs(table.to_batches(max_chunksize=size), ["s", "t"])] == [[0, 1], [2], [3, 4, 5], [6]]
