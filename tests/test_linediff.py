"""Shortest scripts, anchors of long texts, and odd texts."""

import random

from pyspark.sql import functions as F

from quillspark.operators import linediff


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_scripts_are_shortest():
    r = random.Random(1)
    for _ in range(1500):
        a, b = ([r.randrange(r.choice([2, 4, 9])) for _ in range(r.randint(0, 14))] for _ in range(2))
        kept = linediff.kept_pairs(a, b)
        assert all(a[i] == b[j] for i, j in kept) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(kept, kept[1:]))
        assert len(kept) == lcs(a, b)


def test_diffs_rebuild_both_texts(spark):
    r = random.Random(2)
    pairs = [(1, None, ""), (2, "a\nb\n", "a\nb"), (3, "a\r\nb", "b\nc"), (4, "", "x"), (5, "same\n" * 50, "same\n" * 49 + "other")]
    for k in range(40):
        a = [f"line {r.randrange(30)}" for _ in range(r.randint(1, 60))]
        b = [x for x in a if r.random() > 0.2] + [f"line {r.randrange(30)}" for _ in range(3)]
        pairs.append((10 + k, "\n".join(a), "\n".join(b)))
    df = spark.createDataFrame(pairs, "id long, old_text string, new_text string").repartition(4)
    for whole in (10_000, 5):
        found = {}
        for x in linediff.line_diff(df, whole=whole).collect():
            found.setdefault(x["id"], []).append(x)
        for i, a, b in pairs:
            a, b = ([*t.replace("\r\n", "\n").removesuffix("\n").split("\n")] if t else [] for t in (a, b))
            rows = sorted(found.get(i, []), key=lambda x: x["place"])
            assert [x["place"] for x in rows] == list(range(len(rows)))
            assert [(x["old_line"], x["content"]) for x in rows if x["type"] != "added"] == list(enumerate(a, 1))
            assert [(x["new_line"], x["content"]) for x in rows if x["type"] != "removed"] == list(enumerate(b, 1))
            stay = sum(x["type"] == "unchanged" for x in rows)
            assert stay == lcs(a, b) if whole > 5 else stay <= lcs(a, b)


def test_only_one_line_feed_ends_a_text(spark):
    """A text's last line feed goes, blank lines before it and other separators stay."""
    texts = ["a\n\n", "\n", "", None, "a\r\r", "a\n ", "\n\n\n", "a\r\n\r\nb"]
    expected = [["a", ""], [""], [], [], ["a", ""], ["a", " "], ["", "", ""], ["a", "", "b"]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").orderBy("id").select(linediff.lines_of(F.col("t"))).collect()
    assert [r[0] for r in rows] == expected == [linediff.split_lines(t) for t in texts]


def test_short_texts_are_compared_in_one_pass(spark):
    """Their lines aren't shuffled, and a text is made once to be compared."""
    df = spark.range(50).select("id", F.concat(F.lit("a\nb\n"), "id").alias("old_text"), F.concat(F.lit("a\nc\n"), "id").alias("new_text"))
    diff = linediff.line_diff(df)
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    assert diff.count() == 200


def test_long_and_short_texts_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(linediff, "BATCH", 3)
    texts = [(i, "\n".join(f"{i} {j}" for j in range(n)), "\n".join(f"{i} {j}" for j in range(n) if j % 4)) for i, n in enumerate([3, 40, 5, 41, 0])]
    rows = linediff.line_diff(spark.createDataFrame(texts, "id int, old_text string, new_text string"), whole=9).collect()
    for i, a, b in texts:
        own = sorted((x for x in rows if x["id"] == i), key=lambda x: x["place"])
        assert [x["place"] for x in own] == list(range(len(own)))
        assert "\n".join(x["content"] for x in own if x["type"] != "added") == a and "\n".join(x["content"] for x in own if x["type"] != "removed") == b
