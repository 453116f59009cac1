"""Tables with versions: writers that meet, failures, rollbacks, selections."""

import threading

import pytest
from pyspark.sql import functions as F

from quillspark.operators import apply
from quillspark.shared import fresh_dir
from quillspark.sources.versioned import Refused, VersionedTable


@pytest.fixture
def table(spark):
    made = VersionedTable(spark, fresh_dir(spark, "versions"))
    made.commit(spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k long, v string"), None)
    return made


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_one_of_many_writers_wins(spark, table):
    seen, out = table.version(), []

    def write(i):
        try:
            out.append((i, table.commit(spark.createDataFrame([(i, "x")], "k long, v string"), seen).number))
        except Refused:
            out.append((i, None))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [i for i, number in out if number == 2]
    assert len(out) == 4 and len(won) == 1 and rows(table.read()) == [(won[0], "x")]
    named = {r["data"] for r in table.history().collect()}
    folders = {str(s.getPath()) for s in table.log._fs.listStatus(table.log._jvm.org.apache.hadoop.fs.Path(f"{table.folder}/data"))}
    assert {f.rpartition("/")[2] for f in folders} == {d.rpartition("/")[2] for d in named}, "refused commits leave no data"


def test_failed_apply_leaves_the_table_and_a_job_row(spark, table, monkeypatch):
    source = spark.createDataFrame([(1, "new"), (50, "more")], "k long, v string")
    plan = apply.plan_apply(table, source, ["k"])
    assert plan.counts == {"insert": 1, "update": 1, "delete": 19} and plan.blockers == [("many_deletes", "warning")] and plan.executable
    before = rows(table.read())
    monkeypatch.setattr(apply, "apply_changes", lambda *a: table.read().select("k", F.raise_error(F.lit("broken")).alias("v")))
    with pytest.raises(Exception, match="broken"):
        apply.execute_apply(table, plan, confirm_deletes=True)
    monkeypatch.undo()
    assert rows(table.read()) == before and [r["status"] for r in table.job_rows().collect()] == ["failed"]
    assert apply.execute_apply(table, plan)["status"] == "blocked"
    assert apply.execute_apply(table, plan, confirm_deletes=True)["status"] == "completed"
    assert rows(table.read()) == [(1, "new"), (50, "more")]
    assert sorted(r["status"] for r in table.job_rows().collect()) == ["blocked", "completed", "failed"]


def test_blockers_of_plans(spark, table):
    source = table.read().withColumn("v", F.lit("y"))
    for asked, code in (({"readonly": True}, "readonly_target"), ({"expired": True}, "compare_expired"), ({"compared_hash": "other"}, "target_changed")):
        plan = apply.plan_apply(table, source, ["k"], **asked)
        assert not plan.executable and apply.execute_apply(table, plan, confirm_deletes=True)["blockers"] == [code]
    empty = apply.plan_apply(table, source.unionByName(spark.createDataFrame([(None, "z")], "k long, v string")), ["k"])
    assert ("empty_key", "error") in empty.blockers
    same = apply.plan_apply(table, table.read(), ["k"])
    assert not same.executable and apply.execute_apply(table, same)["status"] == "blocked"
    assert table.version().number == 1


def test_selected_rows_must_be_there(spark, table):
    source = table.read().withColumn("v", F.lit("y"))
    with pytest.raises(apply.MissingSelection, match="77"):
        apply.plan_apply(table, source, ["k"], selection=spark.createDataFrame([(3,), (77,)], "k long"))
    plan = apply.plan_apply(table, source, ["k"], selection=spark.createDataFrame([(3,), (3,)], "k long"))
    apply.execute_apply(table, plan)
    assert [r for r in rows(table.read()) if r[1] == "y"] == [(3, "y")]


def test_vacuum_keeps_what_new_versions_name(spark, table):
    table.commit(table.read().limit(1), table.version())
    table.rollback(1)
    gone = table.vacuum(keep=1)
    assert len(gone) == 1 and table.read().count() == 20
    with pytest.raises(KeyError):
        table.version(9)
