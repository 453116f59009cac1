"""Queries of tables with versions, on two versions of orders: plans, two writers at once, job rows, rollbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import apply, diff
from quillspark.plans.diff_queries import COMPARE, KEYS, VERSIONS, versions
from quillspark.plans.registry import query
from quillspark.shared import fresh_dir
from quillspark.sources.versioned import VersionedTable


def target_table(spark, folder) -> tuple:
    """The source, and a table whose first version is the target."""
    source, target = versions(spark, folder)
    table = VersionedTable(spark, fresh_dir(spark, "versions"))
    table.commit(target, None)
    return source, table


COUNTS = "count_if(status = 'source_only') as inserts, count_if(status = 'value_changed') as updates, count_if(status = 'target_only') as deletes"


@query(VERSIONS + f"""select 'completed' as status, 1 as base_version, 2 as version, {COUNTS}, '' as blockers from cmp
union all select 'refused', 1, null, 0, 0, 0, 'target_changed' union all select 'blocked', 2, null, 0, 0, 0, 'many_deletes' from cmp having count_if(status = 'target_only') > 10""")
def apply_jobs(spark, folder):
    """Two applies planned on one version: the second is refused. A third would delete many rows and isn't confirmed."""
    source, table = target_table(spark, folder)
    plans = [apply.plan_apply(table, source, KEYS, COMPARE, table_name="orders") for _ in range(2)]
    for plan in plans:
        apply.execute_apply(table, plan, confirm_deletes=True)
    emptier = table.read().where(F.col("o_orderkey") % 2 == 0)
    apply.execute_apply(table, apply.plan_apply(table, emptier, KEYS, COMPARE, table_name="orders"))
    return table.job_rows().select("status", "base_version", "version", "inserts", "updates", "deletes", F.array_join("blockers", ",").alias("blockers"))


@query(VERSIONS + """select 2 as version, o_orderkey, case when status in ('source_only', 'value_changed') then s_status else t_status end as o_orderstatus from cmp where status <> 'target_only'
union all select 1, o_orderkey, o_orderstatus from tgt union all select 3, o_orderkey, o_orderstatus from tgt""")
def versioned_rows(spark, folder):
    """The rows of each version: as written, after an apply, and after a rollback to the first."""
    source, table = target_table(spark, folder)
    apply.execute_apply(table, apply.plan_apply(table, source, KEYS, COMPARE), confirm_deletes=True)
    table.rollback(1)
    rows = [table.read(v).select(F.lit(v).alias("version"), "o_orderkey", "o_orderstatus") for v in (1, 2, 3)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(VERSIONS + """select o_orderkey, case when o_orderkey % 3 = 0 and status in ('source_only', 'value_changed') then s_status else t_status end as o_orderstatus
from cmp where t_custkey is not null and not (status = 'target_only' and o_orderkey % 3 = 0) or status = 'source_only' and o_orderkey % 3 = 0""")
def applied_selection(spark, folder):
    """Only selected rows are applied; what isn't selected stays as the target has it."""
    source, table = target_table(spark, folder)
    picked = diff.statuses(source, table.read(), KEYS, COMPARE).where("status != 'unchanged' and o_orderkey % 3 = 0").select(*KEYS)
    apply.execute_apply(table, apply.plan_apply(table, source, KEYS, COMPARE, selection=picked, update=["o_orderstatus"]), confirm_deletes=True)
    return table.read().select("o_orderkey", "o_orderstatus")


@query(VERSIONS + "select 1 as version, 'write' as operation, count(*) as n_rows from tgt union all select 2, 'apply', count(*) from cmp where status <> 'target_only' union all select 3, 'rollback to 1', count(*) from tgt")
def version_history(spark, folder):
    source, table = target_table(spark, folder)
    apply.execute_apply(table, apply.plan_apply(table, source, KEYS, COMPARE), confirm_deletes=True)
    table.rollback(1)
    return table.history().select("version", "operation", "n_rows")
