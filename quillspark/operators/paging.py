"""Pages, windows of rows and lists of the newest or most frequent entries. All of them take a total order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.shared import settled

DEFAULT_LIMIT, EXPORT_CAP, RETAINED_ROWS = 1_000, 100_000, 5_000


@dataclass
class QueryBatch:
    """One page: its rows, if there are more, and where the next page starts."""

    rows: list
    has_more: bool
    next_offset: int | None


def page_frame(df: DataFrame, order: list[str | Column], limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """``limit`` rows and one more, from ``offset`` on."""
    return df.orderBy(*order).offset(offset).limit(limit + 1)


def fetch_page(df: DataFrame, order: list[str | Column], limit: int = DEFAULT_LIMIT, offset: int = 0) -> QueryBatch:
    rows = page_frame(df, order, limit, offset).collect()
    more = len(rows) > limit
    return QueryBatch(rows[:limit], more, offset + limit if more else None)


def newest(df: DataFrame, order: list[str], keep: int = RETAINED_ROWS, protected: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """The last ``keep`` rows in the order, and all protected rows (by key). A top-k, so no task sorts all rows."""
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(keep)
    if protected is None:
        return last
    held = df.join(protected.select(*keys).distinct(), keys, "left_semi").join(last.select(*keys), keys, "left_anti")
    return last.unionByName(held)


def newest_jobs(jobs: DataFrame, at: str, tie: str, limit: int = 25) -> DataFrame:
    """The latest jobs, between 1 and 100 of them."""
    return jobs.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(min(max(limit, 1), 100))


def export_rows(df: DataFrame, order: list[str], cap: int = EXPORT_CAP) -> tuple[DataFrame, bool]:
    """The rows of a full export, in order, and if they were cut at the cap. The rows are settled, so the query runs once."""
    rows = settled(df.orderBy(*order).limit(cap + 1), "export")
    cut = rows.count() > cap
    return rows.orderBy(*order).limit(cap), cut


def numbered_versions(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``df`` with version_number and version_count within each name."""
    by = W.partitionBy(name)
    return df.withColumns({"version_number": F.row_number().over(by.orderBy(*order)), "version_count": F.count("*").over(by)})
