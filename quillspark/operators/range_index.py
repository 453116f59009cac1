"""Deep pages: a table laid out in ranges of its order, with the number of rows before each.

A plain offset makes Spark gather all rows up to it in one place. Here Spark samples the order once and deals the rows to ranges
of about equal size, each a folder of its own; how many rows each range has is counted once, a row a range. A page then opens
only the ranges that it lies in, and skips at most one range's rows. A page over many ranges takes the inner ones whole, so that no
task holds more than a range.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.shared import fresh_dir

#: Rows that a range is meant to have.
RANGE_ROWS = 200_000
_PART = "_range"


class RangeIndex:
    """The rows of ``df`` in the order of ``order`` (column names; nulls first), which should be total: equal rows may else change
    places between pages. The folder is written once and never changed. There are ``ranges`` of them, or more, if they would have more
    than ``RANGE_ROWS`` rows."""

    def __init__(self, df: DataFrame, order: list[str], ranges: int | None = None, folder: str | None = None):
        self.spark, self.order = df.sparkSession, order
        self.schema = T.StructType([*df.schema.fields, T.StructField(_PART, T.IntegerType())])
        self.folder = folder or fresh_dir(self.spark, "ranges")
        ranges = max(ranges or 1, -(-df.count() // RANGE_ROWS))
        laid = df.repartitionByRange(ranges, *order).withColumn(_PART, F.spark_partition_id()).sortWithinPartitions(*order)
        laid.write.partitionBy(_PART).parquet(self.folder)
        counts = sorted(tuple(r) for r in self._table().groupBy(_PART).count().collect())  # a row a range
        self.parts = [p for p, _ in counts]
        self.before = [0, *accumulate(n for _, n in counts)]

    def _table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    @property
    def n_rows(self) -> int:
        return self.before[-1]

    def ranges_of(self, offset: int, limit: int) -> tuple[list[int], int]:
        """The ranges that hold rows ``offset`` to ``offset + limit``, and the rows before the first of them."""
        if offset >= self.n_rows or limit <= 0:
            return [], 0
        first = bisect_right(self.before, offset) - 1
        last = bisect_right(self.before, min(offset + limit, self.n_rows) - 1) - 1
        return self.parts[first : last + 1], self.before[first]

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """``limit`` rows and one more, from ``offset`` on, in order. Other ranges aren't read."""
        parts, before = self.ranges_of(offset, limit + 1)
        skipped = offset - before if parts else 0
        if len(parts) <= 2:
            rows = self._table().where(F.col(_PART).isin(parts)).orderBy(*self.order)
            return rows.offset(skipped).limit(limit + 1).drop(_PART)
        # the ends of the page are cut in their ranges; what lies between is whole
        last = self.before[self.parts.index(parts[-1])]
        head = self._table().where(F.col(_PART) == parts[0]).orderBy(*self.order).offset(skipped)
        tail = self._table().where(F.col(_PART) == parts[-1]).orderBy(*self.order).limit(offset + limit + 1 - last)
        return head.unionByName(self._table().where(F.col(_PART).isin(parts[1:-1]))).unionByName(tail).orderBy(*self.order).drop(_PART)
