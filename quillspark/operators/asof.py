"""As-of join: for each row the latest row of the other side with its key, up to its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400


def asof(left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str], values: list[str], bucket_seconds: int = DAY) -> DataFrame:
    """``left`` with ``values`` of the latest right row of the same key at or before its time (of equal times the greatest values), or
    nulls; ``*_on`` are (key, time). Null keys and times match nothing.

    Time is cut into buckets, so that a key with very many rows is many groups. A window within each bucket finds matches there; the
    last row of each bucket is carried on to later ones by a window over buckets alone. No pair is listed.
    """
    bucket = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / (bucket_seconds * 1_000_000))
    (lk, lt), (rk, rt) = left_on, right_on
    found = F.struct(*values)
    a = left.select(F.col(lk).alias("k"), F.col(lt).alias("t"), F.lit(1).alias("side"), F.struct(*left.columns).alias("row"))
    b = right.where(F.col(rk).isNotNull() & F.col(rt).isNotNull()).select(F.col(rk).alias("k"), F.col(rt).alias("t"), F.lit(0).alias("side"), found.alias("found"))
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("b", bucket(F.col("t")))
    lasts = rows.groupBy("k", "b").agg(F.max_by("found", F.when(F.col("side") == 0, F.struct("t", "found"))).alias("last"))
    earlier = W.partitionBy("k").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.where("k is not null and b is not null").select("k", "b", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    within = W.partitionBy("k", "b").orderBy("t", "side", "found").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("found", F.last("found", ignorenulls=True).over(within)).where("side = 1").join(carried, ["k", "b"], "left")
    known = F.col("k").isNotNull() & F.col("t").isNotNull()
    return rows.withColumn("found", F.when(known, F.coalesce("found", "carried"))).select("row.*", *(F.col(f"found.{v}").alias(v) for v in values))
