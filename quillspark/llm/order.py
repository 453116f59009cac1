"""Places and neighbours in the global order of a key, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.cluster import staged


def sorted_parts(df: DataFrame, key: str) -> tuple[DataFrame, list[tuple]]:
    """The distinct non-null keys with their range partition ``p``, kept in the shared folder, and for each partition in
    order (p, keys, first key, last key): one row a partition, which is all that reaches the driver."""
    keys = staged(df.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).distinct().repartitionByRange("k").withColumn("p", F.spark_partition_id()), "keys")
    parts = keys.groupBy("p").agg(F.count("*").alias("n"), F.min("k").alias("first"), F.max("k").alias("last")).orderBy("p").collect()
    return keys, [tuple(r) for r in parts]


def ranks(df: DataFrame, key: str) -> DataFrame:
    """k and its rank from 0 among the distinct non-null keys."""
    keys, parts = sorted_parts(df, key)
    start, rows = 0, []
    for p, n, *_ in parts:
        rows.append((p, start))
        start += n
    starts = df.sparkSession.createDataFrame(rows, "p int, start long")
    within = F.row_number().over(W.partitionBy("p").orderBy("k")) - 1
    return keys.withColumn("i", within).join(F.broadcast(starts), "p").select("k", (F.col("start") + F.col("i")).cast("long").alias("rank"))


def next_keys(df: DataFrame, key: str) -> DataFrame:
    """k and the next distinct key; the first key follows the last."""
    keys, parts = sorted_parts(df, key)
    rows = [(p, parts[(j + 1) % len(parts)][2]) for j, (p, *_) in enumerate(parts)]
    firsts = df.sparkSession.createDataFrame(rows, f"p int, follows {dict(keys.dtypes)['k']}")
    within = F.lead("k").over(W.partitionBy("p").orderBy("k"))
    return keys.withColumn("next", within).join(F.broadcast(firsts), "p").select("k", F.coalesce("next", "follows").alias("next"))
