"""Connected components by alternating large and small stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import discard, staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v). Minima are aggregated before the shuffle; the join back is one that Spark can split."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node that links reach) for every node that has a link to another.

    Each step is written to the shared folder, so lineage stays short, and the step before deleted; only a count and a sum reach
    the driver.
    """
    edges = staged(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "edges")
    state = None
    while True:
        longer = staged(_stars(_stars(edges, True), False), "edges")
        discard(edges)
        edges = longer
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = found
