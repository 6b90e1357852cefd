"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) for every node of links (a, b); a and b are longs.

    Each step joins the links with the smallest neighbour of every node, so no neighbourhood is gathered in one place. The links of
    a step are written to the shared folder; steps end when the links are stars, that is when no node is both an end and a centre."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    for _ in range(limit):
        edges = materialize(edges, "links")
        if edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() and edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(least, large.u == least.n)
        pairs = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = pairs.filter("u <> v").distinct()
    else:
        raise RuntimeError(f"links did not settle in {limit} rounds")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
