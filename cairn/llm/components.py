"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v). The minimum is combined map-side; the join back is one Spark may split."""
    if large:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "c")
    both = edges.join(least, F.col("u") == F.col("c"))
    if large:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("c != m").select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b) -> (node, label): label is the least node reachable. Only nodes with an edge appear.

    Null ends and self-loops are ignored; no edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a != b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        e = cut(_stars(_stars(e, True), False))
        now = e.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == before:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
        before = now
    raise RuntimeError("connected components did not converge")
