"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Work


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Each node's minimum comes from a pre-aggregated groupBy
    and is joined back, so a hub with millions of neighbours is summed map-side
    and its join partition can be split."""
    if large:
        arcs = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        arcs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = arcs.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(work: Work, edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node
    of its component (the smallest node itself included).

    edges: columns a, b; loops, repeats and either direction are allowed, nulls
    are dropped.  Rounds end when a contraction leaves the edge set as it is,
    seen from its count and hash sum; only these two numbers reach the driver.
    An empty edge table gives an empty result.
    """
    now = work.cut(edges.select("a", "b").where("a <> b").distinct(), f"{name}-0")
    sign = None
    for i in range(1, most_rounds):
        nxt = work.cut(_stars(_stars(now, True), False), f"{name}-{i}")
        got = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(f"{name}-{i - 1}")
        now = nxt
        if tuple(got) == sign:
            break
        sign = tuple(got)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
