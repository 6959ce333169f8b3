"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (src, dst longs) to (node, root): the smallest node reachable.

    Large-star and small-star rounds: each round hands every node's larger
    neighbours to its smallest neighbour, then every node's smaller neighbours
    to the smallest of them.  The neighbours of a node are never gathered in one
    row; minima are pre-aggregated before the shuffle and each round is
    checkpointed.  Null ends are ignored; links of a node to itself yield the
    node as its own root.
    """
    nodes = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("src is not null and dst is not null")
    edges = checkpointed(nodes.distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
        large = both.join(smallest, both.u == smallest.mu).filter("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), "m")
        paired = large.join(lower, large.u == lower.mu)
        small = paired.select(F.col("v").alias("u"), F.col("m").alias("v")).union(paired.select("u", F.col("m").alias("v"))).distinct()
        edges = checkpointed(small)
        # settled when nothing changes: count and sums of the ends agree
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
