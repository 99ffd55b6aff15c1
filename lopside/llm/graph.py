"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.session import pin


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns u, v of one orderable type).

    The label is the smallest node of the component. Each round hangs the larger neighbours of every
    node on its smallest neighbour, then the smaller ones; the number of rounds grows with the
    logarithm of the longest chain. Every round is written out, only its emptiness test reaches the
    driver. A node of very many links is a hot join key on plain exchanges, which the engine splits.
    Nulls are dropped; no links give an empty table.
    """
    least, most = F.least("u", "v"), F.greatest("u", "v")
    edges = links.select(most.alias("u"), least.alias("v")).filter(F.col("u") != F.col("v")).distinct()
    edges = pin(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        low = low.select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        hung = large.join(low, "u").filter(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = pin(hung.union(low.select("u", F.col("low").alias("v"))).distinct())
        roots = edges.select(F.col("v").alias("u")).distinct()
        chained = edges.join(roots, "u", "left_semi")
        forked = edges.groupBy("u").count().filter("count > 1").select("u")
        if chained.select("u").union(forked).isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
