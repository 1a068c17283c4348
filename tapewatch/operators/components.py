"""Connected components by alternating star contractions, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.storage import keep


def component_labels(pairs: DataFrame, max_rounds: int = 200) -> DataFrame:
    """node, label for every node in pairs (a, b); label is the smallest node of its component.

    Large-star and small-star rounds (Kiveris et al., 2014) end after about the logarithm of the
    longest path. Each minimum is a grouped aggregate joined back to the edges, so that no
    neighbourhood is ever gathered into one value. Labels that aren't final after max_rounds are an error.
    """
    edges = keep(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    for _ in range(max_rounds):
        # Done when all edges form stars: no node has two labels, and no label has one itself.
        twice = edges.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).filter("v != w").select("u")
        inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
        if not twice.unionByName(inner).limit(1).count():
            break
        # Large star: every larger neighbour of u is linked to the smallest of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # Small star: every smaller neighbour of u, and u, is linked to the smallest of them.
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = keep(small.filter("u != v").distinct())
    else:
        raise RuntimeError(f"components are not final after {max_rounds} rounds")
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    roots = labels.select(F.col("label").alias("node")).distinct()
    return labels.unionByName(roots.select("node", F.col("node").alias("label")))
