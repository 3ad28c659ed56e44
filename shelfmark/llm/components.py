"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``; the component is its smallest node.

    Alternating stars: each round links every node's larger neighbours, and then its smaller ones,
    to its smallest neighbour, until the links are stars. Every step is a minimum per node and a
    join, so a node with very many links is combined before the shuffle and its join can be split.
    Each round is written to the shared folder, so its lineage is one round long.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "smallest")
        large = stored(
            both.filter("b > a").join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "large",
        )
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
