"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014).

Each step rewires every node to the smallest node of its neighbourhood; the number of steps is logarithmic in practice whatever the
shape of a component. Edges are written to the shared folder after every step, and the step before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: links the larger neighbours of a node to its smallest; small: links a node and its smaller neighbours to the smallest."""
    if large:
        pairs = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) longs. (node, root): every node that has an edge, and the smallest node of its component."""
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = written(links), None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == before:
            break
        before, old = tuple(state), links
        links = written(_star(_star(links, True), False))
        discard(old)
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
