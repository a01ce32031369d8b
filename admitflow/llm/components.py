"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitflow.session import cut

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``: root is the smallest node that it reaches.

    Every round hangs each node's larger neighbours on its smallest one, then its
    smaller neighbours; rounds grow with the logarithm of the longest path. No
    neighbour list is gathered: a node's smallest neighbour is a grouped minimum,
    joined back, so a node with very many links is spread by the skewed join.
    Links with a null end, and links of a node to itself, say nothing and go.
    """
    links = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every neighbour above the node moves to the node's least
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: every neighbour below the node, and the node, move to the least
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m")).where("u > v").distinct()
        links = cut(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
