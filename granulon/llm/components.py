"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulon.llm.common import cut

#: Far above what is needed: the number of rounds grows with the logarithm of the longest path.
MAX_ROUNDS = 60


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has a link to another one; root is the smallest node reachable.

    Each round links every node to the smallest of its neighbours, first its larger neighbours (large
    star), then its smaller ones (small star), until nothing changes. A node's neighbours are never
    gathered: the smallest one is an aggregate that is combined before the shuffle, and a hub's links
    are joined to it row by row, so that a skewed join can be split. Null ends, loops and repeated
    links add nothing; without links the result is empty.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut(edges.distinct())
    before = _sum(edges)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        edges = cut(_small_star(_large_star(edges)))
        after = _sum(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    least = edges.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("u").alias("m")), F.struct(F.col("u").alias("x"), F.col("u").alias("m")))).alias("e"))
    least = least.groupBy("e.x").agg(F.min("e.m").alias("m"))
    return edges.withColumnRenamed("u", "x").join(least, "x").select("v", F.col("m").alias("u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    joined = edges.join(least, "v")
    pairs = joined.select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
    return pairs.select("e.v", "e.u").where("v != u").distinct()
