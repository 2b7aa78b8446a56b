"""Graphs as tables of links within groups: components, and the ordered choice of links' ends, by rounds of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulon.session import cut

#: Rounds of components grow with the logarithm of the longest path, so these are never reached.
MAX_ROUNDS = 60


def _both(edges: DataFrame, a: str, b: str, x: str, y: str) -> DataFrame:
    """Each link in both directions, as x and y."""
    ends = lambda p, q: F.struct(F.col(p).alias(x), F.col(q).alias(y))
    rest = [n for n in edges.columns if n not in (a, b)]
    return edges.select(*rest, F.explode(F.array(ends(a, b), ends(b, a))).alias("_e")).select(*rest, f"_e.{x}", f"_e.{y}")


def components(edges: DataFrame, group: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """(group..., node, root) of each node with a link; root is the smallest node that can be reached within the group.

    In each round every node's larger neighbours are linked to the smallest node around it, then its smaller
    ones; the smallest is an aggregate, so no node's links are gathered. Null ends and loops add nothing.
    """
    now = edges.select(*group, F.greatest(a, b).alias("_v"), F.least(a, b).alias("_u")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(now.distinct())
    seen = _print(now, group)
    for _ in range(MAX_ROUNDS):
        now = cut(_round(_round(now, group), group))
        before, seen = seen, _print(now, group)
        if seen == before:
            roots = now.select(*group, "_u").distinct()
            return now.select(*group, F.col("_v").alias("node"), F.col("_u").alias("root")).unionByName(roots.select(*group, F.col("_u").alias("node"), F.col("_u").alias("root")))
    raise RuntimeError("components did not settle")


def _round(now: DataFrame, group: Sequence[str]) -> DataFrame:
    """Links (v, u), v > u, after the larger neighbours of every node are linked to the smallest around it, then the smaller ones."""
    around = _both(now, "_v", "_u", "_x", "_y").groupBy(*group, "_x").agg(F.min("_y").alias("_m")).withColumn("_m", F.least("_x", "_m"))
    large = now.withColumnRenamed("_u", "_x").join(around, [*group, "_x"]).select(*group, "_v", F.col("_m").alias("_u"))
    # The smallest neighbour of a node is linked to it by the aggregate; the others are linked to that one.
    least = large.groupBy(*group, "_v").agg(F.min("_u").alias("_m"))
    small = large.join(least, [*group, "_v"]).where("_u <> _m").select(*group, F.col("_u").alias("_v"), F.col("_m").alias("_u"))
    return least.withColumnRenamed("_m", "_u").unionByName(small).distinct()


def _print(edges: DataFrame, group: Sequence[str]) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64(*group, "_v", "_u").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def kept_in_order(nodes: DataFrame, edges: DataFrame, group: str, node: str, rank: Column, a: str = "a", b: str = "b") -> DataFrame:
    """(group, node) of the nodes that stay if each, by falling rank and then rising id, drops its neighbours after it.

    The same choice as one after the other: in each round the nodes that come before all of their open neighbours stay, and
    these neighbours go. Links end with either, so a round has fewer of them; there are as many rounds as the longest chain of
    neighbours that come one after the other has pairs. Nodes without links stay and never enter a round. Null ranks come last.
    """
    names = nodes.select(group, node)
    # Few nodes have links: only their places are joined to these, and all nodes stream past them unsorted.
    links = cut(edges.select(group, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    ends = links.select(group, F.explode(F.array(a, b)).alias("_n")).distinct()
    ranked = nodes.select(group, F.col(node).alias("_n"), rank.alias("_r")).join(ends.hint("shuffle_hash"), [group, "_n"], "left_semi")
    place = cut(ranked.select(group, "_n", F.struct(F.col("_r").isNull().alias("o"), (-F.col("_r")).alias("r"), F.col("_n").alias("i")).alias("_p")))
    at = lambda df, end, name: df.join(place.withColumnsRenamed({"_n": end, "_p": name}), [group, end])
    open_ = cut(at(at(links, a, "pa"), b, "pb").select(group, F.least("pa", "pb").alias("first"), F.greatest("pa", "pb").alias("last")).distinct())
    dropped = None
    while not open_.isEmpty():
        # Before all open neighbours: first of some links and last of none.
        firsts = open_.select(group, F.col("first").alias("p")).distinct().join(open_.select(group, F.col("last").alias("p")).distinct(), [group, "p"], "left_anti")
        gone = open_.join(firsts.withColumnRenamed("p", "first"), [group, "first"], "left_semi").select(group, F.col("last").alias("p")).distinct()
        gone = cut(gone)
        dropped = gone if dropped is None else dropped.unionByName(gone)
        rest = open_.join(gone.withColumnRenamed("p", "first"), [group, "first"], "left_anti").join(gone.withColumnRenamed("p", "last"), [group, "last"], "left_anti")
        open_ = cut(rest)
    if dropped is None:
        return names
    return names.join(dropped.select(group, F.col("p.i").alias(node)).hint("shuffle_hash"), [group, node], "left_anti")
