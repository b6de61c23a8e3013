"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.session import cut_lineage, scratch_scope


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the label is the node a component shrank to.

    In each round every node points to the neighbour (or itself) that comes
    first in an order drawn anew for the round, and each edge moves to where its
    ends point.  A path or a star shrinks by a constant share a round on
    average.  Minima are combined before the shuffle; the pointers are a
    written table, so that a hot end of the edge join can be split at run time.
    """
    with scratch_scope(edges.sparkSession) as scratch:
        return _contract(edges, max_rounds, scratch)


def _contract(edges: DataFrame, max_rounds: int, scratch) -> DataFrame:
    links = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps = []
    for turn in range(max_rounds):
        if links.isEmpty():
            break
        before = links
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        point = cut_lineage(first.select(F.col("a").alias("node"), F.least("m", rank("a"))["v"].alias("to")))
        steps.append(point)
        for end in ("a", "b"):
            links = links.join(point.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end)
        moved = cut_lineage(
            links.where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        )
        scratch.drop(before)
        links = moved
    else:
        raise RuntimeError("components did not settle")
    out = steps.pop() if steps else cut_lineage(links.select(F.col("a").alias("node"), F.col("b").alias("to")))
    # a node that vanished in an earlier round follows what it pointed to
    while steps:
        earlier, later = steps.pop(), out.select(F.col("node").alias("to"), F.col("to").alias("end"))
        out = cut_lineage(earlier.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to")))
    scratch.keep(out)
    return out.select("node", F.col("to").alias("component"))
