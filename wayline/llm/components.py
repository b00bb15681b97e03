"""Connected components of a large edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns node, root (the smallest node reachable) for every node of the edges (a, b), both long.

    Each round points all neighbours of a node at its smallest neighbour, first the larger ones, then the smaller
    ones; the table turns into stars in a number of rounds that grows with the logarithm of the longest path. A
    node's neighbours are never gathered: their minimum is a pre-aggregated sum, and the join back can be split by
    adaptive execution. Self-loops, repeated edges, either direction and nulls (dropped) are allowed; no edges give
    no rows.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    pairs = lambda *rows: F.inline(F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in rows]))
    while state[0]:
        a, b, least = F.col("a"), F.col("b"), F.col("low")
        both = edges.select(pairs((a, b), (b, a)))
        low = both.groupBy("a").agg(F.least(F.min("b"), a).alias("low"))
        # Larger neighbours go to the smallest, and so does the node itself.
        moved = F.when(b > a, F.struct(b.alias("a"), least.alias("b"))).when((b == least) & (least < a), F.struct(a, b))
        edges = both.join(low, "a").select(moved.alias("e")).where("e is not null").select("e.*").where("a <> b").distinct()
        # So do the smaller ones.
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        edges = edges.join(low, "a").select(pairs((b, least), (a, least)))
        edges = cut(edges.where("a <> b").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
