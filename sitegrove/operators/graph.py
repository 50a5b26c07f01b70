"""Connected components by hooking, pointer jumping and contraction, in DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored as _stored


def _roots(hooks: DataFrame) -> DataFrame:
    """``hooks`` (v, m: v or a smaller vertex) with m moved to the root of its
    tree: each jump doubles the way gone, so a chain of n takes log n of them."""
    while True:
        # only a vertex that is itself hooked can move those that hang from it
        up = hooks.where("m < v").select(F.col("v").alias("m"), F.col("m").alias("up"))
        hooks = _stored(hooks.join(up, "m", "left").select("v", F.coalesce("up", "m").alias("m"), F.col("up").isNotNull().alias("moved")), "jumps")
        if hooks.where("moved").isEmpty():
            return hooks.select("v", "m")
        hooks = hooks.select("v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of ``edges`` (columns a, b of comparable ids): root
    is the least id of the component. Each round hooks every vertex to its least
    neighbour, moves it to the root of the tree so made, and contracts the edges,
    until none is left: a round at least halves the vertices, whatever the order
    of the ids. Minima are combined before the shuffle, so a vertex with very
    many neighbours is no hot spot."""
    edges = _stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while True:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        step = _roots(_stored(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m")), "hooks"))
        if found is None:
            found = step.select("v", F.col("m").alias("root"))
        else:
            moved = step.select(F.col("v").alias("root"), "m")
            found = _stored(found.join(moved, "root", "left").select("v", F.coalesce("m", "root").alias("root")), "roots")
        left, right = step.select(F.col("v").alias("a"), F.col("m").alias("ma")), step.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        edges = edges.join(left, "a").join(right, "b").where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"))
        edges = _stored(edges.distinct(), "edges")
        if edges.isEmpty():
            return found
