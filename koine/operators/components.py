"""Distributed connected components over an edge table.

Alternating large-star / small-star rounds (Kiveris et al., SoCC 2014), each a
shuffle on the node with a map-side partial ``min``.  No adjacency list is ever
collected into one task: a hub with millions of neighbours only contributes
``min`` aggregates and rows of an equi-join.  Few minima (at most ``FILE_EDGES``
edges have them) are broadcast to the edges, which then are not dealt by node at
all; many are a table before that join, so that both its sides are plain
shuffles and adaptive execution splits a hub's rows over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from koine.sources.scratch import checkpointed, shuffled, written

MAX_ROUNDS = 100
#: Edges up to which a round is one small job and one file, and edges in a file beyond.
FILE_EDGES = 100_000


def _minima(low: DataFrame, many: bool) -> DataFrame:
    return shuffled(written(low, "minima")) if many else F.broadcast(low)


def _large_star(e: DataFrame, many: bool) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _minima(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), many)
    out = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(e: DataFrame, many: bool) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = _minima(low, many)
    linked = down.join(kept, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName((kept if many else low).select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _state(e: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether each leads from a node with no other edge to a root."""
    ends = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(e.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    got = each.agg(F.sum("up").alias("n"), F.count_if(F.expr("up > 1 or up = 1 and down = 1")).alias("open")).first()
    return got["n"] or 0, not got["open"]


def on_driver(edges: list[tuple]) -> list[tuple]:
    """``(node, root)`` of a short list of edges."""
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in list(up)]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge with ``root`` the smallest node
    of its component; the root itself is listed too.

    Null ends and self loops are ignored, repeated edges count once, an empty
    edge table gives an empty result.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = checkpointed(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        n, settled = _state(e)
        if settled:
            break
        many = n > FILE_EDGES
        large = _large_star(e, many)
        small = _small_star(checkpointed(large) if many else large, many)
        e = checkpointed(small.coalesce(max(1, -(-n // FILE_EDGES))))
    else:
        raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
