"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """links: columns u, v (long). Gives node, root: the least node that is reachable, for each node with a link to another.

    Each round: every node's larger neighbours are hung under its least neighbour (large star), then all its smaller
    ones (small star); rounds grow with the logarithm of the longest path. Minima are combined map-side and joined back,
    so that AQE can split the rows of a node with very many links. Each round's links are a written table.
    """
    edges = written(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = _both(edges)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large  # u > v always
        first = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(first, "u")
        both = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(first.select("u", F.col("m").alias("v")))
        after = written(both.where("u != v").distinct(), "links")
        new = _state(after)
        edges, state, old = after, new, state
        if new == old:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
