"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every node's larger neighbours join its least neighbour (or itself). Small: its smaller ones do, and itself."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node) for every node with an edge u-v.

    Rounds go on until the edges no longer change, which takes about
    log2(nodes) of them squared at worst; every round is written to the
    checkpoint folder, so its work is not lost with an executor. Loops and nulls
    are ignored; no edges give no rows.
    """
    edges = cut(edges.filter("u is not null and v is not null and u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen, now = None, state(edges)
    while now != seen and now[0]:
        edges = cut(_star(_star(edges, True), False))
        seen, now = now, state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
