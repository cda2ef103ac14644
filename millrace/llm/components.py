"""Connected components by alternating large-star and small-star, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_to_groups, saved


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges with m, the least neighbour of u, or u itself. Hubs are few: theirs are broadcast, and their edges stay spread."""
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("size"))
    return joined_to_groups(edges, least, ["u"], "size", F.col("v"), total)


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Joins each node's larger neighbours to its least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """Joins each node and its smaller neighbours to the least of those. Edges have u > v."""
    own = edges.groupBy("u").agg(F.min("v").alias("v"))
    rest = _with_least(edges, total).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest)


def connected_components(links: DataFrame) -> DataFrame:
    """u and v, the least node of its component, for each node of links (u, v) but the least ones themselves. Edges of
    nodes with themselves and repeated edges do no harm; nulls are dropped; no links give no rows. A hub's neighbours
    are never brought together: only their minimum is."""
    edges = saved(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last, total = None, edges.count()
    while True:
        # the same stars are written between the two, so that neither is computed twice
        edges = saved(small_star(saved(large_star(edges, total)), total).filter("u <> v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return edges
        last, total = now, now[0]
