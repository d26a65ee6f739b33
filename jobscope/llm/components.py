"""Connected components by alternating large-star and small-star steps, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import stored


#: Edges for each partition: graphs of links are small against the documents and are kept in few partitions.
PARTITION_EDGES, LEAST_PARTITIONS = 250_000, 8


def _spread(edges: DataFrame, larger: bool, parts: int) -> DataFrame:
    """One star step. The minima are stored, so the join sees two plain inputs and Spark can split a hub's rows."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")).coalesce(parts))
        out = both.filter("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        lows = stored(edges.groupBy("u").agg(F.min("v").alias("low")).coalesce(parts))
        out = edges.join(lows, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(lows.select("u", F.col("low").alias("v")))
    return out.filter("u > v").coalesce(parts).distinct().coalesce(parts)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def component_roots(edges: DataFrame) -> DataFrame:
    """u, v: each node of ``edges`` (u, v; u > v, stored) but the roots, with the smallest node of its component."""
    now, before = _state(edges), None
    while now[0] and now != before:
        before = now
        parts = max(LEAST_PARTITIONS, 2 * now[0] // PARTITION_EDGES)
        edges = stored(_spread(stored(_spread(edges, True, parts)), False, parts))
        now = _state(edges)
    return edges
