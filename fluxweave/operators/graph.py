"""Connected components over an edge DataFrame (transitive closure of a grouping)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.runtime import cut, forget


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("low"))
    return near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("low"))
    tied = down.join(low, "u")
    return tied.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
        low.select("u", F.col("low").alias("v"))
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node reachable over undirected edges.

    Alternating large and small stars; each round is two equi-joins with partial
    aggregates, and its edges are written to the shared folder, so lineage stays
    short and a lost executor costs one round. A hub's edges are pre-aggregated
    before they shuffle. Null ends are ignored; a self loop keeps its node.
    Nodes without any edge are not returned.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    pairs = cut(pairs.distinct(), "edges")
    loops = pairs.where("u = v").select("u", "v")
    state = pairs.where("u <> v")
    # The edge set repeats exactly when all edges are stars around their component's least node.
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983))
    before = last = None
    while True:
        state = cut(_small_star(_large_star(state)).where("u <> v").distinct(), "star")
        if last is not None:
            forget(last)
        last = state
        now = state.agg(mark.alias("m")).first()["m"]
        if now == before or now[0] == 0:
            break
        before = now
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component"))
    leaves = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
