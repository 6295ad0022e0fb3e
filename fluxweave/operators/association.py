"""Association of components into sources over a hierarchy of scale features.

parents(child, parent) are hierarchy edges between features, attachments(owner, feature) say
which feature an owner lies in. Everything is a small table of records; loops run over the
number of scales or until a graph stops changing, and each round is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.operators.graph import connected_components
from fluxweave.runtime import cut


def lineages(features: DataFrame, parents: DataFrame, levels: int) -> DataFrame:
    """(feature, ancestor, depth) up each unambiguous chain, itself at depth 0; a branch on the way leaves no lineage."""
    count = parents.groupBy("child").agg(F.count_distinct("parent").alias("n"), F.min("parent").alias("parent"))
    single = count.where("n = 1").select(F.col("child").alias("ancestor"), "parent")
    branched = count.where("n > 1").select(F.col("child").alias("ancestor"))
    state = features.select("feature", F.col("feature").alias("ancestor"), F.lit(0).alias("depth"))
    every = state
    for k in range(1, levels + 1):
        state = state.join(single, "ancestor").select("feature", F.col("parent").alias("ancestor"), F.lit(k).alias("depth"))
        every = every.unionByName(state)
    every = cut(every, "lineages")
    broken = every.join(branched, "ancestor", "left_semi").select("feature").distinct()
    return every.join(broken, "feature", "left_anti")


def owner_features(attachments: DataFrame, lineage: DataFrame) -> DataFrame:
    """(owner, feature): an owner on several features attaches at their nearest common one; without any it is ambiguous and left out."""
    sized = attachments.groupBy("owner").agg(F.count_distinct("feature").alias("n"))
    reach = attachments.distinct().join(lineage, "feature").groupBy("owner", "ancestor").agg(F.count_distinct("feature").alias("k"), F.max("depth").alias("far"))
    common = reach.join(sized, "owner").where("k = n")
    return common.groupBy("owner").agg(F.min_by("ancestor", F.struct("far", "ancestor")).alias("feature"))


def hierarchy_groups(owned: DataFrame, lineage: DataFrame) -> DataFrame:
    """(owner, group): owners meet at the finest feature of their lineages that at least two of them share."""
    up = owned.join(lineage, "feature").select("owner", "ancestor", "depth")
    shared = up.groupBy("ancestor").agg(F.count_distinct("owner").alias("n")).where("n >= 2")
    return up.join(shared, "ancestor").groupBy("owner").agg(F.min_by("ancestor", F.struct("depth", "ancestor")).alias("group"))


def two_core(edges: DataFrame) -> DataFrame:
    """(node, component) of the graph's 2-core: leaves are peeled until none is left. edges(a, b)."""
    state = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "core")
    size = state.count()
    while size:
        ends = state.select(F.col("a").alias("n")).unionByName(state.select(F.col("b").alias("n")))
        inner = ends.groupBy("n").agg(F.count("*").alias("d")).where("d >= 2").select("n")
        state = cut(state.join(inner, F.col("a") == F.col("n"), "left_semi").join(inner, F.col("b") == F.col("n"), "left_semi"), "core")
        left = state.count()
        if left == size:
            break
        size = left
    return connected_components(state, "a", "b")


def isolated_pairs(edges: DataFrame) -> DataFrame:
    """Pairs of features that are each other's only neighbour."""
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = e.select(F.col("a").alias("n")).unionByName(e.select(F.col("b").alias("n"))).groupBy("n").agg(F.count("*").alias("d")).where("d = 1").select("n")
    return e.join(degree, F.col("a") == F.col("n"), "left_semi").join(degree, F.col("b") == F.col("n"), "left_semi")


def cycle_groups(owned: DataFrame, feature_edges: DataFrame) -> DataFrame:
    """(owner, group) of owners whose features lie on a common cycle-supported group or isolated pair."""
    core = two_core(feature_edges).select(F.col("node").alias("feature"), F.col("component").alias("group"))
    pairs = isolated_pairs(feature_edges)
    pair = pairs.select(F.col("a").alias("feature"), F.col("a").alias("group")).unionByName(pairs.select(F.col("b").alias("feature"), F.col("a").alias("group")))
    joined = owned.join(core.unionByName(pair), "feature").select("owner", "group").distinct()
    several = joined.groupBy("group").agg(F.count_distinct("owner").alias("n")).where("n >= 2")
    return joined.join(several, "group", "left_semi")


def missing_child_groups(owned: DataFrame, candidates: DataFrame, persistent: DataFrame) -> DataFrame:
    """Admit one missing child only: groups(group, feature) with all features but one persistent, and that one in no other group."""
    exclusive = candidates.groupBy("feature").agg(F.count_distinct("group").alias("n")).where("n = 1").select("feature")
    state = candidates.join(persistent.select("feature").distinct().withColumn("_p", F.lit(1)), "feature", "left")
    missing = state.where("_p is null")
    one = missing.groupBy("group").agg(F.count("*").alias("n"), F.min("feature").alias("feature")).where("n = 1").join(exclusive, "feature", "left_semi")
    whole = candidates.select("group").distinct().join(missing.select("group"), "group", "left_anti")
    good = one.select("group").unionByName(whole)
    return owned.join(candidates.join(good, "group", "left_semi"), "feature").select("owner", "group").distinct()


def influence_recovery(influence: DataFrame, grouped: DataFrame) -> DataFrame:
    """(owner, group): a single owner without a group within the influence of exactly one group joins it. influence(owner, group)."""
    free = influence.join(grouped.select("owner").distinct(), "owner", "left_anti").distinct()
    once = free.groupBy("owner").agg(F.count("*").alias("n"), F.min("group").alias("group")).where("n = 1").select("owner", "group")
    alone = once.groupBy("group").agg(F.count("*").alias("n")).where("n = 1").select("group")
    return once.join(alone, "group", "left_semi").select("owner", "group")


def connected_support(members: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """(support, owners): owners that share a component of persistent support, ambiguous ones left out."""
    clear = members.join(ambiguous, "owner", "left_anti")
    return clear.groupBy("support").agg(F.array_sort(F.collect_set("owner")).alias("owners")).where(F.size("owners") >= 2)


def supported_groups(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups whose owners all share one support component: geometry alone does not join. groups(owner, group), members(owner, support)."""
    spread = groups.join(members, "owner").groupBy("group", "support").agg(F.count_distinct("owner").alias("k"))
    whole = groups.groupBy("group").agg(F.count_distinct("owner").alias("n"))
    good = spread.join(whole, "group").where("k = n").select("group").distinct()
    return groups.join(good, "group", "left_semi")


def constrain_memberships(components: DataFrame, proposed: DataFrame, measured: DataFrame) -> DataFrame:
    """(component, source): only measured groups stay joined, every other component is its own source.

    proposed(component, group) is kept for the record; measured(component, group).
    """
    low = measured.groupBy("group").agg(F.min("component").alias("source"))
    named = measured.join(low, "group").groupBy("component").agg(F.min("source").alias("source"))
    out = components.select("component").distinct().join(named, "component", "left").join(proposed.withColumnRenamed("group", "proposed"), "component", "left")
    return out.select("component", F.coalesce("source", "component").alias("source"), "proposed")


def reconcile_groups(parents: DataFrame, features: DataFrame) -> DataFrame:
    """Groups of fit parents and of features, both (component, group), merged where they share a component: (component, group)."""
    both = parents.select("component", F.struct(F.lit("p").alias("k"), F.col("group").cast("string").alias("g")).alias("group")).unionByName(
        features.select("component", F.struct(F.lit("f").alias("k"), F.col("group").cast("string").alias("g")).alias("group"))
    )
    low = both.groupBy("group").agg(F.min("component").alias("low"))
    merged = connected_components(both.join(low, "group").select(F.col("component").alias("src"), F.col("low").alias("dst")))
    return merged.select(F.col("node").alias("component"), F.col("component").alias("group"))
