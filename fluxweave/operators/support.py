"""Scale features, ownership of support, refinement and set rules on sparse label planes.

A plane of labels is points(y, x, label). Nearest-seed joins and label distances are taken in
halo tiles, by passes along rows and then over rows (bounded by tile and radius, not by the image).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.operators import labels as lab
from fluxweave.operators.graph import connected_components
from fluxweave.operators.kernels import moving_max
from fluxweave.operators.pixels import AROUND, dilate, neighbour_count, opening
from fluxweave.operators.tiling import with_halo
from fluxweave.runtime import cut


def overlap_edges(child: DataFrame, parent: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct (child, parent) labels that share a pixel."""
    a = child.select(*by, "y", "x", F.col("label").alias("child"))
    b = parent.select(*by, "y", "x", F.col("label").alias("parent"))
    return a.join(b, [*by, "y", "x"]).select(*by, "child", "parent").distinct()


def overlap_counts(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shared pixels of each two labels."""
    left = a.select(*by, "y", "x", F.col("label").alias("a_label"))
    right = b.select(*by, "y", "x", F.col("label").alias("b_label"))
    return left.join(right, [*by, "y", "x"]).groupBy(*by, "a_label", "b_label").agg(F.count("*").alias("n_pixels"))


def seeded_regions(labelled: DataFrame, seed: Column, least: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Labelled pixels of the regions with a seed and a least size (left-semi join on the label)."""
    good = labelled.groupBy(*by, "label").agg(F.bool_or(seed).alias("s"), F.count("*").alias("n")).where(F.col("s") & (F.col("n") >= least))
    return labelled.join(good, [*by, "label"], "left_semi")


def adjacent_edges(scales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Edges between features of neighbouring scales: (scale, child, parent), child on `scale`, parent on scale + 1."""
    up = scales.select(*by, "y", "x", (F.col("scale") - 1).alias("scale"), F.col("label").alias("parent"))
    return scales.select(*by, "scale", "y", "x", F.col("label").alias("child")).join(up, [*by, "scale", "y", "x"]).select(*by, "scale", "child", "parent").distinct()


def persistent_features(scales: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pixels of features that overlap a feature of an adjacent scale."""
    edges = adjacent_edges(scales, by)
    ends = edges.select(*by, "scale", F.col("child").alias("label")).unionByName(edges.select(*by, (F.col("scale") + 1).alias("scale"), F.col("parent").alias("label"))).distinct()
    return scales.join(ends, [*by, "scale", "label"], "left_semi")


def scale_components(scales: DataFrame) -> DataFrame:
    """Features joined over adjacent-scale overlaps: (scale, label, group), group named by its first member."""
    node = lambda s, c: F.struct(s.cast("long").alias("scale"), F.col(c).alias("label"))
    edges = adjacent_edges(scales).select(node(F.col("scale"), "child").alias("src"), node(F.col("scale") + 1, "parent").alias("dst"))
    groups = connected_components(edges).select("node.scale", "node.label", F.col("component").alias("group"))
    every = scales.select(F.col("scale").cast("long"), "label").distinct()
    return every.join(groups, ["scale", "label"], "left").select("scale", "label", F.coalesce("group", F.struct("scale", "label")).alias("group"))


def representatives(features: DataFrame) -> DataFrame:
    """One feature for each group: highest S/N, then most pixels, then the finest scale, then the smallest label."""
    best = F.max_by(F.struct("scale", "label", "peak"), F.struct("peak", "n_pixels", -F.col("scale"), -F.col("label")))
    return features.groupBy("group").agg(best.alias("b")).select("group", "b.scale", "b.label", "b.peak")


def nearest_in_tile(seed_y: np.ndarray, seed_x: np.ndarray, label: np.ndarray, y: np.ndarray, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pixel the label of the nearest seed within a bound on rows and columns, and its squared distance; ties to the smaller label.

    Along each row the nearest seed on either side, then over the rows within reach: exact,
    as among seeds of one row the nearer one is nearer from everywhere.
    """
    y0, x0 = min(seed_y.min(), y.min()) - reach, min(seed_x.min(), x.min())
    h, w = int(max(seed_y.max(), y.max()) - y0) + reach + 1, int(max(seed_x.max(), x.max()) - x0) + 1
    names, rank = np.unique(label, return_inverse=True)
    far, bits = np.int64(1) << 62, np.int64(32)
    plane = np.full((h, w), len(names), np.int64)
    np.minimum.at(plane, (seed_y - y0, seed_x - x0), rank)
    cols = np.arange(w)
    there = plane < len(names)
    left = np.maximum.accumulate(np.where(there, cols, -1), axis=1)
    right = np.minimum.accumulate(np.where(there, cols, w)[:, ::-1], axis=1)[:, ::-1]
    rows = np.arange(h)[:, None]

    def key(at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Squared distance along the row, then rank."""
        d = cols - at
        return np.where(known, (d * d << bits) + plane[rows, np.clip(at, 0, w - 1)], far)

    best_row = np.minimum(key(left, left >= 0), key(right, right < w))
    at = y - y0, x - x0
    best = np.full(len(y), far)
    for dy in range(-reach, reach + 1):
        np.minimum(best, best_row[at[0] + dy, at[1]] + (np.int64(dy * dy) << bits), out=best)
    d2 = best >> bits
    return names[np.minimum(best & ((1 << bits) - 1), len(names) - 1)], d2


def nearest_seed(seeds: DataFrame, support: DataFrame, radius: float, by: Sequence[str] = (), core: int = 256) -> DataFrame:
    """Support pixels with the label of the nearest seed pixel within a radius: label, d2.

    Ties go to the seed label whose first pixel comes first (its label, for first-pixel
    labels). Seeds go to the tiles whose halo holds them, so a seed is copied to four tiles
    at most as long as the radius is under a tile's size, whatever the disc's area.
    """
    keys = [*by, "y", "x"]
    core = max(core, int(radius) + 1)
    place = [*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")]
    given = with_halo(seeds.select(*place, F.col("label").cast("long").alias("label")), core, int(radius))
    asked = support.select(*place, F.lit(None).cast("long").alias("label")).withColumn("tile_y", F.floor(F.col("y") / core)).withColumn("tile_x", F.floor(F.col("x") / core))

    def run(table: pa.Table) -> pa.Table:
        is_seed = pc.is_valid(table.column("label"))
        known, wanted = table.filter(is_seed), table.filter(pc.invert(is_seed)).select(keys)
        if not len(known) or not len(wanted):
            return wanted.slice(0, 0).append_column("label", pa.array([], pa.int64())).append_column("d2", pa.array([], pa.int64()))
        sy, sx, label = (known.column(c).to_numpy() for c in ("y", "x", "label"))
        label, d2 = nearest_in_tile(sy, sx, label, wanted.column("y").to_numpy(), wanted.column("x").to_numpy(), int(radius))
        out = wanted.append_column("label", pa.array(label)).append_column("d2", pa.array(d2))
        return out.filter(pa.array(d2 <= radius * radius))

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in seeds.schema.fields if f.name in by)
    best = given.unionByName(asked).groupBy(*by, "tile_y", "tile_x").applyInArrow(run, f"{types}y long, x long, label long, d2 long")
    rest = [c for c in support.columns if c not in (*keys, "label")]
    return support.select(*keys, *rest).join(best, keys) if rest else best


def aperture(seeds: DataFrame, valid: DataFrame, radius: float, by: Sequence[str] = ()) -> DataFrame:
    """Non-overlapping apertures: valid pixels within a radius of a label, to the nearest label."""
    return nearest_seed(seeds, valid.select(*by, "y", "x"), radius, by)


def geodesic(seeds: DataFrame, support: DataFrame, reach: float, by: Sequence[str] = ()) -> DataFrame:
    """Support pixels joined to the seed of the shortest 8-connected path in the support, up to a length.

    Steps cost 1 and sqrt 2; lengths equal to 1e-9 go to the smaller label. A bounded number
    of relaxation joins (the integer part of the reach), each cut.
    """
    keys = [*by, "y", "x"]
    state = front = seeds.select(*keys, "label", F.lit(0.0).alias("dist"), F.lit(0).alias("fresh"))
    for _ in range(int(reach)):
        step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1.0 if 0 in (dy, dx) else 2**0.5).alias("c")) for dy, dx in AROUND]))
        offers = front.select(*by, "y", "x", "label", "dist", step.alias("s")).select(
            *by, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "label", (F.col("dist") + F.col("s.c")).alias("dist"), F.lit(1).alias("fresh")
        )
        offers = offers.where(F.col("dist") <= reach + 1e-9).join(support.select(*keys), keys)
        # What was there before stays for equal lengths and labels; only pixels that changed make offers.
        best = F.min(F.struct(F.round("dist", 9).alias("d"), "label", "fresh", "dist")).alias("b")
        merged = state.withColumn("fresh", F.lit(0)).unionByName(offers).groupBy(*keys).agg(best)
        state = cut(merged.select(*keys, F.col("b.label").alias("label"), F.col("b.dist").alias("dist"), F.col("b.fresh").alias("fresh")), "geodesic")
        front = state.where("fresh = 1")
    return state.drop("fresh").join(seeds.select(*keys), keys, "left_anti")


def published_owner(support: DataFrame, measured: DataFrame, flood: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Owner of each support pixel: its flood's inside; outside the measurement owner if it touches that owner's flood."""
    keys = [*by, "y", "x"]
    inside = support.select(*keys).join(flood.select(*keys, F.col("label").alias("_f")), keys, "left").join(measured.select(*keys, F.col("label").alias("_m")), keys, "left")
    near = dilate(flood, [*AROUND, (0, 0)], by, ["label"]).withColumnRenamed("label", "_m").withColumn("_t", F.lit(True))
    out = inside.join(near, [*keys, "_m"], "left")
    return out.select(*keys, F.coalesce("_f", F.when(F.col("_t"), F.col("_m"))).alias("label")).where("label is not null")


def refined_support(labelled: DataFrame, recovered: DataFrame, radius: float, core: int = 5, boundary: float = 6.0, by: Sequence[str] = ()) -> DataFrame:
    """Refine support(y, x, label, snr): dense core, strong boundary, and recovered pixels near the opened support.

    Dense: opened and at least `core` opened pixels in 3 x 3. Strong: S/N at or over the
    boundary. Recovered: significant multiscale pixels within an L1 ball of the opened
    support; one outside any label takes the nearest opened label.
    """
    keys = [*by, "y", "x"]
    opened = cut(opening(labelled, by), "opened")
    dense = neighbour_count(opened, by).where(F.col("n_near") >= core).select(*keys, "label")
    strong = labelled.where(F.col("snr") >= boundary).select(*keys, "label")
    r = int(radius)
    ball = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dy) + abs(dx) <= r]
    near = recovered.select(*keys).join(dilate(opened, ball, by), keys, "left_semi")
    owned = near.join(labelled.select(*keys, "label"), keys)
    fresh = nearest_seed(opened.select(*keys, "label"), near.join(labelled.select(*keys), keys, "left_anti"), radius, by).select(*keys, "label")
    return dense.unionByName(strong).unionByName(owned.select(*keys, "label")).unionByName(fresh).distinct()


def owner_parts(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each owner's 8-connected parts: points with `part` (its first pixel within the owner)."""
    named = labelled.withColumnRenamed("label", "owner")
    return named.join(lab.label_regions(named.select(*by, "owner", "y", "x"), by=[*by, "owner"]).withColumnRenamed("label", "part"), [*by, "owner", "y", "x"]).withColumnRenamed("owner", "label")


def owners_to_restore(original: DataFrame, refined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Owners whose refined support has no part or more than one."""
    parts = owner_parts(refined.select(*by, "y", "x", "label"), by).groupBy(*by, "label").agg(F.count_distinct("part").alias("n"))
    owners = original.select(*by, "label").distinct()
    return owners.join(parts, [*by, "label"], "left").where("coalesce(n, 0) <> 1").select(*by, "label")


def restore(original: DataFrame, refined: DataFrame, owners: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The original support of the restored owners and the refined support of all others."""
    keys = [*by, "label"]
    cols = [*by, "y", "x", "label"]
    return refined.join(owners, keys, "left_anti").select(*cols).unionByName(original.join(owners, keys, "left_semi").select(*cols)).dropDuplicates([*by, "y", "x"])


def bridges(previous: DataFrame, retained: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Removed regions of an owner that touch at least two of its retained parts: they are kept."""
    keys = [*by, "label", "y", "x"]
    removed = previous.select(*keys).join(retained.select(*keys), keys, "left_anti")
    regions = owner_parts(removed, by).select(*keys, F.col("part").alias("region"))
    parts = owner_parts(retained.select(*keys), by).select(*keys, "part")
    moved = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in AROUND]))
    reach = regions.select(*by, "label", "region", "y", "x", moved.alias("d")).select(*by, "label", "region", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    kept = reach.join(parts, keys).groupBy(*by, "label", "region").agg(F.count_distinct("part").alias("n")).where("n >= 2")
    return regions.join(kept, [*by, "label", "region"], "left_semi").select(*keys)


def owner_islands(pairs: DataFrame) -> DataFrame:
    """Owner -> sorted identifiers of the islands it reaches: pairs(owner, island_id)."""
    return pairs.groupBy("owner").agg(F.array_sort(F.collect_set("island_id")).alias("island_ids"))


def component_islands(own: DataFrame, parents: DataFrame, parent_islands: DataFrame) -> DataFrame:
    """A component's own islands, else its parent's: own(component, islands), parents(component, parent), parent_islands(parent, islands)."""
    return (
        parents.join(own.withColumnRenamed("islands", "_own"), "component", "left")
        .join(parent_islands.withColumnRenamed("islands", "_up"), "parent", "left")
        .select("component", F.coalesce("_own", "_up", F.array().cast("array<string>")).alias("islands"))
    )


def labels_within(owners: DataFrame, distance: int, by: Sequence[str] = (), core: int = 256) -> DataFrame:
    """Distinct pairs (a_label < b_label) with pixels at most so many rows and columns apart, found in halo tiles."""
    core = max(core, distance + 1)
    dealt = with_halo(owners.select(*by, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("label").cast("long").alias("label")), core, distance)

    def run(table: pa.Table) -> pa.Table:
        y, x, label = (table.column(c).to_numpy() for c in ("y", "x", "label"))
        pairs = set()
        if len(names := np.unique(label)) > 1:
            y0, x0 = y.min(), x.min()
            plane = np.zeros((int(y.max() - y0) + 1, int(x.max() - x0) + 1), np.int64)
            plane[y - y0, x - x0] = np.searchsorted(names, label) + 1
            order = np.argsort(label, kind="stable")
            edges = np.append(np.searchsorted(label[order], names), len(label))
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True), 1):
                mine = order[a:b]
                top, left = max(0, int(y[mine].min() - y0) - distance), max(0, int(x[mine].min() - x0) - distance)
                window = plane[top : int(y[mine].max() - y0) + distance + 1, left : int(x[mine].max() - x0) + distance + 1]
                near = moving_max((window == k).astype(float), distance, distance) > 0
                pairs |= {(k, int(other)) for other in np.unique(window[near]) if other > k}
        found = sorted(pairs)
        out = {b: pa.array([table.column(b)[0].as_py()] * len(found), table.schema.field(b).type) for b in by}
        return pa.table(out | {"a_label": pa.array([int(names[a - 1]) for a, _ in found], pa.int64()), "b_label": pa.array([int(names[b - 1]) for _, b in found], pa.int64())})

    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in owners.schema.fields if f.name in by)
    return dealt.groupBy(*by, "tile_y", "tile_x").applyInArrow(run, f"{types}a_label long, b_label long").distinct()


def fit_parents(owners: DataFrame, margin: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """Owners whose supports grown by a margin touch share a parent: (label, parent), parent the smallest label."""
    pairs = labels_within(owners, 2 * margin + 1, by)
    groups = connected_components(pairs.select(F.col("a_label").alias("src"), F.col("b_label").alias("dst")))
    return owners.select("label").distinct().join(groups.withColumnRenamed("node", "label"), "label", "left").select("label", F.coalesce("component", "label").alias("parent"))


def merge_label_groups(groups: DataFrame) -> DataFrame:
    """Groups (group, label) that share a label merge transitively: (label, merged)."""
    first = groups.groupBy("group").agg(F.min("label").alias("low"))
    edges = groups.join(first, "group").select(F.col("label").alias("src"), F.col("low").alias("dst"))
    return connected_components(edges).select(F.col("node").alias("label"), F.col("component").alias("merged"))


def running_offset(counts: DataFrame, order: str) -> DataFrame:
    """First number of each parent's components: a running sum over one row for each parent."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n_components").over(w), F.lit(0)).cast("long"))
