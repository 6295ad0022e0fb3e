"""8-connected regions of a mask, their summaries, numbering and relabelling.

A region is labelled inside each tile first (NumPy, one grouped pass); only pixels at tile
seams become edges, and the distributed components of those small edges give the global
label. So the number of join rounds follows the number of tiles a region crosses, not
its diameter in pixels. A label is the raster-first pixel of the region.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.operators import kernels
from fluxweave.operators.graph import connected_components
from fluxweave.operators.pixels import AROUND, neighbour_pairs

TILE = 256


def pixel_id(y: Column, x: Column) -> Column:
    """Row-major id; the smallest of a region is its first pixel."""
    return y.cast("long") * int(kernels.STRIDE) + x.cast("long")


def tile_labels(mask: DataFrame, core: int = TILE, by: Sequence[str] = ()) -> DataFrame:
    """mask(y, x) with `local`, the first pixel of the region within the tile."""
    keys = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in mask.schema.fields if f.name in by] + ["y long", "x long", "local long"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*by, "y", "x"]].copy()
        out["local"] = kernels.label_points(pdf["y"].to_numpy("int64"), pdf["x"].to_numpy("int64"))
        return out

    tiles = mask.select(*by, F.col("y").cast("long"), F.col("x").cast("long"), F.floor(F.col("y") / core).alias("_ty"), F.floor(F.col("x") / core).alias("_tx"))
    return tiles.groupBy(*by, "_ty", "_tx").applyInPandas(run, keys)


def seam_pairs(local: DataFrame, core: int = TILE, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of tile regions that touch across a seam or corner: right, below and both diagonals."""
    near = F.pmod("y", F.lit(core)).isin(0, core - 1) | F.pmod("x", F.lit(core)).isin(0, core - 1)
    pairs = neighbour_pairs(local.where(near), ["local"], by=by)
    return pairs.where("a_local <> b_local").select(*by, "a_local", "b_local").distinct()


def label_regions(mask: DataFrame, core: int = TILE, by: Sequence[str] = ()) -> DataFrame:
    """mask(y, x) with `label`, the first pixel id of its 8-connected region."""
    local = tile_labels(mask, core, by)
    pairs = seam_pairs(local, core, by)
    if by:
        named = lambda c: F.struct(*by, F.col(c).alias("id"))
        roots = connected_components(pairs.select(named("a_local").alias("src"), named("b_local").alias("dst")))
        roots = roots.select(*[F.col(f"node.{b}").alias(b) for b in by], F.col("node.id").alias("local"), F.col("component.id").alias("label"))
    else:
        roots = connected_components(pairs.select(F.col("a_local").alias("src"), F.col("b_local").alias("dst")))
        roots = roots.select(F.col("node").alias("local"), F.col("component").alias("label"))
    return relabel(local, roots, "local", by)


def relabel(labelled: DataFrame, mapping: DataFrame, key: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Map a label through (key, label); labels without an entry stay. AQE broadcasts a small map."""
    return labelled.join(mapping.withColumnRenamed("label", "_new"), [*by, key], "left").select(
        *by, *[c for c in labelled.columns if c not in by and c != key], F.coalesce("_new", F.col(key)).alias("label")
    )


def summarize(labelled: DataFrame, seed: Column, by: Sequence[str] = ()) -> DataFrame:
    """Per label: size, bounds, highest S/N with its raster-first pixel, first pixel, whether it has a seed."""
    return labelled.groupBy(*by, "label").agg(
        F.count("*").alias("n_pixels"),
        F.min("y").alias("y0"),
        (F.max("y") + 1).alias("y1"),
        F.min("x").alias("x0"),
        (F.max("x") + 1).alias("x1"),
        F.max("snr").alias("peak"),
        F.max_by(F.struct("y", "x"), F.struct(F.col("snr"), -F.col("y"), -F.col("x"))).alias("peak_at"),
        F.min(F.struct("y", "x")).alias("first_at"),
        F.bool_or(seed).alias("seeded"),
    )


def cut_regions(summaries: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Regions with a seed and a size within both bounds, taken after the global merge."""
    kept = summaries.where(F.col("seeded") & (F.col("n_pixels") >= least))
    return kept if most is None else kept.where(F.col("n_pixels") <= most)


def number_regions(summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`number` from 1 by first pixel and the identifier island-%05d.

    The order is global within an image, but over one row for each region, not for each pixel.
    """
    w = Window.partitionBy(*by).orderBy("first_at.y", "first_at.x") if by else Window.orderBy("first_at.y", "first_at.x")
    numbered = summaries.withColumn("number", F.row_number().over(w).cast("long"))
    return numbered.withColumn("island_id", F.format_string("island-%05d", F.col("number")))


def extents(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Window, first pixel and size of each label."""
    return labelled.groupBy(*by, "label").agg(
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"),
        F.min(F.struct("y", "x")).alias("first_at"), F.count("*").alias("n_pixels"),
    )


def touching_labels(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Labels of two planes that share a pixel or touch with the same label: (a_label, b_label)."""
    moved = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in [*AROUND, (0, 0)]]))
    near = a.select(*by, F.col("label").alias("a_label"), "y", "x", moved.alias("d")).select(
        *by, "a_label", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")
    )
    return near.join(b.select(*by, "y", "x", F.col("label").alias("b_label")), [*by, "y", "x"]).select(*by, "a_label", "b_label").distinct()
