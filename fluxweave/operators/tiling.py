"""Tiles of an image, boxes, and the halo exchange that grouped stencils need.

Boxes are half-open. A tile is a core with a read halo clipped to the image.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def plan_tiles(spark: SparkSession, shape: tuple[int, int], core: tuple[int, int], halo: tuple[int, int] = (0, 0), origin: tuple[int, int] = (0, 0)) -> DataFrame:
    """Canonical row-major tiles: index, core and read boxes. A partition origin shifts the grid."""
    ny, nx = (-(-(shape[k] + origin[k]) // core[k]) for k in (0, 1))
    tile = spark.range(ny * nx).select(F.col("id").alias("tile"), F.floor(F.col("id") / nx).alias("tile_y"), (F.col("id") % nx).alias("tile_x"))

    def bound(axis: int, index: str, upper: bool) -> Column:
        at = (F.col(index) + int(upper)) * core[axis] - origin[axis]
        return F.least(F.greatest(at, F.lit(0)), F.lit(shape[axis]))

    cores = tile.select("tile", "tile_y", "tile_x", bound(0, "tile_y", False).alias("y0"), bound(0, "tile_y", True).alias("y1"), bound(1, "tile_x", False).alias("x0"), bound(1, "tile_x", True).alias("x1"))
    grown = expanded("y0", "y1", "x0", "x1", halo, shape)
    return cores.select("*", *[c.alias(f"read_{n}") for c, n in zip(grown, ("y0", "y1", "x0", "x1"), strict=True)])


def expanded(y0: str, y1: str, x0: str, x1: str, margin: tuple[int, int], shape: tuple[int, int]) -> list[Column]:
    """A box grown by a margin and clipped to the image."""
    return [
        F.greatest(F.lit(0), F.col(y0) - margin[0]),
        F.least(F.lit(shape[0]), F.col(y1) + margin[0]),
        F.greatest(F.lit(0), F.col(x0) - margin[1]),
        F.least(F.lit(shape[1]), F.col(x1) + margin[1]),
    ]


def contains(outer: str, inner: str) -> Column:
    """Whether a box holds another: columns {prefix}_y0 and so on."""
    o, i = (lambda n: F.col(f"{outer}_{n}")), (lambda n: F.col(f"{inner}_{n}"))
    return (o("y0") <= i("y0")) & (i("y1") <= o("y1")) & (o("x0") <= i("x0")) & (i("x1") <= o("x1"))


def overlap_or_touch(a: str, b: str) -> Column:
    """Half-open boxes that overlap or share an edge."""
    p, q = (lambda n: F.col(f"{a}_{n}")), (lambda n: F.col(f"{b}_{n}"))
    return (p("y0") <= q("y1")) & (q("y0") <= p("y1")) & (p("x0") <= q("x1")) & (q("x0") <= p("x1"))


def union_bounds(*prefixes: str) -> list[Column]:
    """The bounding box of several boxes of a row."""
    pick = {"y0": F.least, "y1": F.greatest, "x0": F.least, "x1": F.greatest}
    return [f(*[F.col(f"{p}_{n}") for p in prefixes]).alias(n) for n, f in pick.items()]


def owner(y: Column, x: Column, core: tuple[int, int], origin: tuple[int, int] = (0, 0)) -> tuple[Column, Column]:
    """Index of the tile that owns a position."""
    return F.floor((y + origin[0]) / core[0]), F.floor((x + origin[1]) / core[1])


def tiles_meeting(boxes: DataFrame, core: tuple[int, int], origin: tuple[int, int] = (0, 0)) -> DataFrame:
    """A row for each tile that a half-open box (y0, y1, x0, x1) meets; an empty box meets none."""

    def span(lo: str, hi: str, axis: int) -> Column:
        first, last = F.floor((F.col(lo) + origin[axis]) / core[axis]), F.floor((F.col(hi) - 1 + origin[axis]) / core[axis])
        return F.sequence(first, last)

    some = boxes.where("y1 > y0 and x1 > x0")
    return some.withColumn("tile_y", F.explode(span("y0", "y1", 0))).withColumn("tile_x", F.explode(span("x0", "x1", 1)))


def batch_objects(objects: DataFrame, core: tuple[int, int], budget: int) -> DataFrame:
    """objects(id, y0, y1, x0, x1) with `tile_y`, `tile_x` and `batch`: those of a storage core in raster order, cut by read budget.

    A batch takes objects until their boxes' pixels reach the budget, so it reads less than
    the budget and one object; cores are independent of each other.
    """
    area = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    ty, tx = owner(F.col("y0"), F.col("x0"), core)
    placed = objects.withColumn("tile_y", ty.cast("long")).withColumn("tile_x", tx.cast("long"))
    before = F.sum(area).over(Window.partitionBy("tile_y", "tile_x").orderBy("y0", "x0", "id").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("batch", F.floor(F.coalesce(before, F.lit(0)) / budget))


def core_side(budget_bytes: Column, halo: Column, pixel_bytes: Column) -> Column:
    """Side of the largest square core whose tile with its halo fits a task's memory; 0 if none does."""
    return F.greatest(F.lit(0).cast("long"), F.floor(F.sqrt(F.floor(budget_bytes / pixel_bytes).cast("double"))) - 2 * halo)


def with_halo(pixels: DataFrame, core: int, halo: int) -> DataFrame:
    """Each pixel once for every tile whose core or halo holds it: tile_y, tile_x added.

    A halo under a core's size copies a pixel to four tiles at most, so the shuffle grows by
    (1 + 2 halo / core) squared only.
    """

    def tiles(axis: str) -> Column:
        return F.sequence(F.floor((F.col(axis) - halo) / core), F.floor((F.col(axis) + halo) / core))

    return pixels.withColumn("tile_y", F.explode(tiles("y"))).withColumn("tile_x", F.explode(tiles("x")))


def map_tiles(pixels: DataFrame, kernel: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], columns: Sequence[str], out: str, core: int, halo: int, by: Sequence[str] = ()) -> DataFrame:
    """Run a dense stencil kernel tile by tile and keep each tile's core.

    kernel gets planes (a dict of 2-D arrays, NaN where there is no pixel, and `inside`, true
    where there is one) and returns planes; `out` names the returned columns and types.
    A tile is bounded by (core + 2 halo) squared pixels whatever the image.
    """
    names = [part.split()[0] for part in out.split(",")]
    dealt = with_halo(pixels.select(*by, "y", "x", *columns), core, halo)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["tile_y"].iloc[0]), int(pdf["tile_x"].iloc[0])
        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        y0, x0 = y.min(), x.min()
        shape = (int(y.max() - y0) + 1, int(x.max() - x0) + 1)
        planes: dict[str, np.ndarray] = {}
        for c in columns:
            plane = np.full(shape, np.nan)
            plane[y - y0, x - x0] = pd.to_numeric(pdf[c], errors="coerce").to_numpy(np.float64)
            planes[c] = plane
        inside = np.zeros(shape, bool)
        inside[y - y0, x - x0] = True
        result = kernel(planes | {"inside": inside, "y0": y0, "x0": x0})
        mine = (y // core == ty) & (x // core == tx)
        data = {b: pdf[b].to_numpy()[mine] for b in by} | {"y": y[mine], "x": x[mine]}
        return pd.DataFrame(data | {n: result[n][y - y0, x - x0][mine] for n in names})

    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in pixels.schema.fields if f.name in by] + ["y long", "x long", out])
    return dealt.groupBy(*by, "tile_y", "tile_x").applyInPandas(run, schema)
