"""Background and RMS: windows, clipped statistics, fills, interpolation and blending."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.operators import kernels
from fluxweave.operators.graph import connected_components
from fluxweave.operators.labels import pixel_id
from fluxweave.operators.pixels import moving
from fluxweave.operators.support import nearest_in_tile, nearest_seed
from fluxweave.operators.tiling import overlap_or_touch
from fluxweave.runtime import cut

CELLS = 4  # cells on a side of a block that one task clips


def axis_starts(length: int, window: int, step: int) -> tuple[list[int], int]:
    """Starts of windows along an axis, the last aligned to the edge; and the window's width."""
    w = min(length, window)
    starts = list(range(0, length - w + 1, step))
    if starts[-1] != length - w:
        starts.append(length - w)
    return starts, w


def plan_grid(spark: SparkSession, shape: tuple[int, int], window: tuple[int, int], step: tuple[int, int]) -> DataFrame:
    """Cells of a grid: cell_y, cell_x, window box, sample position (start + (width - 1) / 2)."""
    (ys, h), (xs, w) = (axis_starts(shape[k], window[k], step[k]) for k in (0, 1))
    rows = spark.range(len(ys) * len(xs)).select(F.floor(F.col("id") / len(xs)).alias("cell_y"), (F.col("id") % len(xs)).alias("cell_x"))

    def start(index: str, starts: list[int], jump: int) -> Column:
        return F.least(F.col(index) * jump, F.lit(starts[-1])).cast("long")

    cells = rows.withColumn("y0", start("cell_y", ys, step[0])).withColumn("x0", start("cell_x", xs, step[1]))
    return cells.select("cell_y", "cell_x", "y0", (F.col("y0") + h).alias("y1"), "x0", (F.col("x0") + w).alias("x1"), (F.col("y0") + (h - 1) / 2).alias("sample_y"), (F.col("x0") + (w - 1) / 2).alias("sample_x"))


def cells_of(coordinate: Column, starts: list[int], width: int, step: int) -> Column:
    """Indices of the windows along an axis that hold a coordinate."""
    last = len(starts) - 1
    low = F.greatest(F.lit(0), F.ceil((coordinate - width + 1) / step))
    high = F.least(F.floor(coordinate / step), F.lit(last))
    regular = F.filter(F.sequence(F.lit(0), F.lit(last)), lambda k: (k >= low) & (k <= high) & (k < last))
    at_edge = F.when(coordinate >= starts[-1], F.array(F.lit(last))).otherwise(F.array().cast("array<int>"))
    return F.concat(regular, at_edge)


def explode_windows(pixels: DataFrame, shape: tuple[int, int], window: tuple[int, int], step: tuple[int, int]) -> DataFrame:
    """A row for each pixel and window that holds it: for small grids and checks (rows grow by (window / step) squared)."""
    (ys, h), (xs, w) = (axis_starts(shape[k], window[k], step[k]) for k in (0, 1))
    return pixels.withColumn("cell_y", F.explode(cells_of(F.col("y"), ys, h, step[0]))).withColumn("cell_x", F.explode(cells_of(F.col("x"), xs, w, step[1])))


def plain_statistics(exploded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median and population deviation of each window, without clipping."""
    return exploded.where("value is not null").groupBy(*by, "cell_y", "cell_x").agg(F.median("value").alias("background"), F.stddev_pop("value").alias("rms"), F.count("*").alias("n"))


def clip_round(exploded: DataFrame, sigma: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """One clip round in relational form: keep values within sigma deviations of their window's median."""
    stats = plain_statistics(exploded, by)
    keys = [*by, "cell_y", "cell_x"]
    return exploded.join(stats.select(*keys, "background", "rms"), keys).where(F.abs(F.col("value") - F.col("background")) <= sigma * F.col("rms")).drop("background", "rms")


def window_statistics(pixels: DataFrame, shape: tuple[int, int], window: tuple[int, int], step: tuple[int, int], *, protected: bool = False, sigma: float = 3.0, rounds: int = 10, least: int = 6, by: Sequence[str] = ()) -> DataFrame:
    """Clipped median and deviation of every window: (cell_y, cell_x, background, rms, n_valid, n_retained, available).

    Windows without any pixel row are left to `complete_grid`.

    pixels(y, x, value[, protected]); null or non-finite values are invalid; a window with a
    protected pixel is unavailable with none retained. A task holds CELLS x CELLS windows'
    pixels, so a pixel is copied about (1 + window / (CELLS step)) squared times, not once a window.
    """
    (ys, h), (xs, w) = (axis_starts(shape[k], window[k], step[k]) for k in (0, 1))
    ny, nx = -(-len(ys) // CELLS), -(-len(xs) // CELLS)

    def blocks(axis: str, starts: list[int], width: int, n: int) -> Column:
        first = [starts[k * CELLS] for k in range(n)]
        last = [starts[min(len(starts), (k + 1) * CELLS) - 1] + width for k in range(n)]
        jump = step[0 if axis == "y" else 1] * CELLS
        near = F.floor(F.col(axis) / jump)  # a block starts every `jump` pixels; earlier ones may reach here
        back = -(-width // jump) + 1
        some = F.sequence(F.greatest(F.lit(0), near - back), F.least(F.lit(n - 1), near + 1))
        lows, highs = F.array(*map(F.lit, first)), F.array(*map(F.lit, last))
        return F.filter(some, lambda k: (F.get(lows, k.cast("int")) <= F.col(axis)) & (F.col(axis) < F.get(highs, k.cast("int"))))

    flag = F.col("protected") if protected else F.lit(False)
    dealt = pixels.select(*by, F.col("y").cast("long"), F.col("x").cast("long"), "value", flag.alias("_p")).withColumn("_by", F.explode(blocks("y", ys, h, ny))).withColumn("_bx", F.explode(blocks("x", xs, w, nx)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by_, bx_ = int(pdf["_by"].iloc[0]), int(pdf["_bx"].iloc[0])
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        y_0, x_0 = y.min(), x.min()
        plane = np.full((int(y.max() - y_0) + 1, int(x.max() - x_0) + 1), np.nan)
        plane[y - y_0, x - x_0] = pdf["value"].to_numpy(np.float64)
        seen = np.zeros(plane.shape, bool)
        seen[y - y_0, x - x_0] = True
        guard = np.zeros(plane.shape, bool)
        guard[y - y_0, x - x_0] = pdf["_p"].to_numpy(bool)
        rows = []
        for cy in range(by_ * CELLS, min(len(ys), (by_ + 1) * CELLS)):
            for cx in range(bx_ * CELLS, min(len(xs), (bx_ + 1) * CELLS)):
                box = np.s_[max(0, ys[cy] - y_0) : max(0, ys[cy] + h - y_0), max(0, xs[cx] - x_0) : max(0, xs[cx] + w - x_0)]
                if not seen[box].any():
                    continue
                part = plane[box]
                valid = int(np.isfinite(part).sum())
                median, rms, kept = (None, None, 0) if guard[box].any() else kernels.clip_statistics(part.ravel(), sigma, rounds, least)
                rows.append((cy, cx, median, rms, valid, kept, median is not None))
        out = pd.DataFrame(rows, columns=["cell_y", "cell_x", "background", "rms", "n_valid", "n_retained", "available"])
        for b in by:
            out.insert(0, b, pdf[b].iloc[0])
        return out[[*by, "cell_y", "cell_x", "background", "rms", "n_valid", "n_retained", "available"]]

    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in pixels.schema.fields if f.name in by)
    return dealt.groupBy(*by, "_by", "_bx").applyInPandas(run, keys + "cell_y long, cell_x long, background double, rms double, n_valid long, n_retained long, available boolean")


def complete_grid(grid: DataFrame, cells: DataFrame) -> DataFrame:
    """All planned cells of one image; those without any pixel are unavailable."""
    full = cells.select("cell_y", "cell_x").join(grid, ["cell_y", "cell_x"], "left")
    return full.fillna(False, ["available"]).fillna(0, ["n_valid", "n_retained"])


def nearest_available(grid: DataFrame, by: Sequence[str] = (), reach: int = 32) -> DataFrame:
    """Each cell's nearest available cell by distance in cells (ties: smaller y, then x): near_y, near_x, d2.

    Cells without one within reach look again four times as far, until none is left or the
    whole grid is within reach; each look is a nearest-seed join in tiles.
    """
    keys = [*by, "cell_y", "cell_x"]
    plane = grid.select(*by, F.col("cell_y").alias("y"), F.col("cell_x").alias("x"), "available")
    own = pixel_id(F.col("y"), F.col("x"))
    seeds = plane.where("available").select(*by, "y", "x", own.alias("label"))
    extent = plane.agg(F.max("y"), F.max("x")).first()
    left, done = plane.where("not available").select(*by, "y", "x"), seeds.withColumn("d2", F.lit(0).cast("long"))
    while not left.isEmpty():
        found = cut(nearest_seed(seeds, left, reach, by), "near")
        done = done.unionByName(found.select(done.columns))
        left = left.join(found, [*by, "y", "x"], "left_anti")
        if reach > 2 * max(extent):
            break
        reach *= 4
    none = left.select(*by, F.col("y").alias("cell_y"), F.col("x").alias("cell_x"), *[F.lit(None).cast("long").alias(c) for c in ("near_y", "near_x", "d2")])
    near = done.select(*by, F.col("y").alias("cell_y"), F.col("x").alias("cell_x"), F.shiftright("label", 32).alias("near_y"), F.col("label").bitwiseAND(F.lit(2**32 - 1)).alias("near_x"), "d2")
    return near.unionByName(none.select(near.columns)).select(*keys, "near_y", "near_x", "d2")


def nearest_true(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pixel of a plane the nearest true one: y, x and squared distance; ties to the smaller y, then x."""
    at, (y, x) = np.nonzero(mask), np.indices(mask.shape)
    label, d2 = nearest_in_tile(*at, (at[0] << 32) + at[1], y.ravel(), x.ravel(), max(mask.shape))
    return (label >> 32).reshape(mask.shape), (label & (2**32 - 1)).reshape(mask.shape), d2.reshape(mask.shape)


def fill_grid(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unavailable cells take the nearest available one's values; without any, both stay null."""
    near = nearest_available(grid, by)
    source = grid.where("available").select(*by, F.col("cell_y").alias("near_y"), F.col("cell_x").alias("near_x"), F.col("background").alias("_b"), F.col("rms").alias("_r"))
    keys = [*by, "cell_y", "cell_x"]
    filled = grid.join(near, keys).join(source, [*by, "near_y", "near_x"], "left")
    return filled.select(*keys, F.col("_b").alias("background"), F.col("_r").alias("rms"), "available", (~F.col("available") & F.col("_b").isNotNull()).alias("filled"), "d2")


def clean_coverage(grid: DataFrame, reach: tuple[int, int], by: Sequence[str] = ()) -> DataFrame:
    """Share of cells with an available cell within reach."""
    plane = grid.select(*by, F.col("cell_y").alias("y"), F.col("cell_x").alias("x"), F.col("available").cast("int").alias("_a"))
    return moving(plane, "_a", "_near", F.max, *reach, by).groupBy(*by).agg(F.avg("_near").alias("coverage"))


def floor_local_noise(grid: DataFrame, fraction: float, reach: tuple[int, int], by: Sequence[str] = ()) -> DataFrame:
    """Filled cells near an available one never fall under fraction x min(coarse, largest available in reach).

    grid(cell_y, cell_x, rms, available, own_rms, coarse_rms): rms is filled, own_rms null where unavailable.
    """
    plane = grid.withColumnRenamed("cell_y", "y").withColumnRenamed("cell_x", "x")
    near = moving(plane, "own_rms", "_largest", F.max, *reach, by)
    floor = fraction * F.least("coarse_rms", "_largest")
    held = F.when(F.col("available") | F.col("_largest").isNull(), F.col("rms")).otherwise(F.greatest(F.col("rms"), floor))
    return near.withColumn("rms", held).drop("_largest").withColumnRenamed("y", "cell_y").withColumnRenamed("x", "cell_x")


def crowded_local_noise(grid: DataFrame, ratio: float, reach: tuple[int, int], by: Sequence[str] = ()) -> DataFrame:
    """Beyond reach of an available cell the coarse value stands, unless it is over ratio x the filled one."""
    plane = grid.withColumnRenamed("cell_y", "y").withColumnRenamed("cell_x", "x").withColumn("_a", F.col("available").cast("int"))
    near = moving(plane, "_a", "_near", F.max, *reach, by)
    held = F.when((F.col("_near") == 1) | (F.col("coarse_rms") > ratio * F.col("rms")), F.col("rms")).otherwise(F.col("coarse_rms"))
    return near.withColumn("rms", held).drop("_near", "_a").withColumnRenamed("y", "cell_y").withColumnRenamed("x", "cell_x")


def choose_local_noise(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The crowded rule below half clean coverage, else the floor (reach 10 cells, as windows of 35 px every 7 px)."""
    reach = (10, 10)
    share = clean_coverage(grid, reach, by)
    crowded = crowded_local_noise(grid, 3.0, reach, by).withColumnRenamed("rms", "_c")
    floored = floor_local_noise(grid, 0.8, reach, by).withColumnRenamed("rms", "_f")
    keys = [*by, "cell_y", "cell_x"]
    both = grid.drop("rms").join(crowded.select(*keys, "_c"), keys).join(floored.select(*keys, "_f"), keys)
    both = both.join(share, list(by)) if by else both.crossJoin(F.broadcast(share))  # one row
    return both.withColumn("rms", F.when(F.col("coverage") < 0.5, F.col("_c")).otherwise(F.col("_f"))).drop("_c", "_f", "coverage")


def secant_cells(samples: list[float], length: int) -> tuple[int, int]:
    """Inner cells of the lines that go on from the first and from the last cell to the image's edges.

    A line is at least as long inside the grid as beyond it, so the inner cell is as many
    whole steps away as cover the distance to the edge, and within the grid.
    """
    last, step = len(samples) - 1, samples[1] - samples[0]
    ahead = math.ceil(samples[0] / step)
    reach = samples[last] - (length - 1 - samples[last])  # the inner cell lies here or before
    behind = math.floor((reach - samples[0]) / step)
    return min(ahead, last), min(max(behind, 0), last - 1)


def extend_axis(grid: DataFrame, axis: str, samples: list[float], length: int, by: Sequence[str] = ()) -> tuple[DataFrame, list[float]]:
    """Add edge samples at 0 and length - 1 by secants; the RMS never falls below the edge cell."""
    if len(samples) == 1:
        return grid, samples
    lower, upper = secant_cells(samples, length)
    other = "cell_x" if axis == "cell_y" else "cell_y"
    out, locations, shift = grid, list(samples), 0
    for edge, anchor, place in ((0, lower, 0.0), (len(samples) - 1, upper, float(length - 1))):
        if samples[0] <= place <= samples[-1]:
            continue
        pick = lambda c, k: F.max(F.when(F.col(axis) == k, F.col(c)))  # noqa: E731, B023
        ends = grid.where(F.col(axis).isin(edge, anchor)).groupBy(*by, other).agg(*[pick(c, k).alias(f"{c}_{n}") for c in ("background", "rms") for n, k in (("e", edge), ("a", anchor))])
        far = (place - samples[edge]) / (samples[edge] - samples[anchor])
        line = lambda c: F.col(f"{c}_e") + far * (F.col(f"{c}_e") - F.col(f"{c}_a"))  # noqa: E731, B023
        index = -1 if edge == 0 else len(samples)
        extra = ends.select(*by, F.lit(index).cast("long").alias(axis), F.col(other), line("background").alias("background"), F.greatest(line("rms"), F.col("rms_e")).alias("rms"))
        out = out.select(*by, axis, other, "background", "rms").unionByName(extra)
        if edge == 0:
            locations, shift = [place, *locations], 1
        else:
            locations = [*locations, place]
    return (out.withColumn(axis, F.col(axis) + shift) if shift else out), locations


def bracket(coordinate: Column, samples: list[float], step: float, clamp: bool = False) -> tuple[Column, Column]:
    """(lower cell, fraction) of a coordinate among samples; beyond the ends the end segment goes on, or clamps.

    Interior samples are regular, so the cell is arithmetic; the few irregular ends are literals.
    """
    if len(samples) == 1:
        return F.lit(0).cast("long"), F.lit(0.0)
    c = F.least(F.greatest(coordinate.cast("double"), F.lit(float(samples[0]))), F.lit(float(samples[-1]))) if clamp else coordinate.cast("double")
    grid = F.array(*[F.lit(float(s)) for s in samples])
    regular = 1 if samples[0] == 0.0 and len(samples) > 2 and samples[1] - samples[0] != step else 0
    guess = F.floor((c - samples[regular]) / step) + regular
    last = len(samples) - 2
    # The guess is off by one at most, at the irregular ends.
    some = [F.least(F.greatest(guess + k, F.lit(0)), F.lit(last)) for k in (-1, 0, 1)]
    at = lambda k: F.get(grid, k.cast("int"))
    low = F.when(c >= at(some[2]), some[2]).when(c >= at(some[1]), some[1]).otherwise(some[0])
    return low.cast("long"), (c - at(low)) / (at(low + 1) - at(low))


def interpolate(pixels: DataFrame, grid: DataFrame, shape: tuple[int, int], window: tuple[int, int], step: tuple[int, int], extrapolate_rms: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Bilinear background and RMS at each valid pixel: one lookup of the bracketing cells.

    grid(cell_y, cell_x, background, rms) is filled. y is taken first, then x. An invalid
    pixel (null value) gets nulls.
    """
    samples = []
    for k in (0, 1):
        starts, w = axis_starts(shape[k], window[k], step[k])
        samples.append([s + (w - 1) / 2 for s in starts])
    plain = grid.select(*by, "cell_y", "cell_x", "background", "rms")
    ext, ys = extend_axis(plain, "cell_y", samples[0], shape[0], by)
    ext, xs = extend_axis(ext, "cell_x", samples[1], shape[1], by)

    def look(df: DataFrame, table: DataFrame, columns: list[str], sy: list[float], sx: list[float], clamp: bool) -> DataFrame:
        """One join with the grid: each cell already carries the values of the three cells after it."""
        cells = table.select(*by, "cell_y", "cell_x", *columns)
        corners = cells.select(*by, F.col("cell_y").alias("_iy"), F.col("cell_x").alias("_ix"), *[F.col(c).alias(f"_{c}00") for c in columns])
        for dy, dx in ((0, 1), (1, 0), (1, 1)):
            after = cells.select(*by, (F.col("cell_y") - dy).alias("_iy"), (F.col("cell_x") - dx).alias("_ix"), *[F.col(c).alias(f"_{c}{dy}{dx}") for c in columns])
            corners = corners.join(after, [*by, "_iy", "_ix"], "left")
        (iy, fy), (ix, fx) = bracket(F.col("y"), sy, step[0], clamp), bracket(F.col("x"), sx, step[1], clamp)
        out = df.withColumn("_iy", iy).withColumn("_fy", fy).withColumn("_ix", ix).withColumn("_fx", fx).join(corners, [*by, "_iy", "_ix"], "left")
        for c in columns:
            v = {k: F.col(f"_{c}{k}") for k in ("00", "01", "10", "11")}
            # An axis of one cell has fraction 0, and nothing after it.
            low = F.when(F.col("_fx") == 0, v["00"]).otherwise(v["00"] * (1 - F.col("_fx")) + v["01"] * F.col("_fx"))
            high = F.when(F.col("_fx") == 0, v["10"]).otherwise(v["10"] * (1 - F.col("_fx")) + v["11"] * F.col("_fx"))
            value = F.when(F.col("_fy") == 0, low).otherwise(low * (1 - F.col("_fy")) + high * F.col("_fy"))
            out = out.withColumn(c, F.when(F.col("value").isNotNull(), value)).drop(*[f"_{c}{k}" for k in v])
        return out.drop("_iy", "_fy", "_ix", "_fx")

    if extrapolate_rms:
        both = look(pixels, ext, ["background", "rms"], ys, xs, False)
    else:
        both = look(look(pixels, ext, ["background"], ys, xs, False), plain, ["rms"], samples[0], samples[1], True)
    return both.withColumn("rms", F.greatest("rms", F.when(F.col("rms").isNotNull(), F.lit(0.0))))


def smooth_weight(distance: Column, radius: float, width: float) -> Column:
    """Smoothstep from 1 inside to 0 at the radius."""
    t = F.least(F.greatest((radius - distance) / width, F.lit(0.0)), F.lit(1.0))
    return t * t * (3 - 2 * t)


def blend(weight: Column, coarse_b: Column, coarse_r: Column, fine_b: Column, fine_r: Column) -> tuple[Column, Column]:
    """Background both ways; the fine RMS only raises the coarse one."""
    w = F.when(fine_b.isNotNull() & fine_r.isNotNull(), weight).otherwise(0.0)
    background = F.when(w > 0, (1 - w) * coarse_b + w * fine_b).otherwise(coarse_b)
    rms = F.when((w > 0) & (fine_r > coarse_r), F.greatest((1 - w) * coarse_r + w * fine_r, coarse_r)).otherwise(coarse_r)
    return background, rms


def merged_regions(positions: DataFrame, shape: tuple[int, int], margin: int, bucket: int = 4096) -> DataFrame:
    """Boxes around positions, those that overlap or touch merged transitively: region, y0, y1, x0, x1, n.

    Boxes meet through buckets of the plane (a box is in four at most), so the self-join is by
    equality first and the box test second.
    """
    box = positions.select(
        F.monotonically_increasing_id().alias("id") if "id" not in positions.columns else F.col("id"),
        F.greatest(F.lit(0), F.floor("y") - margin).alias("y0"), F.least(F.lit(shape[0]), F.floor("y") + margin + 1).alias("y1"),
        F.greatest(F.lit(0), F.floor("x") - margin).alias("x0"), F.least(F.lit(shape[1]), F.floor("x") + margin + 1).alias("x1"),
    )
    spans = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket)))
    dealt = box.withColumn("_by", spans("y0", "y1")).withColumn("_bx", spans("x0", "x1"))
    side = lambda p: dealt.select("_by", "_bx", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "y0", "y1", "x0", "x1")])
    pairs = side("a").join(side("b"), ["_by", "_bx"]).where((F.col("a_id") < F.col("b_id")) & overlap_or_touch("a", "b"))
    groups = connected_components(pairs.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst")))
    named = box.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("region", F.coalesce("component", "id"))
    return named.groupBy("region").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count("*").alias("n"))


def block_noise(pixels: DataFrame, side: int = 512, least: int = 64, by: Sequence[str] = ()) -> DataFrame:
    """Clipped median and deviation of each square block with enough valid samples."""
    dealt = pixels.where("value is not null").select(*by, F.floor(F.col("y") / side).alias("block_y"), F.floor(F.col("x") / side).alias("block_x"), "value")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*by, "block_y", "block_x"]].head(1).copy()
        v = pdf["value"].to_numpy(np.float64)
        median, rms, n = kernels.clip_statistics(v) if np.isfinite(v).sum() >= least else (None, None, 0)
        out["median"], out["sigma"], out["n_retained"] = median, rms, n
        return out

    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in pixels.schema.fields if f.name in by)
    return dealt.groupBy(*by, "block_y", "block_x").applyInPandas(run, keys + "block_y long, block_x long, median double, sigma double, n_retained long")


def peak_threshold(median: Column, sigma: Column, reference: Column, detection_sigma: float) -> Column:
    """median + k x min(block sigma, reference sigma)."""
    return median + detection_sigma * F.least(sigma, reference)


def expected_source_count(pixels: DataFrame, detection_sigma: float = 5.0, side: int = 512) -> DataFrame:
    """An upper estimate of an image's sources: 3 x 3 maxima over each block's threshold; one row."""
    noises = block_noise(pixels, side)
    reference = noises.agg(F.median("sigma").alias("reference"))
    peaks = moving(pixels, "value", "_max", F.max, 1, 1).withColumn("block_y", F.floor(F.col("y") / side)).withColumn("block_x", F.floor(F.col("x") / side))
    marked = peaks.join(noises, ["block_y", "block_x"]).crossJoin(F.broadcast(reference))  # reference is one row
    over = (F.col("value") == F.col("_max")) & (F.col("value") >= peak_threshold(F.col("median"), F.col("sigma"), F.col("reference"), detection_sigma))
    return marked.agg(F.count_if(over).alias("n_sources"))


def check_exactly_once(batches: Sequence[DataFrame], cells: DataFrame) -> DataFrame:
    """Union of batches of cell statistics; a cell seen twice or never is an error at run time."""
    union = batches[0]
    for b in batches[1:]:
        union = union.unionByName(b)
    seen = cells.select("cell_y", "cell_x").join(union.groupBy("cell_y", "cell_x").agg(F.count("*").alias("_n")), ["cell_y", "cell_x"], "left")
    bad = seen.where("coalesce(_n, 0) <> 1").count()
    if bad:
        raise ValueError(f"{bad} cells are missing or repeated")
    return union
