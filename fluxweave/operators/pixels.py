"""Pixel-wise and neighbourhood operators on pixels(y, x, ...).

Every operator takes `by`, the columns that tell images apart (none for one image), so a
table of many images is one plan. Absent rows are pixels outside the image or the mask.
Moving windows are separable: one pass along rows, one along columns, each a range frame
within a row or column, so no neighbour is exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.runtime import cut

AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]
HALF = [(0, 1), (1, -1), (1, 0), (1, 1)]  # each unordered pair of 8-neighbours once


def normalize_residual(value: Column, background: Column, rms: Column) -> Column:
    """(value - background) / rms where all are finite and rms is positive, else null."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite(value) & finite(background) & finite(rms) & (rms > 0), (value - background) / rms)


def threshold_masks(snr: Column, island_sigma: float, detection_sigma: float) -> tuple[Column, Column]:
    """Island membership is inclusive, a detection seed is strict; an unknown S/N is neither."""
    return F.coalesce(snr >= island_sigma, F.lit(False)), F.coalesce(snr > detection_sigma, F.lit(False))


def bright_candidates(pixels: DataFrame, threshold_sigma: float = 75.0) -> DataFrame:
    """Pixels over one strict threshold."""
    return pixels.where(F.col("snr") > threshold_sigma)


def _frame(along: str, across: Sequence[str], before: int, after: int):
    return Window.partitionBy(*across).orderBy(along).rangeBetween(-before, after)


def moving(pixels: DataFrame, column: str, out: str, how, ry: int, rx: int, by: Sequence[str] = ()) -> DataFrame:
    """A (2 ry + 1) x (2 rx + 1) moving aggregate that may be taken along x first, then along y (max, min, sum).

    The image is dense: each row has all its pixels (invalid ones with null values).
    """
    first = pixels.withColumn("_row", how(column).over(_frame("x", [*by, "y"], rx, rx)))
    return first.withColumn(out, how("_row").over(_frame("y", [*by, "x"], ry, ry))).drop("_row")


def completed(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """pixels with rows of nulls for those that an image lacks within its extent; `_real` marks the given ones."""
    box = pixels.groupBy(*by).agg(*[f(c).alias(f"_{c}{k}") for c in ("y", "x") for k, f in (("0", F.min), ("1", F.max))]).where("_y0 is not null")
    rows = box.withColumn("y", F.explode(F.sequence("_y0", "_y1")))
    full = rows.withColumn("x", F.explode(F.sequence("_x0", "_x1"))).select(*by, "y", "x")
    return full.join(pixels.withColumn("_real", F.lit(1)), [*by, "y", "x"], "left")


def moving_on_support(points: DataFrame, pixels: DataFrame, out: str, how, column: str, ry: int, rx: int, by: Sequence[str] = ()) -> DataFrame:
    """A moving aggregate of sparse points, read at all pixels (absent points are null)."""
    keys = [*by, "y", "x"]
    return moving(pixels.join(points.select(*keys, column), keys, "left"), column, out, how, ry, rx, by)


def neighbour_pairs(pixels: DataFrame, carry: Sequence[str], offsets=HALF, by: Sequence[str] = ()) -> DataFrame:
    """Touching pairs of pixels: columns of `carry` as a_* and b_*; one equi-join on shifted coordinates."""
    moved = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("ny"), (F.col("x") + dx).alias("nx")) for dy, dx in offsets]))
    a = pixels.select(*by, *[F.col(c).alias(f"a_{c}") for c in carry], moved.alias("n")).select(
        *by, *[f"a_{c}" for c in carry], F.col("n.ny").alias("y"), F.col("n.nx").alias("x")
    )
    b = pixels.select(*by, "y", "x", *[F.col(c).alias(f"b_{c}") for c in carry if c not in ("y", "x")])
    joined = a.join(b, [*by, "y", "x"])
    for c in ("y", "x"):
        if c in carry:
            joined = joined.withColumn(f"b_{c}", F.col(c))
    return joined


def _constant(plane: DataFrame, by: Sequence[str]) -> DataFrame:
    """A dense plane with `_real`: marks real pixels equal to all real ones around them."""
    low = moving(plane, "value", "_low", F.min, 1, 1, by)
    both = moving(low, "value", "_high", F.max, 1, 1, by)
    counted = moving(both.withColumn("_some", F.col("value").isNotNull().cast("int")), "_some", "_known", F.sum, 1, 1, by)
    counted = moving(counted, "_real", "_all", F.sum, 1, 1, by)
    flag = F.coalesce((F.col("_low") == F.col("_high")) & (F.col("_known") == F.col("_all")) & F.col("_real").isNotNull(), F.lit(False))
    return counted.withColumn("constant", flag).drop("_low", "_high", "_known", "_all", "_some")


def constant_square_centres(pixels: DataFrame, by: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """Pixels equal to all their neighbours in the image; a null equals nothing. dense: no row is missing, none is added."""
    plane = pixels.withColumn("_real", F.lit(1)) if dense else completed(pixels, by)
    return _constant(plane, by).where("_real = 1").select(*pixels.columns, "constant")


def valid_pixels(pixels: DataFrame, by: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """Ingress validity: finite, and in no 3 x 3 square of one repeated value. dense: no row is missing."""
    plane = pixels.withColumn("_real", F.lit(1)) if dense else completed(pixels, by)
    near = moving(_constant(plane, by).withColumn("_c", F.col("constant").cast("int")), "_c", "_near", F.max, 1, 1, by)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    return near.where("_real = 1").withColumn("valid", finite & (F.col("_near") == 0)).select(*pixels.columns, "valid")


def neighbour_count(mask: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many pixels of a sparse mask lie in the 3 x 3 square around each, itself included."""
    keys = [*by, "y", "x"]
    counts = neighbour_pairs(mask, ["y"], [*AROUND, (0, 0)], by).groupBy(*keys).agg(F.count("*").alias("n_near"))
    return mask.join(counts, keys)


def opening(mask: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """3 x 3 opening of the union of all labels; survivors keep their columns. Outside the image is background.

    A pixel is only kept for a whole square of mask pixels around some centre, and in such a
    square no row lacks a pixel, so separable frames over the sparse mask are exact here.
    """
    counted = moving(mask.withColumn("_one", F.lit(1)), "_one", "_n", F.sum, 1, 1, by)
    eroded = counted.withColumn("_kept", (F.col("_n") == 9).cast("int"))
    return moving(eroded, "_kept", "_open", F.max, 1, 1, by).where("_open = 1").drop("_kept", "_open", "_one", "_n")


def disc(radius: float) -> list[tuple[int, int, int]]:
    """(dy, dx, squared distance) of the pixels within a radius."""
    r = int(radius)
    return [(dy, dx, dy * dy + dx * dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius]


def dilate(mask: DataFrame, shape: Sequence[tuple], by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Distinct pixels that the shape's offsets reach from the mask (with the carried labels)."""
    reach = F.explode(F.array(*[F.struct(F.lit(d[0]).alias("dy"), F.lit(d[1]).alias("dx")) for d in shape]))
    return (
        mask.select(*by, "y", "x", *carry, reach.alias("d"))
        .select(*by, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), *carry)
        .distinct()
    )


def local_maxima(pixels: DataFrame, threshold: float, radius: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Pixels over a strict threshold that equal the maximum around them."""
    return moving(pixels, "snr", "_max", F.max, radius, radius, by).where(
        (F.col("snr") == F.col("_max")) & (F.col("snr") > threshold)
    ).drop("_max")


def count_peaks(pixels: DataFrame, threshold: Column | float, by: Sequence[str] = ()) -> DataFrame:
    """Number of 3 x 3 maxima at or over a threshold; tied neighbours both count."""
    marked = moving(pixels, "value", "_max", F.max, 1, 1, by)
    return marked.groupBy(*by).agg(F.count_if((F.col("value") == F.col("_max")) & (F.col("value") >= threshold)).alias("n_peaks"))


def ascent(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each pixel's highest pixel among itself and its neighbours: up_y, up_x. Ties go to the first in row order."""
    best = neighbour_pairs(pixels, ["y", "x", "snr"], AROUND + [(0, 0)], by)
    pick = F.max_by(F.struct("a_y", "a_x"), F.struct(F.col("a_snr"), -F.col("a_y"), -F.col("a_x")))
    return best.groupBy(*by, "y", "x").agg(pick.alias("up")).select(*by, "y", "x", F.col("up.a_y").alias("up_y"), F.col("up.a_x").alias("up_x"))


def basins(pointers: DataFrame, rounds: int, by: Sequence[str] = ()) -> DataFrame:
    """Follow the pointers to their peaks by pointer doubling: 2 ** rounds steps; each round is cut, as it reads the one before twice."""
    keys = [*by, "y", "x"]
    for _ in range(rounds):
        pointers = cut(pointers, "pointers")
        ahead = pointers.select(*by, F.col("y").alias("up_y"), F.col("x").alias("up_x"), F.col("up_y").alias("_y"), F.col("up_x").alias("_x"))
        pointers = pointers.join(ahead, [*by, "up_y", "up_x"]).select(*keys, F.col("_y").alias("up_y"), F.col("_x").alias("up_x"))
    return pointers


def saddles(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each two touching regions the highest pass: the maximum over contacts of the lower value."""
    pairs = neighbour_pairs(labelled, ["label", "snr"], HALF, by).where("a_label <> b_label")
    return pairs.groupBy(*by, F.least("a_label", "b_label").alias("low"), F.greatest("a_label", "b_label").alias("high")).agg(
        F.max(F.least("a_snr", "b_snr")).alias("saddle")
    )


def b3_smooth(pixels: DataFrame, column: str, out: str, dilation: int, by: Sequence[str] = ()) -> DataFrame:
    """Separable dilated B3 spline (1, 4, 6, 4, 1) / 16 along x, then y; zero beyond the image (needs a dense image)."""
    taps = ((-2, 1 / 16), (-1, 4 / 16), (0, 6 / 16), (1, 4 / 16), (2, 1 / 16))

    def along(df: DataFrame, source: str, target: str, axis: str, across: list[str]) -> DataFrame:
        w = Window.partitionBy(*across).orderBy(axis)
        total = None
        for k, weight in taps:
            part = F.coalesce(F.lag(source, -k * dilation).over(w) if k else F.col(source), F.lit(0.0)) * weight
            total = part if total is None else total + part
        return df.withColumn(target, total)

    rows = along(pixels, column, "_row", "x", [*by, "y"])
    return along(rows, "_row", out, "y", [*by, "x"]).drop("_row")


def atrous(pixels: DataFrame, minimum_support: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Three scales of a B3 transform, normalised by support: coefficient_k and support_k for k = 1, 2, 3.

    pixels(y, x, value, valid) of a dense image; the value of an invalid pixel is not read.
    """
    df = pixels.withColumn("_m", F.col("valid").cast("double")).withColumn("_s", F.when(F.col("valid"), F.col("value")).otherwise(0.0))
    for k, dilation in enumerate((1, 2, 4), 1):
        df = b3_smooth(df.withColumn("_sm", F.col("_s") * F.col("_m")), "_sm", "_num", dilation, by)
        df = b3_smooth(df, "_m", "_den", dilation, by)
        smooth = F.when(F.col("_den") > 0, F.col("_num") / F.col("_den")).otherwise(0.0)
        usable = F.col("valid") & (F.col("_den") >= minimum_support)
        df = df.withColumn("_next", smooth).withColumn(f"coefficient_{k}", F.when(usable, F.col("_s") - F.col("_next")))
        df = df.withColumn(f"support_{k}", F.col("_den")).withColumn("_s", F.col("_next")).withColumn("_m", F.col("_den"))
    return df.withColumn("coarse", F.col("_s")).drop("_m", "_s", "_sm", "_num", "_den", "_next")
