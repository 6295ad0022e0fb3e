"""Measurements of labelled pixels: moments, island and segment rows, catalogue projections.

All are algebraic aggregates (partial before the shuffle), so an object that spans many
tiles is never gathered in one place. Second moments use a common origin per object taken
from its bounds, which keeps the sums well conditioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.functions.scalars import FWHM, compatibility_major, quadrature_error


def moments(pixels: DataFrame, pixel_sr: float, beam_sr: float, least_shape: int = 3, tolerance: float = 1e-12, by: Sequence[str] = ()) -> DataFrame:
    """Per label of pixels(y, x, label, residual, rms): photometry, centroid, covariance, ellipse and the reason where absent."""
    keys = [*by, "label"]
    w = F.col("residual")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    first = pixels.groupBy(*keys).agg(
        F.count("*").alias("n_pixels"), F.bool_or(bad("residual") | bad("rms")).alias("_bad"), F.bool_or((w <= 0) | (F.col("rms") <= 0)).alias("_low"),
        F.sum("residual").alias("_s"), F.sum(w * F.col("x")).alias("_sx"), F.sum(w * F.col("y")).alias("_sy"),
        F.max("residual").alias("peak"), F.max_by(F.struct("y", "x"), F.struct("residual", -F.col("y"), -F.col("x"))).alias("peak_at"), F.avg("rms").alias("local_rms"),
    )
    centred = first.withColumn("centroid_x", F.col("_sx") / F.nullif("_s", F.lit(0.0))).withColumn("centroid_y", F.col("_sy") / F.nullif("_s", F.lit(0.0)))
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    spread = (
        pixels.join(centred.select(*keys, F.col("centroid_x").alias("_cx"), F.col("centroid_y").alias("_cy")), keys)
        .groupBy(*keys)
        .agg(F.sum(w * dx * dx).alias("_xx"), F.sum(w * dx * dy).alias("_xy"), F.sum(w * dy * dy).alias("_yy"))
    )
    both = centred.join(spread, keys)
    for c in ("xx", "xy", "yy"):
        both = both.withColumn(c, F.col(f"_{c}") / F.nullif("_s", F.lit(0.0)))
    half = F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) + 4 * F.col("xy") * F.col("xy"))
    both = both.withColumn("_d", half).withColumn("_t", F.col("xx") + F.col("yy"))
    major, minor = (F.col("_t") + F.col("_d")) / 2, (F.col("_t") - F.col("_d")) / 2
    reason = (
        F.when(F.col("_bad"), "non-finite-owned-pixels")
        .when(F.col("_low") | (F.col("_s") <= 0), "non-positive-measurement")
        .when(F.col("n_pixels") < least_shape, "underdetermined-region")
        .when((major <= 0) | (minor <= tolerance * major), "singular-covariance")
    )
    angle = F.when(F.col("_d") <= tolerance * F.col("_t"), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2), F.lit(180.0)))
    both = both.withColumn("reason", reason)
    seen, shaped = F.coalesce(~F.col("reason").isin("non-finite-owned-pixels", "non-positive-measurement"), F.lit(True)), F.col("reason").isNull()
    return both.select(
        *keys, "n_pixels", "reason",
        F.when(seen, F.col("peak")).alias("peak"), F.when(seen, F.col("peak_at")).alias("peak_at"), F.when(seen, F.col("local_rms")).alias("local_rms"),
        F.when(seen, F.col("_s") * (pixel_sr / beam_sr)).alias("flux"), F.when(seen, F.col("_s") / F.col("n_pixels")).alias("mean_brightness"),
        *[F.when(shaped, F.col(c)).alias(c) for c in ("centroid_x", "centroid_y", "xx", "xy", "yy")],
        F.when(shaped, F.sqrt(major)).alias("sigma_1"), F.when(shaped, F.sqrt(F.greatest(minor, F.lit(0.0)))).alias("sigma_2"), F.when(shaped, angle).alias("angle"),
    )


def positive_moments(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Centroid and covariance weighted by the positive residual only."""
    keys = [*by, "label"]
    w = F.greatest(F.col("residual"), F.lit(0.0))
    s = pixels.groupBy(*keys).agg(F.sum(w).alias("_s"), *[F.sum(w * e).alias(n) for n, e in (("_x", F.col("x")), ("_y", F.col("y")))])
    c = s.where("_s > 0").select(*keys, "_s", (F.col("_x") / F.col("_s")).alias("centroid_x"), (F.col("_y") / F.col("_s")).alias("centroid_y"))
    dx, dy = F.col("x") - F.col("centroid_x"), F.col("y") - F.col("centroid_y")
    joined = pixels.join(c, keys)
    return joined.groupBy(*keys, "centroid_x", "centroid_y").agg(*[(F.sum(w * e) / F.first("_s")).alias(n) for n, e in (("xx", dx * dx), ("xy", dx * dy), ("yy", dy * dy))])


def segment_position(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Signed centroid of each label and its first maximum; unavailable if the weight is not positive, ill-conditioned or outside the support's box."""
    keys = [*by, "label"]
    w = F.col("residual")
    s = pixels.groupBy(*keys).agg(
        F.sum(w).alias("_s"), F.sum(F.abs(w)).alias("_a"), F.sum(w * F.col("x")).alias("_x"), F.sum(w * F.col("y")).alias("_y"), F.min("x").alias("_x0"), F.max("x").alias("_x1"),
        F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.max_by(F.struct("y", "x"), F.struct("residual", -F.col("y"), -F.col("x"))).alias("peak_at"), F.max("residual").alias("peak"), F.count("*").alias("_n"),
    )
    cx, cy = F.col("_x") / F.nullif("_s", F.lit(0.0)), F.col("_y") / F.nullif("_s", F.lit(0.0))
    slack = 1e-9  # rounding of a weighted mean
    ok = (F.col("_s") > 0) & (F.col("_s") > 2.0**-40 * F.col("_n") * F.col("_a")) & cx.between(F.col("_x0") - slack, F.col("_x1") + slack) & cy.between(F.col("_y0") - slack, F.col("_y1") + slack)
    return s.select(*keys, F.when(ok, cx).alias("centroid_x"), F.when(ok, cy).alias("centroid_y"), F.coalesce(ok, F.lit(False)).alias("available"), "peak", "peak_at")


def segment_rows(owned: DataFrame, apertures: DataFrame, beam_area: float, by: Sequence[str] = ()) -> DataFrame:
    """Catalogue rows of segments: position and peak from owned pixels, flux from the aperture.

    owned and apertures: (y, x, label, residual). A flux that is not positive falls back to
    the positive owned residual with flags; still not positive, or without a position, no row.
    """
    keys = [*by, "label"]
    place = segment_position(owned, by)
    own = owned.groupBy(*keys).agg(F.sum(F.greatest("residual", F.lit(0.0))).alias("_own"))
    flux = apertures.groupBy(*keys).agg(F.sum("residual").alias("_ap"))
    rows = place.where("available").join(own, keys).join(flux, keys, "left")
    signed = F.coalesce(F.col("_ap") > 0, F.lit(False))
    flags = F.when(signed, F.array(F.lit("source-owned-signed-aperture"))).otherwise(
        F.array(F.lit("association-aperture-nonpositive"), F.lit("exact-owner-positive-residual-flux"), F.lit("positive-exact-owner-flux"))
    )
    fixed = F.array(F.lit("aperture-flux-uncertainty-unavailable"), F.lit("position-uncertainty-unavailable"))
    out = rows.select(*keys, "centroid_x", "centroid_y", "peak", (F.when(signed, F.col("_ap")).otherwise(F.col("_own")) / beam_area).alias("flux"), F.array_sort(F.array_distinct(F.concat(flags, fixed))).alias("flags"))
    return out.where("flux > 0")


def local_rms(pixels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median of the finite positive RMS over each label."""
    ok = pixels.where((F.col("rms") > 0) & (F.col("rms") < float("inf")))
    return ok.groupBy(*by, "label").agg(F.median("rms").alias("local_rms"))


def island_rows(pixels: DataFrame, beam_area: float, by: Sequence[str] = ()) -> DataFrame:
    """Per island: pixel count, signed flux, median RMS, mean brightness, identifier of the first pixel."""
    g = pixels.groupBy(*by, "label").agg(
        F.count("*").alias("n_pixels"), (F.sum("residual") / beam_area).alias("flux"), F.median("rms").alias("local_rms"), F.avg("residual").alias("mean_brightness"), F.min(F.struct("y", "x")).alias("_f")
    )
    return g.withColumn("island_id", F.format_string("island-detection-%d-%d", F.col("_f.y"), F.col("_f.x"))).drop("_f")


def component_records(pixels: DataFrame, namespace: str, by: Sequence[str] = ()) -> DataFrame:
    """Stable identity of each label from its pixels, in any order: their number and two exclusive ors of 60 hash bits; with the positive-signal moments."""
    digest = F.md5(F.concat_ws(",", F.col("y").cast("string"), F.col("x").cast("string")))
    part = lambda at: F.bit_xor(F.conv(F.substring("_digest", at, 15), 16, 10).cast("long")).cast("string")
    name = F.concat_ws(",", F.lit(namespace), F.count("*").cast("string"), part(1), part(16))
    ids = pixels.withColumn("_digest", digest).groupBy(*by, "label").agg(F.sha2(name, 256).alias("record_id"))
    return ids.join(positive_moments(pixels, by), [*by, "label"], "left")


def summed_flux(components: DataFrame, key: str) -> DataFrame:
    """Sum of fitted fluxes; the error is in quadrature only if every component has one."""
    return components.groupBy(key).agg(F.sum("flux").alias("flux"), quadrature_error(F.col("flux_error"), F.count("*")).alias("flux_error"), F.count("*").alias("n_components"))


def source_rows(apertures: DataFrame, components: DataFrame) -> DataFrame:
    """A source with one fitted component publishes that Gaussian; any other its aperture row.

    apertures(source_id, flux, ...), components(source_id, component_id, flux, flux_error, major, minor, angle).
    The flux of several is the sum of theirs; without any the aperture's, flagged. Shapes are withheld.
    """
    many = summed_flux(components, "source_id").withColumnRenamed("flux", "_sum").withColumnRenamed("flux_error", "_err")
    w = Window.partitionBy("source_id").orderBy("component_id")
    one = components.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("source_id", "major", "minor", "angle")
    rows = apertures.withColumnRenamed("flux", "_ap").join(many, "source_id", "left").join(one, "source_id", "left")
    single = F.coalesce(F.col("n_components") == 1, F.lit(False))
    return rows.select(
        "source_id",
        F.coalesce("_sum", "_ap").alias("flux"),
        F.col("_err").alias("flux_error"),
        *[F.when(single, F.col(c)).alias(c) for c in ("major", "minor", "angle")],
        F.coalesce("n_components", F.lit(0)).alias("n_components"),
        F.when(F.col("_sum").isNull(), F.array(F.lit("aperture-flux-without-fitted-component"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )


def publishable(fitted: Column, aperture_flux: Column, require_signed: bool = True) -> Column:
    """A row is published with a fit, or with a positive aperture."""
    ok = fitted | (F.coalesce(aperture_flux, F.lit(0.0)) > 0)
    return ok if require_signed else ok | aperture_flux.isNotNull()


def compatibility_view(sources: DataFrame, islands: DataFrame) -> DataFrame:
    """Eight columns of the workflow's catalogue: sources with their islands' flux (null without one), numbered from 0 by identifier.

    sources(source_id, island_id, ra, dec, ra_error, dec_error, flux, full_major, axis_major, flags).
    """
    w = Window.orderBy("source_id")
    return sources.join(islands.select("island_id", F.col("flux").alias("island_flux")), "island_id", "left").select(
        (F.row_number().over(w) - 1).cast("int").alias("Source_id"), F.col("ra").alias("RA"), F.col("dec").alias("DEC"), F.col("island_flux").alias("Isl_Total_flux"), F.col("flux").alias("Total_flux"),
        compatibility_major(F.col("full_major"), F.col("axis_major"), F.col("flags")).alias("DC_Maj"), F.col("ra_error").alias("E_RA"), F.col("dec_error").alias("E_DEC"),
    )


def dispositions(found: DataFrame, published: DataFrame) -> DataFrame:
    """Every identity of either side with what became of it (full outer join)."""
    joined = found.select("id").withColumn("_f", F.lit(True)).join(published.select("id").withColumn("_p", F.lit(True)), "id", "full")
    state = F.when(F.col("_p") & F.col("_f"), "published").when(F.col("_f"), "withheld").otherwise("unexpected")
    return joined.select("id", F.coalesce(state, F.lit("unexpected")).alias("disposition"))


def sky_model_lines(sources: DataFrame, frequency: float) -> DataFrame:
    """Text lines of a sky model: name, POINT, position, flux, reference frequency."""
    from fluxweave.functions.scalars import declination_text, right_ascension_text

    line = F.concat_ws(", ", F.col("name"), F.lit("POINT"), right_ascension_text(F.col("ra")), declination_text(F.col("dec")), F.format_string("%.6f", F.col("flux")), F.lit(f"{frequency:.1f}"))
    return sources.select(line.alias("line"))


#: FWHM of a unit Gaussian, for shapes in pixels.
SIGMA_TO_FWHM = FWHM
