"""Column functions: areas, fluxes, separations, identifiers, text, intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FWHM = 2 * math.sqrt(2 * math.log(2))  # of a Gaussian of unit sigma
BEAM_AREA = math.pi / (4 * math.log(2))  # of a beam of unit FWHM on both axes


def beam_solid_angle(major_deg: Column, minor_deg: Column) -> Column:
    """Steradians of a Gaussian beam: pi maj min / (4 ln 2)."""
    return BEAM_AREA * F.radians(major_deg) * F.radians(minor_deg)


def gaussian_flux(amplitude: Column, sigma_1: Column, sigma_2: Column, pixel_sr: Column, beam_sr: Column) -> Column:
    """Integrated flux of a fitted Gaussian: A 2 pi s1 s2 pixel / beam."""
    return amplitude * (2 * math.pi) * sigma_1 * sigma_2 * pixel_sr / beam_sr


def least_island_pixels(major_px: Column, minor_px: Column, beams: float = 1.0) -> Column:
    """max(1, ceil(beams x 1.1331 x major x minor)): pixels in so many beam areas."""
    return F.greatest(F.lit(1), F.ceil(beams * BEAM_AREA * major_px * minor_px)).cast("long")


def least_island_pixels_external(beam_area_px: Column) -> Column:
    """max(6, int(area / 3)), the established finder's rule."""
    return F.greatest(F.lit(6), (beam_area_px / 3).cast("long")).cast("long")


def haversine(ra_1: Column, dec_1: Column, ra_2: Column, dec_2: Column) -> Column:
    """Great-circle separation in degrees, clipped against rounding."""
    a, b = F.radians(dec_1), F.radians(dec_2)
    s, t = F.sin((b - a) / 2), F.sin(F.radians(ra_2 - ra_1) / 2)
    h = s * s + F.cos(a) * F.cos(b) * t * t
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def stable_id(namespace: str, prefix: str, *values: Column) -> Column:
    """prefix-<sha256> over the namespace and each value followed by a NUL."""
    parts = [F.lit(namespace)]
    for v in values:
        parts += [v.cast("string"), F.decode(F.unhex(F.lit("00")), "UTF-8")]
    return F.concat(F.lit(f"{prefix}-"), F.sha2(F.concat(*parts), 256))


def detection_island_id(y: Column, x: Column) -> Column:
    """island-detection-{y}-{x} of the first pixel."""
    return F.concat(F.lit("island-detection-"), y.cast("string"), F.lit("-"), x.cast("string"))


def optional_float(value: Column) -> Column:
    """NaN becomes null; missing values are null inside the engine."""
    return F.when(~F.isnan(value), value)


def _sexagesimal(total: Column, separators: tuple[str, str], places: int) -> Column:
    """Units, minutes and seconds of a non-negative number of units, rounded once so that 60 never shows."""
    scale = 10**places
    ticks = F.round(total * 3600 * scale).cast("long")
    seconds = ticks % (60 * scale)
    minute, unit = F.floor(ticks / (60 * scale)) % 60, F.floor(ticks / (3600 * scale))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    fraction = F.lpad((seconds % scale).cast("string"), places, "0")
    return F.concat(two(unit), F.lit(separators[0]), two(minute), F.lit(separators[1]), two(F.floor(seconds / scale)), F.lit("."), fraction)


def right_ascension_text(ra_deg: Column) -> Column:
    """hh:mm:ss.ssssss"""
    return _sexagesimal(F.pmod(ra_deg, F.lit(360.0)) / 15, (":", ":"), 6)


def declination_text(dec_deg: Column) -> Column:
    """+dd.mm.ss.ssssss"""
    return F.concat(F.when(dec_deg < 0, F.lit("-")).otherwise(F.lit("+")), _sexagesimal(F.abs(dec_deg), (".", "."), 6))


def flag_jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over size of the union of two flag sets; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def wilson_interval(successes: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of a share; null without trials."""
    p = successes / F.nullif(total, F.lit(0))
    centre = (p + z * z / (2 * total)) / (1 + z * z / total)
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def quadrature_error(errors: Column, count: Column) -> Column:
    """Root of the summed squares (aggregate), only if every row has an error."""
    return F.when(F.count(errors) == count, F.sqrt(F.sum(errors * errors)))


def position_angle_difference(a: Column, b: Column) -> Column:
    """Smallest difference of two axes' angles in degrees, 0 to 90."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


# --- ellipses ----------------------------------------------------------------------------


def pixel_covariance(sigma_1: Column, sigma_2: Column, angle_deg: Column) -> tuple[Column, Column, Column]:
    """(xx, xy, yy) of an ellipse with its major axis at an angle from x."""
    c, s = F.cos(F.radians(angle_deg)), F.sin(F.radians(angle_deg))
    a, b = sigma_1 * sigma_1, sigma_2 * sigma_2
    return a * c * c + b * s * s, (a - b) * s * c, a * s * s + b * c * c


def sky_covariance(major_fwhm: Column, minor_fwhm: Column, pa_deg: Column) -> tuple[Column, Column, Column]:
    """(east-east, east-north, north-north) of an ellipse with position angle from north to east."""
    s, c = F.sin(F.radians(pa_deg)), F.cos(F.radians(pa_deg))
    a, b = (major_fwhm / FWHM) * (major_fwhm / FWHM), (minor_fwhm / FWHM) * (minor_fwhm / FWHM)
    return a * s * s + b * c * c, (a - b) * s * c, a * c * c + b * s * s


def ellipse_of(ee: Column, en: Column, nn: Column) -> tuple[Column, Column, Column]:
    """(major FWHM, minor FWHM, position angle) of a sky covariance: closed 2 x 2 eigenvalues; a circle has angle 0."""
    mean, half = (ee + nn) / 2, F.sqrt(((nn - ee) / 2) * ((nn - ee) / 2) + en * en)
    angle = F.when(half <= 1e-12 * mean, F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(2 * en, nn - ee) / 2), F.lit(180.0)))
    return FWHM * F.sqrt(F.greatest(mean + half, F.lit(0.0))), FWHM * F.sqrt(F.greatest(mean - half, F.lit(0.0))), angle


def deconvolve(fitted: tuple[Column, Column, Column], beam: tuple[Column, Column, Column], tolerance: float = 1e-6) -> Column:
    """Struct(state, major, minor, angle): the fitted covariance less the beam's.

    resolved, major-axis-only (minor variance within tolerance of the beam's) or unresolved.
    """
    f, b = sky_covariance(*fitted), sky_covariance(*beam)
    ee, en, nn = (x - y for x, y in zip(f, b, strict=True))
    mean, half = (ee + nn) / 2, F.sqrt(((nn - ee) / 2) * ((nn - ee) / 2) + en * en)
    floor = tolerance * (f[0] + f[2])
    major, minor, angle = ellipse_of(ee, en, nn)
    state = F.when(mean + half <= floor, "unresolved").when(mean - half <= floor, "major-axis-only").otherwise("resolved")
    none = F.lit(None).cast("double")
    return F.struct(
        state.alias("state"),
        F.when(state != "unresolved", major).otherwise(none).alias("major"),
        F.when(state == "resolved", minor).otherwise(none).alias("minor"),
        F.when(state != "unresolved", angle).otherwise(none).alias("angle"),
    )


def extended(total: Column, total_error: Column, peak: Column, peak_error: Column, sigma: float = 5.0) -> Column:
    """ln(total / peak) over so many of its errors."""
    error = F.sqrt((total_error / total) * (total_error / total) + (peak_error / peak) * (peak_error / peak))
    return F.when((total > 0) & (peak > 0), F.log(total / peak) > sigma * error).otherwise(F.lit(False))


def compatibility_major(full: Column, axis_only: Column, flags: Column) -> Column:
    """Deconvolved major axis of the compatibility view: full, else the one axis, else 0 when unresolved, else NaN."""
    return F.coalesce(full, axis_only, F.when(F.array_contains(flags, "unresolved"), F.lit(0.0)), F.lit(float("nan")))


# --- admission predicates -----------------------------------------------------------------


def deferred_parent(n_pixels: Column, box_area: Column, most_pixels: int = 100_000, most_area: int = 250_000) -> Column:
    """A parent over either bound waits for its own treatment."""
    return (n_pixels > most_pixels) | (box_area > most_area)


def joint_fit_admitted(components: Column, n_pixels: Column, most_parameters: int = 96, most_elements: int = 1_000_000) -> Column:
    """Six parameters for each component, and the Jacobian's size, within bounds."""
    return (6 * components <= most_parameters) & (6 * components * n_pixels <= most_elements)


def free_fit_preferred(chi2_free: Column, chi2_fixed: Column, n_pixels: Column, beam_area: Column, k_free: Column, k_fixed: Column) -> Column:
    """Bayesian information criterion with independent samples counted in beams."""
    n = F.greatest(F.lit(1.0), n_pixels / beam_area)
    return chi2_free / beam_area + k_free * F.log(n) < chi2_fixed / beam_area + k_fixed * F.log(n)
