"""Matched filters on halo tiles, and the detection rule over scales."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxweave.functions.scalars import BEAM_AREA
from fluxweave.operators.kernels import convolve
from fluxweave.operators.tiling import map_tiles

WIDTHS, TRUNCATION = (1.0, 2.0, 4.0), 4.0


def gaussian_kernel(sigma_1: float, sigma_2: float, angle_deg: float, truncation: float = TRUNCATION) -> np.ndarray:
    """Sampled Gaussian, summing to one."""
    r = int(np.ceil(truncation * max(sigma_1, sigma_2)))
    y, x = np.mgrid[-r : r + 1, -r : r + 1].astype(float)
    t = np.deg2rad(angle_deg)
    u, v = np.cos(t) * x + np.sin(t) * y, np.cos(t) * y - np.sin(t) * x
    k = np.exp(-0.5 * ((u / sigma_1) ** 2 + (v / sigma_2) ** 2))
    return k / k.sum()


def filter_bank(beam: tuple[float, float, float], family: str = "matched") -> list[tuple[np.ndarray, float]]:
    """(kernel, calibration) for each width: a unit source of the nominal size reads one.

    beam is (sigma_1, sigma_2, angle from x in degrees) in pixels. The wavelet family is the
    difference of the widths w / sqrt 2 and w sqrt 2.
    """
    out = []
    for w in WIDTHS:
        if family == "matched":
            k = gaussian_kernel(beam[0] * w, beam[1] * w, beam[2])
        else:
            wide, narrow = (gaussian_kernel(beam[0] * w * f, beam[1] * w * f, beam[2]) for f in (2**0.5, 2**-0.5))
            k = -wide
            pad = (len(wide) - len(narrow)) // 2
            k[pad : pad + len(narrow), pad : pad + len(narrow)] += narrow
        source = gaussian_kernel(beam[0] * w, beam[1] * w, beam[2])
        unit = source / source.max()
        shift = (len(k) - len(unit)) // 2
        peak = float((k[shift : shift + len(unit), shift : shift + len(unit)] * unit).sum()) if shift >= 0 else float((k * unit[-shift : len(unit) + shift, -shift : len(unit) + shift]).sum())
        out.append((k, 1 / peak))
    return out


def matched_filters(pixels: DataFrame, beam: tuple[float, float, float], minimum_support: float = 0.5, core: int = 512, by: Sequence[str] = ()) -> DataFrame:
    """response_k, effective_rms_k, support_k for k = 1, 2, 3 at each pixel(y, x, value, rms); null value is invalid.

    response = calibration conv(v valid) / conv(valid); effective rms = calibration
    sqrt(conv(rms^2 valid, kernel^2)) / conv(valid). Tiles are anchored to the image.
    """
    bank = filter_bank(beam)
    halo = max(len(k) // 2 for k, _ in bank)

    def kernel(planes):
        v, r = planes["value"], planes["rms"]
        ok = np.isfinite(v) & np.isfinite(r)
        v0, r0, m = np.where(ok, v, 0), np.where(ok, r, 0) ** 2, ok.astype(float)
        out = {}
        for n, (k, gain) in enumerate(bank, 1):
            support = convolve(m, k)
            good = ok & (support >= minimum_support)
            with np.errstate(all="ignore"):
                out[f"response_{n}"] = np.where(good, gain * convolve(v0, k) / support, np.nan)
                out[f"effective_rms_{n}"] = np.where(good, gain * np.sqrt(np.maximum(convolve(r0, k * k), 0)) / support, np.nan)
            out[f"support_{n}"] = support
        return out

    names = ", ".join(f"{c}_{n} double" for n in range(1, len(bank) + 1) for c in ("response", "effective_rms", "support"))
    return map_tiles(pixels, kernel, ["value", "rms"], names, core, halo, by)


def scale_snr(response: Column, effective_rms: Column, support: Column, minimum_support: float = 0.5) -> Column:
    """response / effective rms where supported, else null (lower than any threshold)."""
    return F.when((support >= minimum_support) & (effective_rms > 0) & ~F.isnan(response), response / effective_rms)


def noise_gain(kernel: np.ndarray) -> float:
    """Deviation of a kernel's output for independent unit noise."""
    return float(np.sqrt((kernel**2).sum()))


def atrous_gains() -> list[float]:
    """Noise gain of each B3 detail scale for independent unit noise."""
    side = 33
    smooth = np.zeros((side, side))
    smooth[side // 2, side // 2] = 1
    gains = []
    for d in (1, 2, 4):
        taps = np.zeros(4 * d + 1)
        taps[:: d] = np.array([1, 4, 6, 4, 1]) / 16
        nxt = convolve(smooth, np.outer(taps, taps))
        gains.append(noise_gain(smooth - nxt))
        smooth = nxt
    return gains


def denoised(coefficients: Sequence[tuple[Column, Column]], coarse: Column, sigma: float) -> Column:
    """Coarse plane plus the significant signed coefficients: pairs of coefficient and effective rms."""
    total = coarse
    for c, rms in coefficients:
        total = total + F.when(F.abs(c) >= sigma * rms, c).otherwise(0.0)
    return total


def least_pixels(beam_fwhm: tuple[float, float], beams: float = 1.0) -> int:
    """max(1, ceil(beams x area of a beam in pixels))."""
    return max(1, int(np.ceil(beams * BEAM_AREA * beam_fwhm[0] * beam_fwhm[1])))


def detection_rule(labelled: DataFrame, least: int, detection_sigma: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Accepted labels of labelled(label, snr, combined): a seed in the combined S/N, and size or a direct seed."""
    g = labelled.groupBy(*by, "label").agg(F.count("*").alias("n_pixels"), F.max("combined").alias("combined"), F.max("snr").alias("direct"))
    return g.where((F.col("combined") >= detection_sigma) & ((F.col("n_pixels") >= least) | (F.col("direct") >= detection_sigma)))
