"""Celestial positions of pixels: TAN and SIN projections, local Jacobians, sky shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WCS_KEYS = ("CTYPE1", "CTYPE2", "CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CDELT1", "CDELT2")


class Wcs:
    """A celestial header: reference sky and pixel positions, matrix, projection, frame."""

    def __init__(self, header: dict):
        kinds = [str(header.get(f"CTYPE{k}", "")) for k in (1, 2)]
        if not (kinds[0].startswith("RA---") and kinds[1].startswith("DEC--")) or kinds[0][-3:] not in ("TAN", "SIN"):
            raise ValueError(f"projection {kinds} is not supported")
        self.projection = kinds[0][-3:]
        self.frame = str(header.get("RADESYS", "ICRS")).strip()
        if self.frame not in ("ICRS", "FK5"):
            raise ValueError(f"frame {self.frame} is not supported")
        self.sky = np.array([header["CRVAL1"], header["CRVAL2"]], float)
        self.pixel = np.array([header["CRPIX1"], header["CRPIX2"]], float) - 1
        scale = np.array([header.get("CDELT1", 1.0), header.get("CDELT2", 1.0)], float)
        if "CD1_1" in header:
            self.matrix = np.array([[header.get(f"CD{i}_{j}", 0.0) for j in (1, 2)] for i in (1, 2)], float)
        elif "PC1_1" in header:
            self.matrix = scale[:, None] * np.array([[header.get(f"PC{i}_{j}", float(i == j)) for j in (1, 2)] for i in (1, 2)], float)
        else:
            t = np.deg2rad(header.get("CROTA2", 0.0))
            self.matrix = np.array([[scale[0] * np.cos(t), -scale[1] * np.sin(t)], [scale[0] * np.sin(t), scale[1] * np.cos(t)]])
        if not np.isfinite(self.matrix).all() or abs(np.linalg.det(self.matrix)) == 0:
            raise ValueError("the celestial matrix is singular")

    def to_sky(self, x, y) -> tuple[np.ndarray, np.ndarray]:
        """(ra, dec) in degrees of 0-based pixel positions."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        xi, eta = (np.deg2rad(self.matrix[k, 0] * (x - self.pixel[0]) + self.matrix[k, 1] * (y - self.pixel[1])) for k in (0, 1))
        ra0, dec0 = np.deg2rad(self.sky)
        if self.projection == "TAN":
            n = np.cos(dec0) - eta * np.sin(dec0)
            ra = ra0 + np.arctan2(xi, n)
            dec = np.arctan2(np.sin(dec0) + eta * np.cos(dec0), np.hypot(xi, n))
        else:
            z = np.sqrt(np.maximum(1 - xi**2 - eta**2, 0))
            dec = np.arcsin(np.clip(eta * np.cos(dec0) + z * np.sin(dec0), -1, 1))
            ra = ra0 + np.arctan2(xi, z * np.cos(dec0) - eta * np.sin(dec0))
        return np.rad2deg(ra) % 360, np.rad2deg(dec)

    def to_pixel(self, ra, dec) -> tuple[np.ndarray, np.ndarray]:
        """0-based (x, y) of sky positions."""
        a, d = np.deg2rad(np.asarray(ra, float)) - np.deg2rad(self.sky[0]), np.deg2rad(np.asarray(dec, float))
        d0 = np.deg2rad(self.sky[1])
        xi, eta = np.cos(d) * np.sin(a), np.sin(d) * np.cos(d0) - np.cos(d) * np.sin(d0) * np.cos(a)
        if self.projection == "TAN":
            c = np.sin(d) * np.sin(d0) + np.cos(d) * np.cos(d0) * np.cos(a)
            xi, eta = xi / c, eta / c
        inverse = np.linalg.inv(self.matrix)
        xi, eta = np.rad2deg(xi), np.rad2deg(eta)
        return self.pixel[0] + inverse[0, 0] * xi + inverse[0, 1] * eta, self.pixel[1] + inverse[1, 0] * xi + inverse[1, 1] * eta

    def jacobian(self, x, y, step_deg: float = 2 / 3600) -> np.ndarray:
        """d(east, north) / d(x, y) in degrees a pixel, from offsets of two arcseconds about each position."""
        ra, dec = self.to_sky(x, y)
        cos = np.cos(np.deg2rad(dec))
        out = np.empty((len(np.atleast_1d(ra)), 2, 2))
        for k, (de, dn) in enumerate(((step_deg, 0.0), (0.0, step_deg))):
            xa, ya = self.to_pixel(ra + de / cos, dec + dn)
            xb, yb = self.to_pixel(ra - de / cos, dec - dn)
            out[:, 0, k], out[:, 1, k] = (xa - xb) / (2 * step_deg), (ya - yb) / (2 * step_deg)
        return np.linalg.inv(out)

    def pixel_area(self, x, y) -> np.ndarray:
        """Solid angle of a pixel in steradians."""
        return np.abs(np.linalg.det(self.jacobian(x, y))) * np.deg2rad(1) ** 2


def icrs_position_angle_shift(wcs: Wcs, x, y) -> np.ndarray:
    """Rotation of north between the header's frame and ICRS; the two agree to milliarcseconds, so it is zero here."""
    return np.zeros(len(np.atleast_1d(x)))


def sky_position(wcs: Wcs, x: Column, y: Column) -> Column:
    """Struct(ra, dec) of a pixel position, Arrow-batched."""

    @F.pandas_udf("ra double, dec double")
    def run(px: pd.Series, py: pd.Series) -> pd.DataFrame:
        ra, dec = wcs.to_sky(px.to_numpy(), py.to_numpy())
        return pd.DataFrame({"ra": ra, "dec": dec})

    return run(x.cast("double"), y.cast("double"))


def sky_shape(wcs: Wcs, x: Column, y: Column, xx: Column, xy: Column, yy: Column) -> Column:
    """Struct(ee, en, nn): a pixel covariance through the local Jacobian, in square degrees."""

    @F.pandas_udf("ee double, en double, nn double")
    def run(px: pd.Series, py: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        j = wcs.jacobian(px.to_numpy(), py.to_numpy())
        m = np.stack([np.stack([a, b], -1), np.stack([b, c], -1)], -2)
        s = j @ m @ np.swapaxes(j, 1, 2)
        return pd.DataFrame({"ee": s[:, 0, 0], "en": s[:, 0, 1], "nn": s[:, 1, 1]})

    return run(x.cast("double"), y.cast("double"), xx.cast("double"), xy.cast("double"), yy.cast("double"))


def axis_significance(fitted: tuple[float, float, float], errors: tuple[float, float, float], beam: tuple[float, float, float], sigma: float = 1.5) -> tuple[bool, bool]:
    """Whether the deconvolved major and minor axes are over so many of their errors (numeric gradient)."""

    def variances(major, minor, pa):
        def matrix(a, b, t):
            s, c = np.sin(np.deg2rad(t)), np.cos(np.deg2rad(t))
            return np.array([[a * a * s * s + b * b * c * c, (a * a - b * b) * s * c], [(a * a - b * b) * s * c, a * a * c * c + b * b * s * s]])

        return np.sort(np.linalg.eigvalsh(matrix(major, minor, pa) - matrix(*beam)))[::-1]

    at = variances(*fitted)
    spread = np.zeros(2)
    for k, e in enumerate(errors):
        h = max(abs(fitted[k]) * 1e-5, 1e-9)
        up, down = list(fitted), list(fitted)
        up[k], down[k] = up[k] + h, down[k] - h
        spread += ((variances(*up) - variances(*down)) / (2 * h) * e) ** 2
    return tuple(bool(v > sigma * s) for v, s in zip(at, np.sqrt(spread), strict=True))
