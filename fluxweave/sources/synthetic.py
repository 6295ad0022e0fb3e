"""Deterministic synthetic images: noise addressed by pixel, so any partitioning gives the same plane."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit mixer, wrapping."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def standard_normal(address: np.ndarray, seed: int) -> np.ndarray:
    """Box-Muller from two hashes of an address."""
    base = splitmix64(address.astype(np.uint64) ^ splitmix64(np.array([seed], np.uint64)))
    u = [(splitmix64(base + np.uint64(k)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 for k in (1, 2)]
    return np.sqrt(-2 * np.log(np.maximum(u[0], 2.0**-53))) * np.cos(2 * np.pi * u[1])


def image(spark: SparkSession, shape: tuple[int, int], *, seed: int = 1, background: float = 0.0, noise: float = 1.0, gradient: tuple[float, float] = (0.0, 0.0), sources: Sequence[dict] = (), invalid: Sequence[tuple[int, int, int, int]] = ()) -> DataFrame:
    """pixels(y, x, value): background + noise (1 + gradient) N(y, x) + Gaussians; null in invalid boxes (y0, y1, x0, x1).

    sources: x, y, peak, sigma_1, sigma_2, angle (degrees from x).
    """
    h, w = shape

    @F.pandas_udf("double")
    def value(ids: pd.Series) -> pd.Series:
        i = ids.to_numpy(np.int64)
        y, x = i // w, i % w
        v = background + noise * (1 + gradient[0] * (x / max(1, w - 1) - 0.5) + gradient[1] * (y / max(1, h - 1) - 0.5)) * standard_normal(i, seed) if noise else np.full(len(i), float(background))
        for s in sources:
            t = np.deg2rad(s.get("angle", 0.0))
            dx, dy = x - s["x"], y - s["y"]
            u, q = np.cos(t) * dx + np.sin(t) * dy, np.cos(t) * dy - np.sin(t) * dx
            v = v + s["peak"] * np.exp(-0.5 * ((u / s["sigma_1"]) ** 2 + (q / s["sigma_2"]) ** 2))
        for y0, y1, x0, x1 in invalid:
            v = np.where((y >= y0) & (y < y1) & (x >= x0) & (x < x1), np.nan, v)
        return pd.Series(v)

    df = spark.range(h * w).withColumn("v", value("id"))
    return df.select(F.floor(F.col("id") / w).alias("y"), (F.col("id") % w).alias("x"), F.when(~F.isnan("v"), F.col("v")).alias("value"))
