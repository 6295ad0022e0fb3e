"""Joint Gaussian fits by bounded least squares (projected Levenberg-Marquardt, analytic Jacobian).

A component is amplitude, x, y, two sigmas and an angle, or amplitude, x, y with the beam's
shape. The residuals are (model - value) / rms. A free fit that does not converge, ends at a
bound, is ill-conditioned or is not extended falls back to the beam's shape, unless the
information criterion keeps it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.runtime import cut

ROUNDS, TOLERANCE, CONDITION = 300, 1e-8, 1e8
SIGMAS, AMPLITUDE, MARGIN, EXTENSION = (0.2, 30.0), 5.0, 1.0, 5.0


def gaussian(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Model of one component and its derivatives by (A, x, y, s1, s2, angle)."""
    a, cx, cy, s1, s2, t = p
    c, s = np.cos(t), np.sin(t)
    dx, dy = x - cx, y - cy
    u, v = c * dx + s * dy, c * dy - s * dx
    e = np.exp(-0.5 * ((u / s1) ** 2 + (v / s2) ** 2))
    m = a * e
    gu, gv = u / s1**2, v / s2**2
    return m, np.column_stack([e, m * (gu * c - gv * s), m * (gu * s + gv * c), m * u**2 / s1**3, m * v**2 / s2**3, m * (gv * u - gu * v)])


def mixture(p: np.ndarray, x: np.ndarray, y: np.ndarray, shape: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of components; with a shape (s1, s2, angle) only amplitude and centre are free."""
    width = 6 if shape is None else 3
    total, columns = np.zeros(len(x)), []
    for k in range(0, len(p), width):
        full = p[k : k + 6] if shape is None else np.concatenate([p[k : k + 3], shape])
        m, j = gaussian(full, x, y)
        total += m
        columns.append(j[:, :width])
    return total, np.hstack(columns)


def least_squares(start: np.ndarray, low: np.ndarray, high: np.ndarray, x, y, value, rms, shape) -> tuple[np.ndarray, float, bool, np.ndarray]:
    """(parameters, chi squared, converged, Jacobian / rms), steps kept inside the bounds."""
    p, damp = np.clip(start, low, high), 1e-3

    def at(q):
        m, j = mixture(q, x, y, shape)
        return (m - value) / rms, j / rms[:, None]

    r, j = at(p)
    cost = float(r @ r)
    for _ in range(ROUNDS):
        g, h = j.T @ r, j.T @ j
        held = ((p <= low) & (g > 0)) | ((p >= high) & (g < 0))
        free = ~held
        if not free.any() or np.abs(g[free]).max() <= TOLERANCE * max(1.0, cost):
            return p, cost, True, j
        moved = False
        while damp < 1e12:
            hf = h[np.ix_(free, free)]
            step = np.zeros(len(p))
            step[free] = np.linalg.lstsq(hf + damp * np.diag(np.maximum(np.diag(hf), 1e-30)), -g[free], rcond=None)[0]
            q = np.clip(p + step, low, high)
            rq, jq = at(q)
            new = float(rq @ rq)
            if np.isfinite(new) and new < cost:
                small = cost - new <= TOLERANCE * cost and np.abs(q - p).max() <= TOLERANCE * (np.abs(p).max() + TOLERANCE)
                p, r, j, cost, damp, moved = q, rq, jq, new, max(damp / 5, 1e-12), True
                if small:
                    return p, cost, True, j
                break
            damp *= 4
        if not moved:
            return p, cost, True, j
    return p, cost, False, j


def covariance(j: np.ndarray, x: np.ndarray, y: np.ndarray, noise: np.ndarray | None) -> np.ndarray:
    """Parameter covariance; a sandwich with the noise's correlation when its 2 x 2 covariance is known."""
    inverse = np.linalg.pinv(j.T @ j)
    if noise is None:
        return inverse
    dx, dy = x[:, None] - x[None, :], y[:, None] - y[None, :]
    k = np.linalg.inv(noise)
    rho = np.exp(-0.25 * (k[0, 0] * dx * dx + 2 * k[0, 1] * dx * dy + k[1, 1] * dy * dy))
    return inverse @ (j.T @ rho @ j) @ inverse


def bilinear(plane_y, plane_x, value, cy: float, cx: float) -> float | None:
    """Value at a position from its four pixels, if all are there."""
    at = {(int(a), int(b)): v for a, b, v in zip(plane_y, plane_x, value, strict=True)}
    y0, x0 = int(np.floor(cy)), int(np.floor(cx))
    fy, fx = cy - y0, cx - x0
    total = 0.0
    for a, wy in ((y0, 1 - fy), (y0 + 1, fy)):
        for b, wx in ((x0, 1 - fx), (x0 + 1, fx)):
            if wy * wx:
                v = at.get((a, b))
                if v is None or not np.isfinite(v):
                    return None
                total += wy * wx * v
    return total


def fit_object(y, x, region, value, rms, beam: tuple[float, float, float], noise: np.ndarray | None = None) -> pd.DataFrame:
    """Rows of one parent's regions: parameters in pixels, errors, model kind and the reason when there is none."""
    ids = np.unique(region)
    shape = np.array([beam[0], beam[1], np.deg2rad(beam[2])])
    beam_area = 2 * np.pi * beam[0] * beam[1]
    columns = ["region", "amplitude", "cx", "cy", "sigma_1", "sigma_2", "angle", "amplitude_error", "cx_error", "cy_error", "model", "reason", "chi2", "rms"]
    none = lambda why: pd.DataFrame([(k, *[np.nan] * 9, None, why, np.nan, np.nan) for k in ids], columns=columns)
    if not (np.isfinite(value).all() and np.isfinite(rms).all() and (rms > 0).all()):
        return none("non-finite-owned-pixels")
    if 6 * len(ids) > 96 or 6 * len(ids) * len(value) > 1_000_000:
        return none("joint-fit-bound")
    start, low, high = [], [], []
    for k in ids:
        mine = region == k
        v, px, py = np.maximum(value[mine], 0), x[mine], y[mine]
        if v.sum() <= 0:
            return none("non-positive-measurement")
        cx, cy = (v * px).sum() / v.sum(), (v * py).sum() / v.sum()
        xx, yy, xy = ((v * a * b).sum() / v.sum() for a, b in ((px - cx, px - cx), (py - cy, py - cy), (px - cx, py - cy)))
        half = np.hypot(xx - yy, 2 * xy)
        s1, s2 = np.sqrt(max((xx + yy + half) / 2, 0.1)), np.sqrt(max((xx + yy - half) / 2, 0.1))
        t = 0.5 * np.arctan2(2 * xy, xx - yy)
        start.append([value[mine].max(), cx, cy, s1, s2, t])
        low.append([np.finfo(float).tiny, px.min() - 0.5 - MARGIN, py.min() - 0.5 - MARGIN, SIGMAS[0], SIGMAS[0], t - np.pi])
        high.append([value.max() * AMPLITUDE, px.max() + 0.5 + MARGIN, py.max() + 0.5 + MARGIN, SIGMAS[1], SIGMAS[1], t + np.pi])
    s, lo, hi = (np.array(a) for a in (start, low, high))
    chosen = None
    if len(value) > 6 * len(ids):
        p, c2, ok, j = least_squares(s.ravel(), lo.ravel(), hi.ravel(), x, y, value, rms, None)
        q = p.reshape(-1, 6)
        inner = ((q[:, 3:5] > SIGMAS[0] * 1.001) & (q[:, 3:5] < SIGMAS[1] * 0.999)).all() and (q[:, 0] < hi[:, 0] * 0.999).all()
        scaled = j / np.maximum(np.linalg.norm(j, axis=0), 1e-300)
        if ok and inner and np.linalg.cond(scaled) <= CONDITION:
            chosen = ("free", p, c2, j)
    if len(value) > 3 * len(ids):
        p3, c3, ok3, j3 = least_squares(s[:, :3].ravel(), lo[:, :3].ravel(), hi[:, :3].ravel(), x, y, value, rms, shape)
        if chosen is not None:
            q = chosen[1].reshape(-1, 6)
            error = np.sqrt(np.maximum(np.diag(covariance(chosen[3], x, y, noise)), 0)).reshape(-1, 6)
            ratio = np.log(q[:, 3] * q[:, 4] / (beam[0] * beam[1]))
            spread = np.hypot(error[:, 3] / q[:, 3], error[:, 4] / q[:, 4])
            n = max(1.0, len(value) / beam_area)
            better = chosen[2] / beam_area + 6 * len(ids) * np.log(n) < c3 / beam_area + 3 * len(ids) * np.log(n)
            if not ((ratio > EXTENSION * spread).all() or better):
                chosen = None
        if chosen is None and ok3:
            full = np.hstack([p3.reshape(-1, 3), np.tile(shape, (len(ids), 1))])
            chosen = ("beam", full.ravel(), c3, j3)
    if chosen is None:
        return none("no-acceptable-fit" if len(value) > 3 * len(ids) else "underdetermined-region")
    kind, p, c2, j = chosen
    q = p.reshape(-1, 6)
    error = np.sqrt(np.maximum(np.diag(covariance(j, x, y, noise)), 0)).reshape(len(ids), -1)
    rows = []
    for k, label in enumerate(ids):
        a, cx, cy, s1, s2, t = q[k]
        if s2 > s1:
            s1, s2, t = s2, s1, t + np.pi / 2
        rows.append((label, a, cx, cy, s1, s2, np.rad2deg(t) % 180, *error[k, :3], kind, None, c2, bilinear(y, x, rms, cy, cx)))
    return pd.DataFrame(rows, columns=columns)


def fit_parents(pixels: DataFrame, beam: tuple[float, float, float], by: Sequence[str] = (), noise: list[list[float]] | None = None) -> DataFrame:
    """Joint fits of pixels(y, x, parent, region, value, rms), a group for each parent."""
    keys = [*by, "parent"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pixels.schema.fields if f.name in keys)
    matrix = None if noise is None else np.array(noise)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        columns = [pdf[c].to_numpy(np.float64) for c in ("y", "x", "value", "rms")]
        out = fit_object(columns[0], columns[1], pdf["region"].to_numpy(), columns[2], columns[3], beam, matrix)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    out = f"{types}, region long, amplitude double, cx double, cy double, sigma_1 double, sigma_2 double, angle double, amplitude_error double, cx_error double, cy_error double, model string, reason string, chi2 double, rms double"
    return pixels.select(*keys, "y", "x", "region", "value", "rms").groupBy(*keys).applyInPandas(run, out)


def touching_models(fits: DataFrame, reach: float) -> DataFrame:
    """Pairs of components whose half-maximum ellipses meet along their separation: fits(id, cx, cy, sigma_1, sigma_2, angle).

    Components meet through cells of `reach` pixels (at least the largest possible distance). Both
    sides grow, so they are merged; circles around the ellipses rule out most pairs first.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    turned = fits.withColumn("_cos", F.cos(F.radians("angle"))).withColumn("_sin", F.sin(F.radians("angle"))).withColumn("_far", F.greatest(F.abs("sigma_1"), F.abs("sigma_2")))
    side = lambda p: turned.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "cx", "cy", "sigma_1", "sigma_2", "_cos", "_sin", "_far")])
    a = side("a").withColumn("_x", F.explode(F.array(*[cell("a_cx") + k for k in (-1, 0, 1)]))).withColumn("_y", F.explode(F.array(*[cell("a_cy") + k for k in (-1, 0, 1)])))
    b = side("b").withColumn("_x", cell("b_cx")).withColumn("_y", cell("b_cy"))
    dx, dy = F.col("b_cx") - F.col("a_cx"), F.col("b_cy") - F.col("a_cy")
    d = F.sqrt(dx * dx + dy * dy)

    def along(p: str):
        c, s = F.col(f"{p}__cos"), F.col(f"{p}__sin")
        u, v = c * dx + s * dy, c * dy - s * dx
        inverse = (u / F.col(f"{p}_sigma_1")) * (u / F.col(f"{p}_sigma_1")) + (v / F.col(f"{p}_sigma_2")) * (v / F.col(f"{p}_sigma_2"))
        return F.when(d > 0, d / F.sqrt(F.nullif(inverse, F.lit(0.0)))).otherwise(F.col(f"{p}_sigma_1"))

    half = float(np.sqrt(2 * np.log(2)))
    near = d <= half * (F.col("a__far") + F.col("b__far")) * (1 + 1e-9)
    return a.join(b.hint("merge"), ["_x", "_y"]).where((F.col("a_id") < F.col("b_id")) & near & (d <= half * (along("a") + along("b")))).select("a_id", "b_id")


def touching_classes(fits: DataFrame, reach: float) -> DataFrame:
    """Touching pairs with copies told once: (a_id, b_id, copy), of fits(id, cx, cy, sigma_1, sigma_2, angle).

    Equal models are a class, named by its smallest id. A row with `copy` says that b_id is in the class
    a_id; the others are touching classes. All models of one class touch each other, and those of touching classes
    do, so every pair follows from these rows. Models with a null, or a width below zero, are in no class but their own.
    """
    shape = ["cx", "cy", "sigma_1", "sigma_2", "angle"]
    alike = fits.select("id", *shape).withColumn("_low", F.min("id").over(Window.partitionBy(*shape)))
    whole = F.col("sigma_1") >= 0
    for c in shape:
        whole = whole & F.col(c).isNotNull()
    named = cut(alike.withColumn("_class", F.when(whole, F.col("_low")).otherwise(F.col("id"))), "classes")
    members = named.where("_class <> id").select(F.col("_class").alias("a_id"), F.col("id").alias("b_id"), F.lit(True).alias("copy"))
    return members.unionByName(touching_models(named.where("_class = id").select("id", *shape), reach).withColumn("copy", F.lit(False)))
