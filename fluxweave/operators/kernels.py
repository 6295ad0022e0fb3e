"""NumPy kernels that run inside grouped operators. SciPy is not required."""

from __future__ import annotations

import numpy as np

STRIDE = np.int64(1) << 32  # one row's width in a linear pixel id


def linear(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-major pixel id; its order is the raster order for any image of x < 2**32."""
    return y.astype(np.int64) * STRIDE + x.astype(np.int64)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over edges a-b, by hooking and pointer jumping."""
    parent = np.arange(n)
    while len(a):
        pa, pb = parent[a], parent[b]
        open_ = pa != pb
        if not open_.any():
            break
        a, b, pa, pb = a[open_], b[open_], pa[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def touching(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of 8-connected points."""
    ids = linear(y, x)
    order = np.argsort(ids)
    ids = ids[order]
    left, right = [], []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        want = ids + dy * STRIDE + dx
        at = np.searchsorted(ids, want)
        at[at == len(ids)] = 0
        hit = np.flatnonzero(ids[at] == want) if len(ids) else np.zeros(0, np.int64)
        left.append(order[hit])
        right.append(order[at[hit]])
    return np.concatenate(left), np.concatenate(right)


def label_points(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each point the raster-first pixel id of its 8-connected region."""
    if not len(y):
        return np.zeros(0, np.int64)
    ids = linear(y, x)
    order = np.argsort(ids)
    a, b = touching(y[order], x[order])
    root = components(len(ids), a, b)
    out = np.empty(len(ids), np.int64)
    out[order] = ids[order][root]
    return out


def label_plane(mask: np.ndarray) -> np.ndarray:
    """Labels 1.. in raster order of each region's first pixel, 0 outside."""
    y, x = np.nonzero(mask)
    out = np.zeros(mask.shape, np.int64)
    if len(y):
        out[y, x] = np.unique(label_points(y, x), return_inverse=True)[1] + 1
    return out


def clip_statistics(values: np.ndarray, sigma: float = 3.0, rounds: int = 10, least: int = 6) -> tuple[float | None, float | None, int]:
    """Iterative clip about the median by the population deviation: median, deviation, retained count.

    Both are None when fewer than `least` samples are left or the deviation is within rounding of the values.
    """
    v = values[np.isfinite(values)]
    if not len(v):
        return None, None, 0
    floor = 2.0**-23 * np.abs(v).max()
    for _ in range(rounds):
        kept = v[np.abs(v - np.median(v)) <= sigma * v.std()]
        if len(kept) == len(v) or not len(kept):
            break
        v = kept
    if len(v) < least or not v.std() > floor:
        return None, None, len(v)
    return float(np.median(v)), float(v.std()), len(v)


def moving_max(plane: np.ndarray, ry: int, rx: int, fill: float = -np.inf) -> np.ndarray:
    """Moving maximum with a constant outside."""
    padded = np.pad(plane, ((ry, ry), (rx, rx)), constant_values=fill)
    rows = np.lib.stride_tricks.sliding_window_view(padded, 2 * ry + 1, axis=0).max(axis=-1)
    return np.lib.stride_tricks.sliding_window_view(rows, 2 * rx + 1, axis=1).max(axis=-1)


def convolve(plane: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-size convolution with zeros outside, by FFT on a padded shape."""
    shape = tuple(p + k - 1 for p, k in zip(plane.shape, kernel.shape, strict=True))
    full = np.fft.irfft2(np.fft.rfft2(plane, shape) * np.fft.rfft2(kernel, shape), shape)
    top, left = kernel.shape[0] // 2, kernel.shape[1] // 2
    return full[top : top + plane.shape[0], left : left + plane.shape[1]]
