"""Gradient-boosted trees for a yes/no label, in numpy: histogram splits, logistic loss, weighted examples."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 17  # examples in memory at a time


class Rows:
    """Binned examples with labels, weights and scores in a temporary file, so memory does not grow with them."""

    def __init__(self, width: int):
        self.form = np.dtype([("b", "u1", (width,)), ("y", "f8"), ("w", "f8"), ("score", "f8")])
        self.file, self.size = tempfile.TemporaryFile(), 0

    def add(self, b: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        new = np.zeros(len(b), self.form)
        new["b"], new["y"], new["w"] = b, y, w
        self.put(self.size, new)
        self.size += len(new)

    def put(self, at: int, block: np.ndarray) -> None:
        self.file.seek(at * self.form.itemsize)
        self.file.write(block.tobytes())

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first, examples), to be written back by `put` where they change."""
        for at in range(0, self.size, BLOCK):
            self.file.seek(at * self.form.itemsize)
            yield at, np.frombuffer(bytearray(self.file.read(min(BLOCK, self.size - at) * self.form.itemsize)), self.form)


class Boosted:
    """`trees` trees of `depth` levels over features that are binned at fixed edges, 255 of each at most."""

    def __init__(self, edges: list[np.ndarray], trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0):
        self.edges, self.trees, self.depth, self.rate, self.l2 = edges, trees, depth, rate, l2
        self.bins = max(map(len, edges)) + 1
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def fit(self, rows: Rows) -> Boosted:
        """Each level of each tree is one pass over all the rows."""
        weight = positive = 0.0
        for _, block in rows.blocks():
            weight += block["w"].sum()
            positive += (block["w"] * block["y"]).sum()
        rate = np.clip(positive / weight, 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        for _ in range(self.trees):
            feature = np.zeros(2**self.depth - 1, np.int64)
            cut = np.full(2**self.depth - 1, self.bins, np.int64)
            sums = np.zeros((2**self.depth, 2))
            for level in range(self.depth):
                g, h, size = self._histograms(rows, feature, cut, level)
                for k in range(2**level):
                    node = 2**level - 1 + k
                    left_g, left_h = np.cumsum(g[:, k], axis=1), np.cumsum(h[:, k], axis=1)
                    total = np.array([left_g[0, -1], left_h[0, -1]])
                    if size[k] >= 8:
                        feature[node], cut[node] = self._split(left_g, left_h, *total)
                    if level == self.depth - 1:
                        split = feature[node], cut[node]
                        sums[2 * k] = (left_g[split], left_h[split]) if cut[node] < self.bins else total
                        sums[2 * k + 1] = total - sums[2 * k]
            self.nodes.append((feature, cut, -self.rate * sums[:, 0] / (sums[:, 1] + self.l2)))
        return self

    def _histograms(self, rows: Rows, feature: np.ndarray, cut: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients and curvatures by feature, node of the level and bin, and the nodes' weights."""
        nodes, width = 2**level, len(self.edges)
        g, h, size = np.zeros((width, nodes, self.bins)), np.zeros((width, nodes, self.bins)), np.zeros(nodes)
        for at, block in rows.blocks():
            b = block["b"].astype(np.int64)
            if level == 0:  # scores take in the tree before
                block["score"] = block["score"] + self._values(b, self.nodes[-1]) if self.nodes else self.base
                rows.put(at, block)
            w, node = block["w"], self._walk(b, feature, cut, level)
            p = 1 / (1 + np.exp(-block["score"]))
            gradient, curvature = w * (p - block["y"]), w * p * (1 - p)
            for k in range(width):
                cell = node * self.bins + b[:, k]
                g[k] += np.bincount(cell, gradient, nodes * self.bins).reshape(nodes, self.bins)
                h[k] += np.bincount(cell, curvature, nodes * self.bins).reshape(nodes, self.bins)
            size += np.bincount(node, w, nodes)
        return g, h, size

    def _split(self, left_g: np.ndarray, left_h: np.ndarray, total_g: float, total_h: float) -> tuple[int, int]:
        gain = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - total_g**2 / (total_h + self.l2)
        k, c = np.unravel_index(np.argmax(gain), gain.shape)
        return (int(k), int(c)) if gain[k, c] > 1e-9 else (0, self.bins)

    @staticmethod
    def _walk(b: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        """Each row's node on a level, from 0."""
        at, each = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(levels):
            at = 2 * at + 1 + (b[each, feature[at]] > cut[at])
        return at - (2**levels - 1)

    def _values(self, b: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        return value[self._walk(b, feature, cut, self.depth)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.probability_binned(self.binned(x)) if len(x) else np.zeros(0)

    def probability_binned(self, b: np.ndarray) -> np.ndarray:
        score = np.full(len(b), self.base)
        for tree in self.nodes:
            score += self._values(b, tree)
        return 1 / (1 + np.exp(-score))
