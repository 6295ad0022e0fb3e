"""Benchmark decontamination by winnowing.

A k-gram hash is kept for each run of GUARANTEE - K + 1 consecutive k-grams, the smallest;
so a document and a benchmark item that share GUARANTEE words share a fingerprint. The
document's fingerprints are joined with the benchmark's, and each hit is extended to the
whole window of GUARANTEE words, which must be one of the item's. An item of fewer words is
one window of its own length; its fingerprint is its whole sequence.

A window is known by 128 bits, two hashes of different families.

The benchmark's index is sent to all tasks only while its text is under INDEX_BYTES; a
larger benchmark is taken in parts of that size. Each row passes them one after the other and
carries its hits along; after CHAIN parts the rows are written, so that a task holds that many
indexes at most. Documents are never shuffled.

Null texts have no words. Repeated rows each get a row; an item_id that is null is
ignored; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm import textkit as tk
from fluxweave.runtime import cut

GUARANTEE = 10
K = 5
INDEX_BYTES = 32 << 20
CHAIN = 4
_OUT = "doc_id long, n_words long, n_hit long, items array<string>, hit binary"
_CARRIED = f"{_OUT}, text string"


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    at = np.arange(max(0, len(h) - n + 1))
    return tk.mix(tk.rolling(h, at, at + n))


def _winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """The least hash of each run of `width` k-grams."""
    n = len(grams) - width + 1
    low = grams[: max(n, 0)].copy()
    for j in range(1, width if n > 0 else 0):
        np.minimum(low, grams[j : j + n], out=low)
    return low


class BenchmarkIndex:
    """Fingerprints of items, and for each length the windows with the items that have them."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.names = np.array([r[0] for r in rows], object)
        windows: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        prints = []
        for found in tk.words(pa.array([r[1] for r in rows], pa.string()), tk.ALNUM_LOWER):
            h = found.hashes()
            for r in range(found.hi - found.lo):
                mine = h[found.first[r] : found.first[r + 1]]
                if not len(mine):
                    continue
                n = min(len(mine), GUARANTEE)
                at = np.arange(len(mine) - n + 1)
                g, once = np.unique(_grams(mine, n), return_index=True)
                windows.setdefault(n, []).append((g, tk.rolling_other(mine, at, at + n)[once], np.full(len(g), found.lo + r)))
                if n == GUARANTEE:
                    prints.append(np.unique(_winnow(_grams(mine, K), GUARANTEE - K + 1)))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.windows = {}
        for n, parts in windows.items():
            g, more, item = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(g, kind="stable")
            values, begin = np.unique(g[order], return_index=True)
            self.windows[n] = values, np.append(begin, len(g)), item[order], more[order[begin]]

    def hits(self, h: np.ndarray, first: np.ndarray):
        """(place of a window, its length, its entry) for all windows of rows that an item has."""
        for n, (values, _, _, others) in self.windows.items():
            m = len(h) - n + 1
            if m <= 0:
                continue
            if n == GUARANTEE:
                prints = _winnow(_grams(h, K), GUARANTEE - K + 1)
                # A fingerprint usually serves several windows in a row: look each run up once.
                heads = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
                found = np.repeat(_member(self.prints, prints[heads])[0], np.diff(np.append(heads, m)))
                at = np.flatnonzero(found)
            else:
                at = np.arange(m)
            row = np.searchsorted(first, at, "right") - 1
            at = at[at + n <= first[row + 1]]
            known, entry = _member(values, tk.mix(tk.rolling(h, at, at + n)))
            at, entry = at[known], entry[known]
            if len(at):
                same = others[entry] == tk.rolling_other(h, at, at + n)
                yield at[same], n, entry[same]


def _member(values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.searchsorted(values, x)
    at[at == len(values)] = 0
    return values[at] == x, at


def _matcher(index: BenchmarkIndex, carry: bool):
    """Matches rows; with the hits they carry, those of earlier parts of the benchmark are united."""

    def match(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            before = (batch.column("hit"), batch.column("items")) if "hit" in batch.schema.names else None
            for found in tk.words(batch.column("text"), tk.ALNUM_LOWER):
                h, first = found.hashes(), found.first
                step = np.zeros(len(h) + 1, np.int64)
                per_row: dict[int, set[int]] = {}
                for at, n, entry in index.hits(h, first):
                    np.add.at(step, at, 1)
                    np.add.at(step, at + n, -1)
                    _, edges, items, _ = index.windows[n]
                    rows = np.searchsorted(first, at, "right") - 1
                    for r, e in zip(rows.tolist(), entry.tolist(), strict=True):
                        per_row.setdefault(r, set()).update(items[edges[e] : edges[e + 1]].tolist())
                hit = np.cumsum(step)[:-1] > 0
                rows = range(found.hi - found.lo)
                names = [set(index.names[list(per_row[r])]) if r in per_row else set() for r in rows]
                for r in rows if before else ():
                    if before[0][found.lo + r].is_valid:
                        mine = hit[first[r] : first[r + 1]]
                        mine |= np.unpackbits(np.frombuffer(before[0][found.lo + r].as_py(), np.uint8), count=len(mine)).astype(bool)
                        names[r].update(before[1][found.lo + r].as_py())
                total = np.append(0, np.cumsum(hit))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(found.lo, found.hi - found.lo),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(total[first[1:]] - total[first[:-1]], pa.int64()),
                        pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                        pa.array([np.packbits(hit[first[r] : first[r + 1]]).tobytes() if carry and names[r] else None for r in rows], pa.binary()),
                        *([batch.column("text").slice(found.lo, found.hi - found.lo)] if carry else []),
                    ],
                    ["doc_id", "n_words", "n_hit", "items", "hit", *(["text"] if carry else [])],
                )

    return match


def contamination(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items) for each row of docs(doc_id, text) against benchmark(item_id, text)."""
    texts = tk.modest_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= index_bytes:
        rows = [(r[0], r[1]) for r in items.collect()]  # under index_bytes, as checked
        return texts.mapInArrow(_matcher(BenchmarkIndex(rows), False), _OUT).drop("hit")
    parts = -(-2 * size // index_bytes)
    for k in range(parts):
        rows = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()]
        texts = texts.mapInArrow(_matcher(BenchmarkIndex(rows), True), _CARRIED)
        if k % CHAIN == CHAIN - 1 and k + 1 < parts:
            texts = cut(texts, "matched")
    return texts.drop("hit", "text")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs without any hit, with all their columns; nothing is shuffled for a benchmark of one part."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = 1 if size <= index_bytes else -(-2 * size // index_bytes)
    kept = tk.modest_batches(docs)
    for k in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        index = BenchmarkIndex([(r[0], r[1]) for r in mine.collect()])  # under index_bytes, as checked
        kept = kept.mapInArrow(_clean_rows(index), kept.schema)
    return kept


def _clean_rows(index: BenchmarkIndex):
    def clean(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for found in tk.words(batch.column("text"), tk.ALNUM_LOWER):
                for at, _, _ in index.hits(found.hashes(), found.first):
                    keep[found.lo + np.unique(np.searchsorted(found.first, at, "right") - 1)] = False
            yield batch.filter(pa.array(keep))

    return clean


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def plain_reference(rows, items) -> dict[int, tuple[int, int, int, str, bool]]:
    """Brute force, for tests."""
    import re

    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows: dict[tuple, set[str]] = {}
    for i, t in items:
        w = cut(t)
        n = min(len(w), GUARANTEE)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in rows:
        w = cut(t)
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    found |= windows[key]
                    hit[k : k + n] = [True] * n
        names = ",".join(sorted(found))
        out[i] = len(w), sum(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), any(hit)
    return out
