"""Removal of passages that repeat across documents.

Rabin-Karp hashes of every window of WINDOW words are matched over the whole table; a
window whose words also start in a document with a smaller doc_id is a repeat, and the
union of repeats (maximal intervals) is removed.

Two rounds keep the shuffle small without leaving a window out. Documents are dealt into
blocks by a hash of doc_id and text, one block is a few MB of text. In the first round a block
sends 32 bits of each of its distinct window hashes to the hash range (bucket) they belong
to, packed in one binary value for a bucket; the bucket answers with a bitmap of those that
another block has too. In the second round a block sends 128 bits and its own smallest
doc_id of those only, and is told which ones have a smaller doc_id elsewhere. A window that
a third of all rows hold is one entry for each block. Blocks and buckets grow in number,
not in size; the text is shuffled once, as the three block steps share one exchange.

Null texts have no words; a text of fewer than WINDOW words has no window. Rows that share
a doc_id are one document. A null doc_id counts as larger than every other. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm import textkit as tk

WINDOW = 50
BLOCK_CHARS = 8 << 20
BUCKET_WINDOWS = 2_000_000
LAST = np.int64(2**63 - 1)


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").combine_chunks().fill_null(int(LAST)).to_numpy().astype(np.int64)


def _window_hashes(found: tk.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits of every window, in two halves, and the place of its first word."""
    counts = np.diff(found.first) - (window - 1)
    counts[counts < 0] = 0
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(counts.sum()) + np.repeat(found.first[:-1] - np.append(0, np.cumsum(counts)[:-1]), counts)
    words = found.hashes()
    return tk.mix(tk.rolling(words, at, at + window)), tk.rolling_other(words, at, at + window), at


def _order(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both halves, and where runs of equal ones begin; the second half is looked at where the first is equal."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if (same & (more[order][1:] != more[order][:-1])).any():
        order = np.lexsort((more, h))
        same = h[order][1:] == h[order][:-1]
    return order, np.flatnonzero(np.append(True, ~same | (more[order][1:] != more[order][:-1])))


def _place(values: np.ndarray, others: np.ndarray, h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Where both halves are among sorted ones; each is there."""
    at = np.searchsorted(values, h)
    while len(wrong := np.flatnonzero(others[at] != more)):
        at[wrong] += 1
    return at


def _block_windows(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's distinct window hashes, ascending, their second halves, and the smallest doc_id of each."""
    ids = _ids(table)
    parts = []
    for found in tk.words(table.column("text").combine_chunks(), tk.SPACES):
        h, more, at = _window_hashes(found, window)
        parts.append((h, more, ids[found.lo + np.searchsorted(found.first, at, "right") - 1]))
    if not sum(len(p[0]) for p in parts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, more, d = (np.concatenate(c) for c in zip(*parts, strict=True))
    parts.clear()
    order, heads = _order(h, more)
    return h[order[heads]], more[order[heads]], np.minimum.reduceat(d[order], heads)


def _ranges(h: np.ndarray, bits: int):
    """Bucket, from, to of each run of sorted hashes in one range."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(h)) if len(h) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[a]), a, b


def _blobs(block: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table(
        {
            "block": pa.array([block] * len(rows), pa.int64()),
            "bucket": pa.array([r[0] for r in rows], pa.int64()),
            "data": pa.array([r[1] for r in rows], pa.binary()),
        }
    )


def _answers(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate((("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())))})


_BLOB = "block long, bucket long, data binary"


def repeated_windows(texts: DataFrame, window: int, total_chars: int) -> tuple[DataFrame, DataFrame]:
    """(documents dealt into blocks, per block the window hashes that start in a smaller doc_id of another block)."""
    blocks = max(1, -(-total_chars // BLOCK_CHARS))
    bits = max(0, int(np.ceil(np.log2(max(1, total_chars / 6 / BUCKET_WINDOWS)))))
    dealt = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text")

    def short(h):
        return (h >> np.uint64(32 - bits)).astype(np.uint32)

    def first_send(table: pa.Table) -> pa.Table:
        h, _, _ = _block_windows(table, window)
        return _blobs(table.column("block")[0].as_py(), [(k, short(h[a:b]).tobytes()) for k, a, b in _ranges(h, bits)])

    def first_answer(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in table.column("data").to_pylist()]
        every = np.sort(np.concatenate([np.unique(p) for p in parts]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        rows = []
        if len(twice):
            for block, bucket, p in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), parts, strict=True):
                at = np.searchsorted(twice, p)
                at[at == len(twice)] = 0
                hit = twice[at] == p
                if hit.any():
                    rows.append((block, bucket, np.packbits(hit).tobytes()))
        return _answers(rows)

    def second_send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table) or not len(answers):
            return _blobs(0, [])
        h, more, low = _block_windows(table, window)
        said = dict(zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True))
        rows = []
        for k, a, b in _ranges(h, bits):
            if k in said:
                hit = np.unpackbits(np.frombuffer(said[k], np.uint8), count=b - a).astype(bool)
                rows.append((k, h[a:b][hit].tobytes() + more[a:b][hit].tobytes() + low[a:b][hit].tobytes()))
        return _blobs(table.column("block")[0].as_py(), rows)

    def second_answer(table: pa.Table) -> pa.Table:
        blocks_, buckets, parts = table.column("block").to_pylist(), table.column("bucket").to_pylist(), []
        for x in table.column("data").to_pylist():
            n = len(x) // 3
            parts.append((np.frombuffer(x[:n], np.uint64), np.frombuffer(x[n : 2 * n], np.uint64), np.frombuffer(x[2 * n :], np.int64)))
        h, more, low = (np.concatenate(c) for c in zip(*parts, strict=True))
        order, heads = _order(h, more)
        least_of, values, others = np.minimum.reduceat(low[order], heads), h[order[heads]], more[order[heads]]
        rows = []
        for block, bucket, (a, c, b) in zip(blocks_, buckets, parts, strict=True):
            late = least_of[_place(values, others, a, c)] < b
            if late.any():
                rows.append((block, bucket, a[late].tobytes() + c[late].tobytes()))
        return _answers(rows)

    by_block = dealt.groupBy("block")
    shared = by_block.applyInArrow(first_send, _BLOB).groupBy("bucket").applyInArrow(first_answer, _BLOB)
    exact = by_block.cogroup(shared.groupBy("block")).applyInArrow(second_send, _BLOB)
    return dealt, exact.groupBy("bucket").applyInArrow(second_answer, _BLOB)


def _covered(found: tk.Words, at: np.ndarray, window: int) -> np.ndarray:
    """Which words a window that begins at one of the places covers."""
    step = np.zeros(len(found.starts) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step)[:-1] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of docs(doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt, late = repeated_windows(texts, window, total)

    def rows(table: pa.Table, answers: pa.Table) -> pa.Table:
        n_words, n_removed, kept = [], [], []
        if len(table):
            ids = _ids(table)
            values, others, low = _block_windows(table, window)
            elsewhere = np.zeros(len(values), bool)
            for x in answers.column("data").to_pylist():
                elsewhere[_place(values, others, *np.frombuffer(x, np.uint64).reshape(2, -1))] = True
            for found in tk.words(table.column("text").combine_chunks(), tk.SPACES):
                h, more, at = _window_hashes(found, window)
                place = _place(values, others, h, more)
                row = np.searchsorted(found.first, at, "right") - 1
                gone = _covered(found, at[elsewhere[place] | (low[place] < ids[found.lo + row])], window)
                lost = np.append(0, np.cumsum(gone))
                for r in range(found.hi - found.lo):
                    a, b = found.first[r], found.first[r + 1]
                    n_words.append(int(b - a))
                    n_removed.append(int(lost[b] - lost[a]))
                    mine = [] if a == b or n_removed[-1] == b - a else found.raw[found.starts[a] : found.ends[b - 1]].split()
                    kept.append(b" ".join(compress(mine, ~gone[a:b]) if n_removed[-1] else mine).decode())
        return pa.table(
            {
                "doc_id": table.column("doc_id") if len(table) else pa.array([], pa.int64()),
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_text": pa.array(kept, pa.string()),
            }
        )

    return (
        dealt.groupBy("block")
        .cogroup(late.groupBy("block"))
        .applyInArrow(rows, "doc_id long, n_words long, n_removed long, kept_text string")
    )


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's rows."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def plain_reference(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """Brute force over (doc_id, text), for tests: doc_id -> n_words, n_removed, sha256 of kept words."""
    import re

    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    low: dict[tuple, int] = {}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            low[key] = min(i, low.get(key, i))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if low[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out
