"""Packing of documents into sequences of a fixed length.

Each document's ids (with the end id) are cut into pieces of `length` and one rest. Rests
are packed first-fit decreasing, separately in groups of documents drawn by a hash of
doc_id and text; a tournament tree over the open sequences' free room finds the first that fits in
a logarithmic number of steps. A full piece is a sequence of its own. Groups hold about
GROUP_DOCS documents at any input size; only lengths and checksums are shuffled, no text.

Null texts are empty: they have the end id alone. Repeated rows are packed each. A null
doc_id is a document like others. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm.textkit import give_back, modest_batches
from fluxweave.llm.tokens import encoder, with_end

LENGTH = 1024
END_ID = 0
GROUP_DOCS = 4096
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group_id long"
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class FirstFit:
    """Sequences in order of opening; the tree's nodes hold the most free room below them."""

    def __init__(self, most: int, room: int):
        self.leaves = 1 << max(0, (max(most, 1) - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first sequence with room for size, which is taken from it."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        tree[at] -= size
        leaf = at - self.leaves
        at //= 2
        while at:
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
        return leaf


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset in it) of each size; every size is at most room."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = FirstFit(len(sizes), room)
    used = [0] * len(sizes)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        b = tree.place(size)
        bins[k], offsets[k] = b, used[b]
        used[b] += size
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, groups: int = 1, cache_words: int | None = None) -> DataFrame:
    """Pieces of each document's ids, with the group each belongs to."""
    texts = modest_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.pmod(F.xxhash64("doc_id", "text", F.lit(20240607)), F.lit(groups)).alias("group_id"),
    )

    def cut(batches):
        give_back()
        for batch in batches:
            flat, edges = with_end(*encoder(vocabulary, cache_words).encode_column(batch.column("text")), end_id)
            size = np.diff(edges)
            count = -(-size // length)
            row = np.repeat(np.arange(len(size)), count)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * length
            most = np.minimum(length, size[row] - start)
            data, begin = memoryview(flat.tobytes()), (edges[row] + start) * 4
            sums = [zlib.crc32(data[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * most).tolist(), strict=True)]
            ids, group = (batch.column(c).take(pa.array(row)) for c in ("doc_id", "group_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(most), pa.array(sums, pa.int64()), pa.array(size[row]), group], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "group_id"])
        encoder(vocabulary, cache_words).rest()

    return texts.mapInArrow(cut, _PIECE)


def _pack_group(length: int):
    def pack(table: pa.Table) -> pa.Table:
        order = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = order.column("length").to_numpy()
        bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        full = sizes >= length
        bins[~full], offsets[~full] = first_fit_decreasing(sizes[~full], length)
        opened = int(bins[~full].max()) + 1 if (~full).any() else 0
        bins[full] = opened + np.arange(int(full.sum()))
        group = order.column("group_id")[0].as_py()
        out = order.drop_columns(["group_id"])
        return out.append_column("sequence_id", pa.array(bins + (group << 32))).append_column("offset", pa.array(offsets))

    return pack


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, cache_words: int | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece."""
    groups = max(1, -(-docs.count() // group_docs))
    return pieces(docs, vocabulary, length, end_id, groups, cache_words).groupBy("group_id").applyInArrow(_pack_group(length), _OUT)
