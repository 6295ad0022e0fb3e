"""Vectorised text scanning for Arrow string columns.

A column is taken as one byte buffer; words are found with byte masks and hashed by
their 8-byte parts, so there is no Python loop per word. A part goes through a bijective
mixer before parts are summed, so texts built against polynomial hashes do not collide.
Where a hash decides a result, a second one of another family (`other`) makes 128 bits.
Null texts have no words.
"""

from __future__ import annotations

import ctypes
import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BATCH_ROWS = 2000  # rows of an Arrow batch at most: whole texts are in it
CHUNK_BYTES = 1 << 21  # bytes scanned at once; a longer text is scanned alone, whole

_SPACE = b"\x09\x0a\x0b\x0c\x0d\x20"
_LOWER = bytes(range(65, 91))
#: Byte tables for the three word definitions that the operators use.
SPACES = bytes(32 if b in _SPACE else b for b in range(256))
SPACES_LOWER = bytes(32 if b in _SPACE else b + 32 if b in _LOWER else b for b in range(256))
ALNUM_LOWER = bytes(
    b + 32 if b in _LOWER else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256)
)

_rng = np.random.default_rng(20240607)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER_BASE = np.uint64(0xD1342543DE82EF95)
_PART, _LENGTH = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight
_MOST_POWERS = CHUNK_BYTES // 2  # longer tables are made for one call and not kept
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    kept = _powers.get(int(base))
    if kept is None or len(kept[0]) < n:
        made = []
        for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            table = np.full(max(n, 1 << 16), b, np.uint64)
            table[0] = 1
            made.append(np.multiply.accumulate(table))
        kept = made[0], made[1]
        if n <= _MOST_POWERS:
            _powers[int(base)] = kept
    return kept[0][:n], kept[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Polynomial hash of values[start:end] for every pair, by prefix sums modulo 2**64."""
    up, down = _power_tables(len(values) + 1, base)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * down[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * up[starts]


def other(values: np.ndarray) -> np.ndarray:
    """Hashes of words to a second family; with the first they make 128 bits of a sequence."""
    return mix(values ^ _PART)


def rolling_other(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The second family's hash of values[start:end]."""
    return mix(rolling(other(values), starts, ends, _OTHER_BASE))


def hash_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every pair: of its 8-byte parts, their order and its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    size = ends - starts
    total = mix((eight[starts] & _KEEP[np.minimum(size, 8)]) + _PART)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8  # parts after the first
        begin = np.append(0, np.cumsum(more)[:-1])
        number = np.arange(int(more.sum())) - np.repeat(begin, more) + 1
        at = np.repeat(starts[long], more) + 8 * number
        left = np.minimum(np.repeat(ends[long], more) - at, 8)
        part = mix((eight[at] & _KEEP[left]) + _PART * (number + 1).astype(np.uint64))
        total[long] += np.add.reduceat(part, begin)
    return mix(total + size.astype(np.uint64) * _LENGTH)


def modest_batches(df: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of the session hold BATCH_ROWS rows at most from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Return to the system what earlier work of this Python worker no longer needs; tables of powers are made anew when used."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


@dataclass
class Words:
    """Words of some consecutive rows: row r has the words first[r]:first[r + 1]."""

    lo: int  # the first row's place in the column
    hi: int
    data: bytes  # translated bytes
    raw: bytes  # bytes as they were
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, equal for equal words wherever they stand."""
        return hash_spans(self.data, self.starts, self.ends)


def buffers(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes (not copied) of a string or binary column; nulls count as empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.fill_null(column, "")
    else:
        column = pc.fill_null(column, b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(1, np.int64), memoryview(b"")
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    return at, memoryview(data) if data is not None else memoryview(b"")


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Row ranges of about `size` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(column: pa.Array, table: bytes):
    """Yield Words over all rows of a string column, whole texts, a few MB at a time."""
    offsets, data = buffers(column)
    for lo, hi in chunks(offsets):
        raw = bytes(data[offsets[lo] : offsets[hi]])
        text = raw.translate(table)
        at = offsets[lo : hi + 1] - offsets[lo]
        solid = np.frombuffer(text, np.uint8) != 32
        if not len(solid):
            none = np.zeros(0, np.int64)
            yield Words(lo, hi, text, raw, none, none, np.zeros(hi - lo + 1, np.int64))
            continue
        begins = np.empty(len(solid), bool)
        begins[0] = True
        np.logical_not(solid[:-1], out=begins[1:])
        begins[at[:-1][at[:-1] < len(solid)]] = True
        stops = np.empty(len(solid), bool)
        stops[-1] = True
        np.logical_not(solid[1:], out=stops[:-1])
        stops[at[1:][at[1:] > 0] - 1] = True
        starts = np.flatnonzero(solid & begins)
        ends = np.flatnonzero(solid & stops) + 1
        yield Words(lo, hi, text, raw, starts, ends, np.searchsorted(starts, at))


_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(found: Words, n: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles.

    A row of fewer words, but not none, has its whole sequence as its one shingle.
    """
    h, first, out = found.hashes(), found.first, []
    m = len(h) - n + 1
    rolled = np.zeros(max(m, 0), np.uint64)
    for j in range(n if m > 0 else 0):
        rolled += h[j : j + m] * _SHINGLE[j]
    rolled = mix(rolled)
    for r in range(found.hi - found.lo):
        a, b = first[r], first[r + 1]
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            part = h[a:b] * _SHINGLE[: b - a]
            out.append(mix(part.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
