"""FITS images and tables: encoder, strict readers, and a Spark data source for image pixels.

Files are read by byte range through pyarrow's file systems, so any store it knows will do.
An image is read by row blocks, one partition each; filters on y and x are pushed down, so a
window reads the rows it needs.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

BLOCK = 2880
BLOCK_PIXELS = 1 << 20
_KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


class FitsError(ValueError):
    """A file that does not meet the input contract."""


def _open(path: str):
    if "://" not in path and path.startswith("/"):
        return pafs.LocalFileSystem().open_input_file(path)
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


# --- headers ------------------------------------------------------------------------------


def card(key: str, value, comment: str = "") -> bytes:
    """One 80-byte header card."""
    if key in ("COMMENT", "HISTORY", "END", ""):
        return f"{key:<8}{value or ''}"[:80].ljust(80).encode("ascii")
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{value:>20}"
    elif isinstance(value, (float, np.floating)):
        text = f"{float(value)!r:>20}".upper() if np.isfinite(value) else "'NaN     '"
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{key:<8}= {text}{' / ' + comment if comment else ''}"[:80].ljust(80).encode("ascii")


def encode_header(cards: Iterable[tuple]) -> bytes:
    data = b"".join(card(*c) for c in cards) + card("END", "")
    return data.ljust(-(-len(data) // BLOCK) * BLOCK)


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        end = 1
        while end < len(text) and not (text[end] == "'" and text[end + 1 : end + 2] != "'"):
            end += 2 if text[end] == "'" else 1
        return text[1:end].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text or None


def read_header(f, at: int = 0) -> tuple[dict, int]:
    """(values, offset of the data) of the header at an offset."""
    values: dict = {}
    while True:
        f.seek(at)
        block = f.read(BLOCK)
        if len(block) < BLOCK:
            raise FitsError("the header does not end")
        at += BLOCK
        for k in range(0, BLOCK, 80):
            line = block[k : k + 80].decode("ascii", "replace")
            key = line[:8].strip()
            if key == "END":
                return values, at
            if line[8:10] == "= " and key not in values:
                values[key] = _value(line[10:])


def data_size(header: dict) -> int:
    n = header.get("NAXIS", 0)
    count = 1 if n else 0
    for k in range(1, n + 1):
        count *= header[f"NAXIS{k}"]
    return abs(header.get("BITPIX", 8)) // 8 * (count + header.get("PCOUNT", 0)) * header.get("GCOUNT", 1)


# --- image contract -----------------------------------------------------------------------


def brightness_unit(header: dict, supplied: str | None = None) -> str:
    """Jy/beam under its usual spellings, from the header or else supplied."""
    found = str(header.get("BUNIT") or supplied or "").strip()
    if found.lower().replace(" ", "") not in ("jy/beam", "jybeam-1", "beam-1jy", "jybeam^-1"):
        raise FitsError(f"brightness unit {found!r} is not Jy/beam")
    return "Jy/beam"


def restoring_beam(header: dict, supplied: tuple | None = None) -> tuple[float, float, float]:
    """(major, minor, angle) in degrees; supplied values fill only what is missing."""
    given = supplied or (None, None, None)
    beam = tuple(header.get(k) if header.get(k) is not None else g for k, g in zip(("BMAJ", "BMIN", "BPA"), given, strict=True))
    if any(b is None for b in beam[:2]) or not (0 < beam[1] <= beam[0]):
        raise FitsError(f"restoring beam {beam} is not usable")
    return float(beam[0]), float(beam[1]), float(beam[2] or 0.0)


def reference_frequency(header: dict, supplied: float | None = None) -> float:
    """RESTFRQ or RESTFREQ, a spectral axis, or supplied, in Hz."""
    for key in ("RESTFRQ", "RESTFREQ"):
        if header.get(key):
            return float(header[key])
    for k in range(1, header.get("NAXIS", 0) + 1):
        if str(header.get(f"CTYPE{k}", "")).startswith("FREQ"):
            return float(header[f"CRVAL{k}"])
    if supplied is None:
        raise FitsError("no reference frequency")
    return float(supplied)


def image_metadata(path: str, *, unit: str | None = None, beam: tuple | None = None, frequency: float | None = None) -> dict:
    """The validated contract of an image: one logical plane, Stokes I, unit, beam, WCS, frequency."""
    from fluxweave.functions.sky import Wcs

    with _open(path) as f:
        header, offset = read_header(f)
    if header.get("SIMPLE") is not True or header.get("NAXIS", 0) < 2:
        raise FitsError("the primary HDU is not an image")
    if any(header[f"NAXIS{k}"] != 1 for k in range(3, header["NAXIS"] + 1)):
        raise FitsError("an axis beyond the plane is not degenerate")
    for k in range(3, header["NAXIS"] + 1):
        if str(header.get(f"CTYPE{k}", "")).startswith("STOKES") and round(float(header.get(f"CRVAL{k}", 1))) != 1:
            raise FitsError("only Stokes I is supported")
    if header["BITPIX"] not in _KINDS:
        raise FitsError(f"BITPIX {header['BITPIX']} is unknown")
    Wcs(header)
    return {
        "path": path, "shape": (header["NAXIS2"], header["NAXIS1"]), "offset": offset, "bitpix": header["BITPIX"], "scale": float(header.get("BSCALE", 1.0)), "zero": float(header.get("BZERO", 0.0)),
        "blank": header.get("BLANK") if header["BITPIX"] > 0 else None, "unit": brightness_unit(header, unit), "beam": restoring_beam(header, beam), "frequency": reference_frequency(header, frequency), "header": header,
    }


def read_rows(meta: dict, y0: int, y1: int, file=None) -> np.ndarray:
    """Decoded rows of an image (of an open file, if there is one): scale, zero and blank applied, NaN where invalid."""
    kind, width = np.dtype(_KINDS[meta["bitpix"]]), meta["shape"][1]
    with nullcontext(file) if file is not None else _open(meta["path"]) as f:
        f.seek(meta["offset"] + y0 * width * kind.itemsize)
        raw = np.frombuffer(f.read((y1 - y0) * width * kind.itemsize), kind)
    if len(raw) != (y1 - y0) * width:
        raise FitsError("the data end early")
    value = raw.astype(np.float64) * meta["scale"] + meta["zero"]
    if meta["blank"] is not None:
        value[raw == meta["blank"]] = np.nan
    return value.reshape(y1 - y0, width)


def read_windows(meta: dict, boxes: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
    """Several windows (y0, y1, x0, x1) of one file, which is opened once."""
    with _open(meta["path"]) as f:
        return [read_rows(meta, y0, y1, f)[:, x0:x1] for y0, y1, x0, x1 in boxes]


def load_windows(spark, path: str, boxes: list[tuple[int, int, int, int]]):
    """window, y, x, value: the pixels of several boxes in one scan, which reads the rows that any of them needs."""
    register(spark)
    inside = [(F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1) for y0, y1, x0, x1 in boxes]
    held = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(inside)]))
    scan = spark.read.format("fits").option("rows", json.dumps(sorted({(y0, y1) for y0, y1, _, _ in boxes}))).load(path)
    return scan.select(F.explode(held).alias("window"), "y", "x", "value")


# --- data source --------------------------------------------------------------------------


class _Rows(InputPartition):
    def __init__(self, y0: int, y1: int):
        self.y0, self.y1 = y0, y1


class _Reader(DataSourceReader):
    def __init__(self, meta: dict, rows: list[tuple[int, int]] | None = None):
        self.meta = meta
        self.rows = rows if rows is not None else [(0, meta["shape"][0])]
        self.y, self.x = [0, meta["shape"][0]], [0, meta["shape"][1]]

    def pushFilters(self, filters):  # noqa: N802 - Spark's name
        """Bounds on y and x narrow what is read; Spark still applies every filter itself."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("y",), ("x",)):
                box = self.y if f.attribute == ("y",) else self.x
                v = f.value
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    box[0] = max(box[0], int(np.ceil(v)))
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    box[1] = min(box[1], int(np.floor(v)) + 1)
                if isinstance(f, GreaterThan):
                    box[0] = max(box[0], int(np.floor(v)) + 1)
                if isinstance(f, LessThan):
                    box[1] = min(box[1], int(np.ceil(v)))
            yield f

    def partitions(self):
        rows = max(1, BLOCK_PIXELS // max(1, self.meta["shape"][1]))
        wanted: list[list[int]] = []  # row ranges without overlap
        for low, high in sorted((max(a, self.y[0]), min(b, self.y[1])) for a, b in self.rows):
            if wanted and low <= wanted[-1][1]:
                wanted[-1][1] = max(wanted[-1][1], high)
            elif low < high:
                wanted.append([low, high])
        return [_Rows(a, min(a + rows, high)) for low, high in wanted for a in range(low, high, rows)] or [_Rows(0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 16) // max(1, self.x[1] - self.x[0]))
        for y0 in range(partition.y0, partition.y1, step):
            y1 = min(y0 + step, partition.y1)
            value = read_rows(self.meta, y0, y1)[:, self.x[0] : self.x[1]]
            yy, xx = np.mgrid[y0:y1, self.x[0] : max(self.x)] if self.x[1] > self.x[0] else (np.zeros(0), np.zeros(0))
            flat = value.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(yy.ravel(), pa.int64()), pa.array(xx.ravel(), pa.int64()), pa.array(flat, pa.float64(), mask=~np.isfinite(flat))], ["y", "x", "value"])


class FitsImage(DataSource):
    """spark.read.format("fits").load(path): y, x, value; null where the image is blank or not finite."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return "y long, x long, value double"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        beam = tuple(float(o[k]) if k in o else None for k in ("bmaj", "bmin", "bpa"))
        rows = [tuple(r) for r in json.loads(o["rows"])] if "rows" in o else None
        return _Reader(image_metadata(o["path"], unit=o.get("unit"), beam=beam, frequency=float(o["frequency"]) if "frequency" in o else None), rows)


def register(spark) -> None:
    """Make the source known; pushdown of filters to Python sources is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FitsImage)


# --- writers ------------------------------------------------------------------------------


def _pad(f, n: int, fill: bytes = b"\0") -> None:
    f.write(fill * (-n % BLOCK))


def write_image(path: str, shape: tuple[int, int], row_blocks: Iterable[np.ndarray], cards: Iterable[tuple] = (), bitpix: int = -32) -> None:
    """A primary image from consecutive row blocks; a mask is bitpix 8. The block count must fill the shape."""
    kind, seen = np.dtype(_KINDS[bitpix]), 0
    with open(path, "xb") as f:
        f.write(encode_header([("SIMPLE", True), ("BITPIX", bitpix), ("NAXIS", 2), ("NAXIS1", shape[1]), ("NAXIS2", shape[0]), *cards]))
        for block in row_blocks:
            if block.shape[1] != shape[1]:
                raise FitsError("a row block has another width")
            f.write(block.astype(kind).tobytes())
            seen += block.shape[0]
        if seen != shape[0]:
            raise FitsError(f"{seen} rows for an image of {shape[0]}")
        _pad(f, shape[0] * shape[1] * kind.itemsize)


def write_plane(path: str, shape: tuple[int, int], plane, cards: Iterable[tuple] = (), bitpix: int = -32, rows: int = 256) -> None:
    """A primary image from plane(y, x, value), written by the tasks: each block of rows at its place in the file.

    The folder is one that driver and executors all mount. Absent pixels are NaN, in whole numbers
    0. A repeated task writes the same bytes again; the file is complete when every block reports.
    """
    kind, width = np.dtype(_KINDS[bitpix]), shape[1]
    header = encode_header([("SIMPLE", True), ("BITPIX", bitpix), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", shape[0]), *cards])
    size = shape[0] * width * kind.itemsize
    with open(path, "xb") as f:
        f.write(header)
        f.truncate(len(header) + size + -size % BLOCK)

    def write(table: pa.Table) -> pa.Table:
        at = table.column("block")[0].as_py()
        y0 = at * rows
        block = np.full((min(rows, shape[0] - y0), width), np.nan)
        given = table.filter(pc.is_valid(table.column("y")))
        block[given.column("y").to_numpy() - y0, given.column("x").to_numpy()] = given.column("value").cast(pa.float64()).to_numpy(zero_copy_only=False)
        if bitpix > 0:
            block = np.nan_to_num(block)
        handle = os.open(path, os.O_WRONLY)
        try:
            data, offset = block.astype(kind).tobytes(), len(header) + y0 * width * kind.itemsize
            while data:
                n = os.pwrite(handle, data, offset)
                data, offset = data[n:], offset + n
            os.fsync(handle)
        finally:
            os.close(handle)
        return pa.table({"block": pa.array([at], pa.int64())})

    blocks = -(-shape[0] // rows)
    given = plane.select(F.floor(F.col("y") / rows).alias("block"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("value"))
    every = plane.sparkSession.range(blocks).select(F.col("id").alias("block"), *[F.lit(None).cast(t).alias(c) for c, t in (("y", "long"), ("x", "long"), ("value", "double"))])
    done = given.unionByName(every).groupBy("block").applyInArrow(write, "block long").count()
    if done != blocks:
        raise FitsError(f"{done} of {blocks} row blocks were written")


def _columns(table: pa.Table) -> list[tuple[str, str, np.ndarray]]:
    out = []
    for name in table.column_names:
        c = table.column(name).combine_chunks()
        if pa.types.is_boolean(c.type):
            out.append((name, "L", np.where(c.to_numpy(zero_copy_only=False).astype(bool), b"T", b"F").astype("S1")))
        elif pa.types.is_int32(c.type):
            out.append((name, "J", c.fill_null(0).to_numpy().astype(">i4")))
        elif pa.types.is_integer(c.type):
            out.append((name, "K", c.fill_null(0).to_numpy().astype(">i8")))
        elif pa.types.is_floating(c.type):
            out.append((name, "D", c.fill_null(float("nan")).to_numpy().astype(">f8")))
        else:
            values = [("" if v is None else ",".join(map(str, v)) if isinstance(v, list) else str(v)).encode() for v in c.to_pylist()]
            width = max([1, *map(len, values)])
            out.append((name, f"{width}A", np.array(values, f"S{width}")))
    return out


def write_tables(path: str, tables: dict[str, pa.Table], cards: Iterable[tuple] = ()) -> None:
    """A file of binary tables, each an extension of its name; null floats become NaN, lists comma-joined text."""
    with open(path, "xb") as f:
        f.write(encode_header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True), *cards]))
        for extension, table in tables.items():
            columns = _columns(table)
            row = np.dtype([(n, a.dtype) for n, _, a in columns])
            data = np.empty(table.num_rows, row)
            for n, _, a in columns:
                data[n] = a
            named = [(f"T{k}{j}", v) for j, (n, form, _) in enumerate(columns, 1) for k, v in (("TYPE", n), ("FORM", form))]
            f.write(encode_header([("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", row.itemsize), ("NAXIS2", len(data)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns)), ("EXTNAME", extension), *named]))
            f.write(data.tobytes())
            _pad(f, data.nbytes)


def read_tables(path: str) -> dict[str, pa.Table]:
    """All binary tables by name; NaN floats become null, text is stripped."""
    out: dict[str, pa.Table] = {}
    with _open(path) as f:
        header, at = read_header(f)
        at += -(-data_size(header) // BLOCK) * BLOCK
        while at < f.size():
            header, at = read_header(f, at)
            kinds = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
            row = []
            for k in range(1, header.get("TFIELDS", 0) + 1):
                form = str(header[f"TFORM{k}"])
                code, count = form[-1], int(form[:-1] or 1)
                row.append((str(header[f"TTYPE{k}"]), f"S{count}" if code == "A" else kinds[code]))
            f.seek(at)
            data = np.frombuffer(f.read(data_size(header)), np.dtype(row), header["NAXIS2"]) if row else np.zeros(0, np.dtype([("_", "u1")]))
            columns = {}
            for name, kind in row:
                v = data[name]
                if kind == "S1" and str(header[f"TFORM{[n for n, _ in row].index(name) + 1}"])[-1] == "L":
                    columns[name] = pa.array([x == b"T" for x in v], pa.bool_())
                elif v.dtype.kind == "S":
                    columns[name] = pa.array([x.decode().rstrip() for x in v.tolist()], pa.string())
                elif v.dtype.kind == "f":
                    w = v.astype(np.float64)
                    columns[name] = pa.array(w, pa.float64(), mask=np.isnan(w))
                else:
                    columns[name] = pa.array(v.astype(v.dtype.newbyteorder("=")))
            out[str(header.get("EXTNAME", f"HDU{len(out) + 1}"))] = pa.table(columns)
            at += -(-data_size(header) // BLOCK) * BLOCK
    return out
