"""Products on disk: staging, publish-once rename, manifests, planes in Parquet, JSON."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rename_without_replacement(source: str, target: str) -> None:
    """Publish once: an existing target is an error, also when two publishers race."""
    if os.path.isdir(source):
        os.mkdir(target)  # claims the name; fails if it is there
        os.rename(source, target)  # an empty directory may be replaced
    else:
        os.link(source, target)
        os.unlink(source)


def _owner_lives(folder: Path) -> bool:
    try:
        pid, host = (folder / "owner").read_text().split()
    except (OSError, ValueError):
        return False
    if host != os.uname().nodename:
        return True  # cannot be proved stopped from here
    try:
        os.kill(int(pid), 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


@contextmanager
def staging_directory(output: str, run_id: str | None = None):
    """A hidden folder beside the output, owned by this process, removed unless it was published."""
    target = Path(output)
    folder = target.parent / f".{target.name}.{run_id or uuid.uuid4().hex}.staging"
    folder.mkdir(parents=True)
    (folder / "owner").write_text(f"{os.getpid()} {os.uname().nodename}")
    try:
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def reclaim_abandoned_staging(output: str) -> int:
    """Remove staging folders of an output whose owners have provably stopped."""
    target, gone = Path(output), 0
    for folder in target.parent.glob(f".{target.name}.*.staging"):
        if not _owner_lives(folder):
            shutil.rmtree(folder, ignore_errors=True)
            gone += 1
    return gone


def describe(path: str, role: str) -> dict:
    """Role, size and checksum of a published file."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return {"role": role, "path": os.path.basename(path), "bytes": os.path.getsize(path), "sha256": digest.hexdigest()}


def write_json(path: str, value: dict) -> None:
    """Canonical JSON: sorted keys, no spaces, one final newline; an existing file must be equal."""
    data = json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False) + "\n"
    if os.path.exists(path):
        if Path(path).read_text() != data:
            raise FileExistsError(path)
        return
    Path(path).write_text(data)


def read_json(path: str) -> dict:
    """Strict: only the canonical encoding is accepted."""
    data = Path(path).read_text()
    value = json.loads(data)
    if json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False) + "\n" != data:
        raise ValueError(f"{path} is not canonical")
    return value


def write_planes(planes: DataFrame, path: str, core: int = 1024) -> None:
    """Planes(product, y, x, value) partitioned by product and tile; an existing generation is an error."""
    tiled = planes.withColumn("tile_y", F.floor(F.col("y") / core)).withColumn("tile_x", F.floor(F.col("x") / core))
    tiled.repartition("product", "tile_y", "tile_x").sortWithinPartitions("y", "x").write.mode("errorifexists").partitionBy("product", "tile_y", "tile_x").parquet(path)


def read_window(spark: SparkSession, path: str, product: str, box: tuple[int, int, int, int], core: int = 1024) -> DataFrame:
    """One window of a plane: tiles are pruned by partition, rows by the pushed box."""
    y0, y1, x0, x1 = box
    tiles = (F.col("product") == product) & F.col("tile_y").between(y0 // core, (y1 - 1) // core) & F.col("tile_x").between(x0 // core, (x1 - 1) // core)
    return spark.read.parquet(path).where(tiles & (F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)).select("y", "x", "value")


def row_blocks(plane: DataFrame, shape: tuple[int, int], rows: int = 256):
    """Dense row blocks of a plane in order, a bounded number of rows at a time on the driver."""
    import numpy as np

    block, at = np.full((min(rows, shape[0]), shape[1]), np.nan), 0
    for r in plane.orderBy("y", "x").select("y", "x", "value").toLocalIterator(prefetchPartitions=True):
        while r["y"] >= at + len(block):
            yield block
            at += len(block)
            block = np.full((min(rows, shape[0] - at), shape[1]), np.nan)
        block[r["y"] - at, r["x"]] = np.nan if r["value"] is None else r["value"]
    while at < shape[0]:
        yield block
        at += len(block)
        if at < shape[0]:
            block = np.full((min(rows, shape[0] - at), shape[1]), np.nan)


def tile_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of a generation with counts and content hashes, for exactly-once checks."""
    return spark.read.parquet(path).groupBy("product", "tile_y", "tile_x").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("y", "x", "value")).alias("content"))
