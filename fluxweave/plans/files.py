"""Queries of files, sizing and the command line."""

from __future__ import annotations

import contextlib
import io
import os
from pathlib import Path

from pyspark.sql import functions as F

from fluxweave import __version__, cli
from fluxweave.functions.sky import axis_significance
from fluxweave.operators import tiling
from fluxweave.plans import inputs as I
from fluxweave.plans import sector
from fluxweave.plans.models import HEADER
from fluxweave.plans.registry import query
from fluxweave.runtime import new_path
from fluxweave.sources import fits, products

CARDS = [("BUNIT", "Jy/beam"), ("BMAJ", 0.005), ("BMIN", 0.004), ("BPA", 10.0), ("RESTFRQ", 1.4e8), *HEADER.items()]
SHAPE = (64, 128)


def _folder(spark) -> str:
    """A folder of the shared store, which driver and executors mount."""
    path = new_path(spark, "files").replace("file://", "")
    os.makedirs(path)
    return path


def _file(spark, sf_dir, cards=(), bitpix=-64, plane=None) -> str:
    path = f"{_folder(spark)}/plane.fits"
    fits.write_plane(path, SHAPE, plane if plane is not None else I.plane_li(spark, sf_dir), [*CARDS, *cards], bitpix)
    return path


@query(
    "S3: several windows of one file in one scan",
    f"WITH {I.PLANE_LI}, w AS (SELECT * FROM (VALUES (0, 3, 9, 10, 30), (1, 7, 20, 25, 90), (2, 60, 64, 0, 128)) v(win, y0, y1, x0, x1)) SELECT win AS \"window\", y, x, value FROM plane_li JOIN w ON y >= y0 AND y < y1 AND x >= x0 AND x < x1",
)
def fits_windows(spark, sf_dir):
    return fits.load_windows(spark, _file(spark, sf_dir), [(3, 9, 10, 30), (7, 20, 25, 90), (60, 64, 0, 128)]).where("value is not null")


@query("S4 S5: the header's contract", "SELECT 64 AS height, 128 AS width, 'Jy/beam' AS unit, 0.005 AS bmaj, 0.004 AS bmin, 10.0 AS bpa, 140000000.0 AS frequency")
def fits_metadata(spark, sf_dir):
    m = fits.image_metadata(_file(spark, sf_dir))
    return spark.createDataFrame([(*m["shape"], m["unit"], *m["beam"], m["frequency"])], "height int, width int, unit string, bmaj double, bmin double, bpa double, frequency double")


@query("S9: whole numbers with scale, zero and blank", f"WITH {I.PLANE_LI}, q AS (SELECT y, x, CAST(floor(value / 1000) AS BIGINT) % 1000 AS n FROM plane_li) SELECT y, x, n * 0.5 + 10 AS value FROM q WHERE n <> 7")
def fits_scaled(spark, sf_dir):
    n = I.plane_li(spark, sf_dir).select("y", "x", (F.floor(F.col("value") / 1000) % 1000).alias("n"))
    empty = spark.range(64 * 128).select(F.floor(F.col("id") / 128).alias("y"), (F.col("id") % 128).alias("x"))
    stored = empty.join(n, ["y", "x"], "left").select("y", "x", F.coalesce("n", F.lit(7)).alias("value"))  # 7 is the blank
    path = _file(spark, sf_dir, [("BSCALE", 0.5), ("BZERO", 10.0), ("BLANK", 7)], 16, stored)
    fits.register(spark)
    return spark.read.format("fits").load(path).where("value is not null")


@query("S21: a mask, absent pixels are 0", f"WITH {I.PLANE_LI} SELECT y, count(*) AS n_pixels FROM plane_li WHERE value > 230000 GROUP BY 1")
def mask_file(spark, sf_dir):
    mask = I.plane_li(spark, sf_dir).where("value > 230000").select("y", "x", F.lit(1.0).alias("value"))
    fits.register(spark)
    return spark.read.format("fits").load(_file(spark, sf_dir, (), 8, mask)).where("value = 1").groupBy("y").agg(F.count("*").alias("n_pixels"))


@query("S17: dense blocks of rows in order", f"WITH {I.PLANE_LI} SELECT k AS block, CASE WHEN k = 3 THEN 4 ELSE 20 END AS n_rows, count(y) AS n_pixels FROM range(4) r(k) LEFT JOIN plane_li ON y // 20 = k GROUP BY 1, 2")
def row_block_stream(spark, sf_dir):
    blocks = products.row_blocks(I.plane_li(spark, sf_dir), SHAPE, 20)
    return spark.createDataFrame([(k, b.shape[0], int((b == b).sum())) for k, b in enumerate(blocks)], "block long, n_rows int, n_pixels long")


@query("S27: staging folders of stopped owners go, those of living ones stay", "SELECT 1 AS n_gone, 1 AS n_left")
def staging_reclaimed(spark, sf_dir):
    base = Path(_folder(spark))
    for name, owner in (("dead", f"999999999 {os.uname().nodename}"), ("living", f"{os.getpid()} {os.uname().nodename}")):
        (base / f".run.{name}.staging").mkdir()
        (base / f".run.{name}.staging" / "owner").write_text(owner)
    gone = products.reclaim_abandoned_staging(str(base / "run"))
    return spark.createDataFrame([(gone, len(list(base.glob(".run.*.staging"))))], "n_gone int, n_left int")


_OBJECTS = "SELECT p_partkey AS id, p_partkey*7 % 4000 AS y0, p_partkey*7 % 4000 + p_size AS y1, p_partkey*13 % 3000 AS x0, p_partkey*13 % 3000 + p_size AS x1 FROM part"


@query(
    "O5: objects of a storage core in raster order, cut by read budget",
    f"WITH o AS ({_OBJECTS}), t AS (SELECT *, y0 // 512 AS tile_y, x0 // 512 AS tile_x FROM o) SELECT id, tile_y, tile_x, CAST(floor(coalesce(sum((y1-y0)*(x1-x0)) OVER (PARTITION BY tile_y, tile_x ORDER BY y0, x0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 5000) AS BIGINT) AS batch FROM t",
)
def object_batches(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    y, x = k * 7 % 4000, k * 13 % 3000
    boxes = I.table(spark, sf_dir, "part").select(k.alias("id"), y.alias("y0"), (y + s).alias("y1"), x.alias("x0"), (x + s).alias("x1"))
    return tiling.batch_objects(boxes, (512, 512), 5000).select("id", "tile_y", "tile_x", "batch")


@query("E15: core size from a task's memory", "SELECT p_partkey AS id, greatest(0, CAST(floor(sqrt(CAST((p_size * 1000000) // (8 + p_partkey % 5) AS DOUBLE))) AS BIGINT) - 2 * (p_partkey % 300)) AS side FROM part")
def tile_core(spark, sf_dir):
    k = F.col("p_partkey")
    return I.table(spark, sf_dir, "part").select(k.alias("id"), tiling.core_side(F.col("p_size") * 1_000_000, k % 300, 8 + k % 5).alias("side"))


@query("E3 E5: the driver's memory", "SELECT n_nationkey AS id, 536870912 + 16384 * n_nationkey + 2048 * (100 + n_nationkey) AS bytes FROM nation")
def driver_memory(spark, sf_dir):
    keys = [r[0] for r in I.table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # a table of constant size
    return spark.createDataFrame([(k, sector.driver_memory_bytes((64, 100 + k), k)) for k in keys], "id long, bytes long")


@query("F15: which axes stand out of their errors", "SELECT * FROM (VALUES (1, true, true), (2, true, false), (3, false, false), (4, false, false)) v(id, major, minor)")
def axis_classes(spark, sf_dir):
    beam = (4.0, 3.0, 0.0)
    fitted = {1: ((12.0, 9.0, 0.0), (0.1, 0.1, 1.0)), 2: ((12.0, 3.01, 0.0), (0.1, 0.1, 0.1)), 3: ((4.05, 3.01, 0.0), (0.3, 0.3, 1.0)), 4: ((4.0, 3.0, 0.0), (0.1, 0.1, 1.0))}
    return spark.createDataFrame([(k, *axis_significance(*f, beam)) for k, f in fitted.items()], "id int, major boolean, minor boolean")


@query("E7: the command line tells its version", "SELECT 0 AS status, true AS told")
def command_line(spark, sf_dir):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        try:
            status = cli.main(["--version"])
        except SystemExit as e:
            status = e.code or 0
    return spark.createDataFrame([(status, said.getvalue().strip() == __version__)], "status int, told boolean")
