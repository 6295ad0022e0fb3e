"""Queries of tiling, noise, detection and labelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxweave.operators import labels, noise, pixels, tiling
from fluxweave.plans import inputs as I
from fluxweave.plans.registry import query
from fluxweave.runtime import cut

SHAPE_LI, WINDOW, STEP = (64, 128), (16, 16), (8, 8)
SHAPE_INJ = (500, 64)


def r6(c):
    return F.round(c, 6)


@query("data model: image plane in long form", f"WITH {I.PLANE} SELECT y, x, round(value, 6) AS value FROM plane")
def plane_scan(spark, sf_dir):
    return I.plane(spark, sf_dir).select("y", "x", r6("value").alias("value"))


@query(
    "P1 P4",
    """SELECT CAST(ty*5+tx AS BIGINT) AS tile, CAST(ty*30 AS BIGINT) AS y0, CAST(least(ty*30+30,100) AS BIGINT) AS y1, CAST(tx*30 AS BIGINT) AS x0,
    CAST(least(tx*30+30,130) AS BIGINT) AS x1, CAST(greatest(ty*30-4,0) AS BIGINT) AS read_y0, CAST(least(ty*30+34,100) AS BIGINT) AS read_y1,
    CAST(greatest(tx*30-6,0) AS BIGINT) AS read_x0, CAST(least(tx*30+36,130) AS BIGINT) AS read_x1
    FROM range(4) a(ty), range(5) b(tx)""",
)
def tile_plan(spark, sf_dir):
    t = tiling.plan_tiles(spark, (100, 130), (30, 30), (4, 6))
    return t.select(*[F.col(c).cast("long") for c in ("tile", "y0", "y1", "x0", "x1", "read_y0", "read_y1", "read_x0", "read_x1")])


@query("P2", f"WITH {I.PLANE_LI} SELECT CAST(floor((y+3)/10) AS BIGINT) AS tile_y, CAST(floor((x+5)/20) AS BIGINT) AS tile_x, count(*) AS n FROM plane_li GROUP BY 1, 2")
def tile_owner(spark, sf_dir):
    ty, tx = tiling.owner(F.col("y"), F.col("x"), (10, 20), (3, 5))
    return I.plane_li(spark, sf_dir).groupBy(ty.cast("long").alias("tile_y"), tx.cast("long").alias("tile_x")).agg(F.count("*").alias("n"))


_BOXES = "SELECT p_partkey AS id, (p_partkey*7) % 400 AS y0, (p_partkey*7) % 400 + p_size AS y1, (p_partkey*13) % 300 AS x0, (p_partkey*13) % 300 + p_size % 9 AS x1 FROM part"


def _boxes(spark, sf_dir):
    p = I.table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    return p.select(k.alias("id"), ((k * 7) % 400).alias("y0"), ((k * 7) % 400 + s).alias("y1"), ((k * 13) % 300).alias("x0"), ((k * 13) % 300 + s % 9).alias("x1"))


@query(
    "P3",
    f"""WITH b AS ({_BOXES}) SELECT id, CAST(ty AS BIGINT) AS tile_y, CAST(tx AS BIGINT) AS tile_x FROM b, range(20) t(ty), range(20) u(tx)
    WHERE y1 > y0 AND x1 > x0 AND ty*32 < y1 AND (ty+1)*32 > y0 AND tx*32 < x1 AND (tx+1)*32 > x0""",
)
def tiles_of_boxes(spark, sf_dir):
    t = tiling.tiles_meeting(_boxes(spark, sf_dir), (32, 32))
    return t.select("id", F.col("tile_y").cast("long"), F.col("tile_x").cast("long"))


@query(
    "P5 U1 J22",
    f"""WITH b AS ({_BOXES}) SELECT a.id AS a, c.id AS b, (a.y0 <= c.y0 AND c.y1 <= a.y1 AND a.x0 <= c.x0 AND c.x1 <= a.x1) AS holds,
    least(a.y0,c.y0) AS y0, greatest(a.y1,c.y1) AS y1, least(a.x0,c.x0) AS x0, greatest(a.x1,c.x1) AS x1
    FROM b a JOIN b c ON a.id + 115 = c.id WHERE a.y0 <= c.y1 AND c.y0 <= a.y1 AND a.x0 <= c.x1 AND c.x0 <= a.x1""",
)
def box_algebra(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    side = lambda p: b.select(*[F.col(c).alias(f"{p}_{c}") for c in b.columns])
    pairs = side("a").join(side("b"), F.col("a_id") + 115 == F.col("b_id")).where(tiling.overlap_or_touch("a", "b"))
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), tiling.contains("a", "b").alias("holds"), *tiling.union_bounds("a", "b"))


@query(
    "S12",
    f"""WITH {I.PLANE_LI}, q AS (SELECT y, x, floor(value/400000) AS value FROM plane_li)
    SELECT a.y, a.x FROM q a JOIN q b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 GROUP BY 1, 2, a.value HAVING bool_and(b.value = a.value)""",
)
def constant_square(spark, sf_dir):
    q = I.plane_li(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 400000).cast("double"))
    return pixels.constant_square_centres(q).where("constant").select("y", "x")


@query(
    "S11",
    f"""WITH {I.PLANE_LI}, q AS (SELECT y, x, floor(value/400000) AS value FROM plane_li),
    c AS (SELECT a.y, a.x FROM q a JOIN q b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 GROUP BY 1, 2, a.value HAVING bool_and(b.value = a.value))
    SELECT q.y, q.x, NOT EXISTS (SELECT 1 FROM c WHERE abs(c.y-q.y) <= 1 AND abs(c.x-q.x) <= 1) AS valid FROM q""",
)
def validity_mask(spark, sf_dir):
    q = I.plane_li(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 400000).cast("double"))
    return pixels.valid_pixels(q).select("y", "x", "valid")


#: Window starts of an axis, written out: every STEP pixels, the last one at the edge.
_STARTS = {
    64: "0 8 16 24 32 40 48",
    70: "0 8 16 24 32 40 48 54",
    128: "0 8 16 24 32 40 48 56 64 72 80 88 96 104 112",
    130: "0 8 16 24 32 40 48 56 64 72 80 88 96 104 112 114",
}


def _cells_sql(shape=SHAPE_LI) -> str:
    axes = []
    for length, name in zip(shape, "yx", strict=True):
        rows = ", ".join(f"({j}, {s}, {s} + 16, {s} + 7.5)" for j, s in enumerate(_STARTS[length].split()))
        axes.append(f"a{name} AS (SELECT * FROM (VALUES {rows}) v(cell_{name}, {name}0, {name}1, sample_{name}))")
    return ", ".join(axes)


@query(
    "A1",
    f"WITH {_cells_sql((70, 130))} SELECT CAST(cell_y AS BIGINT) AS cell_y, CAST(cell_x AS BIGINT) AS cell_x, CAST(y0 AS BIGINT) AS y0, CAST(y1 AS BIGINT) AS y1, CAST(x0 AS BIGINT) AS x0, CAST(x1 AS BIGINT) AS x1, CAST(sample_y AS DOUBLE) AS sample_y, CAST(sample_x AS DOUBLE) AS sample_x FROM ay, ax",
)
def rms_grid_plan(spark, sf_dir):
    return noise.plan_grid(spark, (70, 130), WINDOW, STEP).select(*[F.col(c).cast("long") for c in ("cell_y", "cell_x", "y0", "y1", "x0", "x1")], "sample_y", "sample_x")


_WINDOWED = f"{I.PLANE_LI}, {_cells_sql()}, w AS (SELECT cell_y, cell_x, value FROM plane_li JOIN ay ON y >= y0 AND y < y1 JOIN ax ON x >= x0 AND x < x1)"


def _clips_sql(rounds: int) -> str:
    parts = []
    for k in range(rounds):
        source = "w" if k == 0 else f"c{k}"
        parts.append(f"c{k + 1} AS (SELECT s.cell_y, s.cell_x, s.value FROM {source} s JOIN (SELECT cell_y, cell_x, median(value) AS m, stddev_pop(value) AS d FROM {source} GROUP BY 1, 2) t USING (cell_y, cell_x) WHERE abs(s.value - m) <= 3.0*d)")
    return "".join(", " + p for p in parts)


def _stats_sql(rounds: int) -> str:
    return f"WITH {_WINDOWED}{_clips_sql(rounds)} SELECT CAST(cell_y AS BIGINT) AS cell_y, CAST(cell_x AS BIGINT) AS cell_x, round(median(value), 4) AS background, round(stddev_pop(value), 4) AS rms, count(*) AS n FROM {'w' if not rounds else f'c{rounds}'} GROUP BY 1, 2"


def _stats(spark, sf_dir, rounds):
    df = noise.explode_windows(I.plane_li(spark, sf_dir), SHAPE_LI, WINDOW, STEP)
    for _ in range(rounds):
        df = noise.clip_round(df)
    return noise.plain_statistics(df).select(F.col("cell_y").cast("long"), F.col("cell_x").cast("long"), F.round("background", 4).alias("background"), F.round("rms", 4).alias("rms"), "n")


@query("A2 (relational form, no clip)", _stats_sql(0))
def rms_window_stats(spark, sf_dir):
    return _stats(spark, sf_dir, 0)


@query("A2 (relational form, one round)", _stats_sql(1))
def rms_window_clip1(spark, sf_dir):
    return _stats(spark, sf_dir, 1)


@query("A2 (relational form, two rounds)", _stats_sql(2))
def rms_window_clip2(spark, sf_dir):
    return _stats(spark, sf_dir, 2)


def clipped_grid(spark, sf_dir, protect: bool = False):
    plane = I.plane_li(spark, sf_dir)
    if protect:
        plane = plane.withColumn("protected", (F.col("y") % 20 == 3) & (F.col("x") % 40 == 7))
    return noise.window_statistics(plane, SHAPE_LI, WINDOW, STEP, protected=protect)


@query("A2 A3 T1 (production form: blocks of windows, ten rounds)", _stats_sql(10))
def rms_window_clipped(spark, sf_dir):
    return clipped_grid(spark, sf_dir).select("cell_y", "cell_x", F.round("background", 4).alias("background"), F.round("rms", 4).alias("rms"), F.col("n_retained").alias("n"))


_PROTECTED = f"""WITH {I.PLANE_LI}, {_cells_sql()}, w AS (SELECT cell_y, cell_x, value, (y % 20 = 3 AND x % 40 = 7) AS p FROM plane_li JOIN ay ON y >= y0 AND y < y1 JOIN ax ON x >= x0 AND x < x1),
ok AS (SELECT CAST(cell_y AS BIGINT) AS cell_y, CAST(cell_x AS BIGINT) AS cell_x, NOT bool_or(p) AS available, count(*) AS n_valid FROM w GROUP BY 1, 2)"""


@query("A3 (protected pixels)", f"{_PROTECTED} SELECT * FROM ok")
def rms_window_protected(spark, sf_dir):
    return clipped_grid(spark, sf_dir, True).select("cell_y", "cell_x", "available", "n_valid")


@query("A4", "SELECT CAST(count(*) AS BIGINT) AS n_cells FROM range(7) a, range(15) b")
def rms_grid_assembly(spark, sf_dir):
    cells = noise.plan_grid(spark, SHAPE_LI, WINDOW, STEP)
    grid = noise.complete_grid(clipped_grid(spark, sf_dir), cells)
    parts = [grid.where("cell_x < 8"), grid.where("cell_x >= 8")]
    return noise.check_exactly_once(parts, cells).agg(F.count("*").alias("n_cells"))


@query(
    "J30 fill: nearest available cell",
    f"""{_PROTECTED}, r AS (SELECT c.cell_y, c.cell_x, a.cell_y AS near_y, a.cell_x AS near_x, (c.cell_y-a.cell_y)*(c.cell_y-a.cell_y)+(c.cell_x-a.cell_x)*(c.cell_x-a.cell_x) AS d2,
    row_number() OVER (PARTITION BY c.cell_y, c.cell_x ORDER BY (c.cell_y-a.cell_y)*(c.cell_y-a.cell_y)+(c.cell_x-a.cell_x)*(c.cell_x-a.cell_x), a.cell_y, a.cell_x) AS k FROM ok c JOIN ok a ON a.available)
    SELECT cell_y, cell_x, near_y, near_x, d2 FROM r WHERE k = 1""",
)
def grid_nearest_fill(spark, sf_dir):
    return noise.nearest_available(clipped_grid(spark, sf_dir, True)).select("cell_y", "cell_x", "near_y", "near_x", "d2")


@query(
    "A5",
    f"{_PROTECTED} SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM ok b WHERE b.available AND abs(a.cell_y-b.cell_y) <= 1 AND abs(a.cell_x-b.cell_x) <= 1) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM ok a",
)
def clean_cell_coverage(spark, sf_dir):
    return noise.clean_coverage(clipped_grid(spark, sf_dir, True), (1, 1)).select(r6("coverage").alias("coverage"))


def _local_grid(spark, sf_dir):
    own = cut(clipped_grid(spark, sf_dir, True), "grid")
    filled = noise.fill_grid(own).select("cell_y", "cell_x", "rms", "available")
    coarse = clipped_grid(spark, sf_dir).select("cell_y", "cell_x", F.col("rms").alias("coarse_rms"))
    keys = ["cell_y", "cell_x"]
    return filled.join(own.select(*keys, F.col("rms").alias("own_rms")), keys).join(coarse, keys)


_LOCAL = f"""{_PROTECTED}{_clips_sql(10)},
coarse AS (SELECT CAST(cell_y AS BIGINT) AS cell_y, CAST(cell_x AS BIGINT) AS cell_x, stddev_pop(value) AS coarse_rms FROM c10 GROUP BY 1, 2),
own AS (SELECT ok.*, coarse_rms, CASE WHEN available THEN coarse_rms END AS own_rms FROM ok JOIN coarse USING (cell_y, cell_x)),
f AS (SELECT *, (SELECT arg_min(a.own_rms, ((a.cell_y-own.cell_y)*(a.cell_y-own.cell_y)+(a.cell_x-own.cell_x)*(a.cell_x-own.cell_x))*1000000+a.cell_y*1000+a.cell_x) FROM own a WHERE a.available) AS filled,
(SELECT max(a.own_rms) FROM own a WHERE a.available AND abs(a.cell_y-own.cell_y) <= 1 AND abs(a.cell_x-own.cell_x) <= 1) AS largest FROM own)"""


@query(
    "W2 local-noise floor",
    f"{_LOCAL} SELECT cell_y, cell_x, round(CASE WHEN available OR largest IS NULL THEN filled ELSE greatest(filled, 0.8*least(coarse_rms, largest)) END, 4) AS rms FROM f",
)
def local_noise_floor(spark, sf_dir):
    return noise.floor_local_noise(_local_grid(spark, sf_dir), 0.8, (1, 1)).select("cell_y", "cell_x", F.round("rms", 4).alias("rms"))


@query(
    "W3 crowded rule, T4",
    f"{_LOCAL} SELECT cell_y, cell_x, round(CASE WHEN largest IS NOT NULL OR coarse_rms > 1.05*filled THEN filled ELSE coarse_rms END, 4) AS rms FROM f",
)
def local_noise_crowded(spark, sf_dir):
    return noise.crowded_local_noise(_local_grid(spark, sf_dir), 1.05, (1, 1)).select("cell_y", "cell_x", F.round("rms", 4).alias("rms"))


def _axis_sql(name: str, length: int) -> str:
    """Interpolation along an axis: for each pixel two cells with signed weights.

    Centres are 7.5, 15.5, ... Before the first a line runs through it and the second, after
    the last through it and the one before: those are 8 pixels away, over the 7.5 to the edge.
    """
    last = len(_STARTS[length].split()) - 1
    cell = f"least(greatest(CAST(floor(({name} - 7.5)/8) AS BIGINT), 0), {last - 1})"
    return f"""q{name} AS (SELECT {name}, {cell} AS k FROM range({length}) r({name})),
    i{name} AS (SELECT {name}, k AS cell_{name}, 1 - ({name} - 7.5e0 - 8*k)/8 AS w{name} FROM q{name} UNION ALL SELECT {name}, k + 1, ({name} - 7.5e0 - 8*k)/8 FROM q{name})"""


@query(
    "J29 T5 bilinear background with secant edges",
    f"""WITH {_WINDOWED}, g AS (SELECT cell_y, cell_x, median(value) AS b FROM w GROUP BY 1, 2), {_axis_sql("y", 64)}, {_axis_sql("x", 128)}
    SELECT p.y, p.x, round(sum(iy.wy*ix.wx*g.b) + 0.00123, 2) AS background FROM plane_li p JOIN iy ON iy.y = p.y JOIN ix ON ix.x = p.x JOIN g ON g.cell_y = iy.cell_y AND g.cell_x = ix.cell_x GROUP BY 1, 2""",
)
def rms_bilinear(spark, sf_dir):
    plane = I.plane_li(spark, sf_dir)
    grid = cut(noise.plain_statistics(noise.explode_windows(plane, SHAPE_LI, WINDOW, STEP)), "grid")
    out = noise.interpolate(plane, grid, SHAPE_LI, WINDOW, STEP)
    # Moved off the halves of a hundredth, which are common here and where the last bit would decide.
    return out.select("y", "x", F.round(F.col("background") + 0.00123, 2).alias("background"))


_SNR = f"""WITH {I.PLANE_INJ}, s AS (SELECT y, x, value/{I.NOISE} AS snr FROM plane_inj)"""


def snr_plane(spark, sf_dir):
    value = pixels.normalize_residual(F.col("value"), F.lit(0.0), F.lit(I.NOISE))
    return I.plane_inj(spark, sf_dir).select("y", "x", "value", value.alias("snr"))


@query("P6", f"{_SNR} SELECT y, x, round(snr, 5) AS snr FROM s")
def normalize_residual(spark, sf_dir):
    return snr_plane(spark, sf_dir).select("y", "x", F.round("snr", 5).alias("snr"))


@query("P7", f"{_SNR} SELECT y, x, snr >= 3 AS island, snr > 5 AS seed FROM s")
def threshold_masks(spark, sf_dir):
    island, seed = pixels.threshold_masks(F.col("snr"), 3.0, 5.0)
    return snr_plane(spark, sf_dir).select("y", "x", island.alias("island"), seed.alias("seed"))


@query("P8", f"{_SNR} SELECT y, x FROM s WHERE snr > 10")
def bright_candidates(spark, sf_dir):
    return pixels.bright_candidates(snr_plane(spark, sf_dir), 10.0).select("y", "x")


_MASK = f"""WITH RECURSIVE {I.PLANE_INJ}, s AS (SELECT y, x, value/{I.NOISE} AS snr FROM plane_inj), m AS (SELECT y, x, snr, y*4294967296+x AS id FROM s WHERE snr >= 3),
e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1),
reach AS (SELECT id AS a, id AS r FROM m UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.a),
lab AS (SELECT m.y, m.x, m.snr, (SELECT min(r) FROM reach WHERE reach.a = m.id) AS label FROM m)"""


def labelled(spark, sf_dir, core: int = labels.TILE):
    mask = snr_plane(spark, sf_dir).where("snr >= 3")
    return mask.join(labels.label_regions(mask, core), ["y", "x"])


@query("A9 R19 connected components of a mask, over tile seams", f"{_MASK} SELECT y, x, label FROM lab")
def ccl_8(spark, sf_dir):
    return labelled(spark, sf_dir, 16).select("y", "x", "label")


_SUMMARY = f"""{_MASK}, sm AS (SELECT label, count(*) AS n_pixels, min(y) AS y0, max(y)+1 AS y1, min(x) AS x0, max(x)+1 AS x1, max(snr) AS peak,
arg_min(y, (-snr, y, x)) AS peak_y, arg_min(x, (-snr, y, x)) AS peak_x, bool_or(snr > 5) AS seeded FROM lab GROUP BY 1)"""


def summaries(spark, sf_dir):
    return labels.summarize(labelled(spark, sf_dir), F.col("snr") > 5.0)


@query("A9 A10 A11 A13", f"{_SUMMARY} SELECT label, n_pixels, y0, y1, x0, x1, round(peak, 5) AS peak, peak_y, peak_x, seeded FROM sm")
def island_summary(spark, sf_dir):
    s = summaries(spark, sf_dir)
    return s.select("label", "n_pixels", "y0", "y1", "x0", "x1", F.round("peak", 5).alias("peak"), F.col("peak_at.y").alias("peak_y"), F.col("peak_at.x").alias("peak_x"), "seeded")


@query("R1 size and seed cut", f"{_SUMMARY} SELECT label, n_pixels FROM sm WHERE seeded AND n_pixels >= 7 AND n_pixels <= 90")
def size_seed_cut(spark, sf_dir):
    return labels.cut_regions(summaries(spark, sf_dir), 7, 90).select("label", "n_pixels")


@query("R2 candidates without a size cut", f"{_SUMMARY} SELECT label, n_pixels FROM sm WHERE seeded")
def candidate_regions(spark, sf_dir):
    return labels.cut_regions(summaries(spark, sf_dir), 1).select("label", "n_pixels")


@query("O1 R1 canonical numbering", f"{_SUMMARY} SELECT row_number() OVER (ORDER BY label) AS number, printf('island-%05d', row_number() OVER (ORDER BY label)) AS island_id, label FROM sm WHERE seeded AND n_pixels >= 7")
def island_numbering(spark, sf_dir):
    return labels.number_regions(labels.cut_regions(summaries(spark, sf_dir), 7)).select("number", "island_id", "label")


@query(
    "R3 J27 seam pairs",
    f"{_MASK}, p AS (SELECT a.y, a.x, a.label, b.label AS other, b.y AS by_, b.x AS bx_ FROM lab a JOIN lab b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1) SELECT DISTINCT label FROM p WHERE y // 16 <> by_ // 16 OR x // 16 <> bx_ // 16",
)
def tile_boundary_labels(spark, sf_dir):
    mask = snr_plane(spark, sf_dir).where("snr >= 3")
    local = labels.tile_labels(mask, 16)
    pairs = labels.seam_pairs(local, 16)
    ends = pairs.select(F.col("a_local").alias("local")).union(pairs.select("b_local")).distinct()
    whole = labels.label_regions(mask, 16)
    return local.join(ends, "local").join(whole, ["y", "x"]).select("label").distinct()


@query("P9 P10 P11", f"{_SUMMARY} SELECT y, x, CASE WHEN seeded THEN sm.label ELSE 0 END AS label FROM lab JOIN sm USING (label)")
def relabelled(spark, sf_dir):
    lab = cut(labelled(spark, sf_dir).select("y", "x", "snr", "label"), "labelled")
    gone = labels.summarize(lab, F.col("snr") > 5.0).where("not seeded").select("label", F.lit(0).cast("long").alias("_to"))
    return labels.relabel(lab.withColumnRenamed("label", "old"), gone.select(F.col("label").alias("old"), F.col("_to").alias("label")), "old").select("y", "x", "label")


@query("W1 5 x 5 maxima", f"{_SNR} SELECT a.y, a.x FROM s a JOIN s b ON abs(a.y-b.y) <= 2 AND abs(a.x-b.x) <= 2 GROUP BY 1, 2, a.snr HAVING a.snr > 4 AND a.snr >= max(b.snr)")
def local_maxima_5x5(spark, sf_dir):
    return pixels.local_maxima(snr_plane(spark, sf_dir), 4.0).select("y", "x")


_UP = "up AS (SELECT a.y, a.x, arg_min(b.y, (-b.snr, b.y, b.x)) AS up_y, arg_min(b.x, (-b.snr, b.y, b.x)) AS up_x FROM m a JOIN m b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 GROUP BY 1, 2)"


@query("W11 steepest ascent", f"{_MASK}, {_UP} SELECT * FROM up")
def basin_ascent(spark, sf_dir):
    return pixels.ascent(snr_plane(spark, sf_dir).where("snr >= 3"))


_BASINS = f"""{_MASK}, {_UP}, climb AS (SELECT y, x, up_y AS ty, up_x AS tx FROM up UNION SELECT c.y, c.x, u.up_y, u.up_x FROM climb c JOIN up u ON c.ty = u.y AND c.tx = u.x),
basin AS (SELECT c.y, c.x, m.snr, c.ty*4294967296+c.tx AS label FROM climb c JOIN up u ON c.ty = u.y AND c.tx = u.x AND u.up_y = u.y AND u.up_x = u.x JOIN m ON m.y = c.y AND m.x = c.x)"""


def basin_plane(spark, sf_dir):
    mask = snr_plane(spark, sf_dir).where("snr >= 3")
    tops = pixels.basins(pixels.ascent(mask), 6)
    return mask.join(tops, ["y", "x"]).select("y", "x", "snr", labels.pixel_id(F.col("up_y"), F.col("up_x")).alias("label"))


@query("W11 basins by pointer doubling", f"{_BASINS} SELECT y, x, label FROM basin")
def basin_labels(spark, sf_dir):
    return basin_plane(spark, sf_dir).select("y", "x", "label")


@query("W12 saddles", f"{_BASINS} SELECT least(a.label,b.label) AS low, greatest(a.label,b.label) AS high, round(max(least(a.snr,b.snr)), 5) AS saddle FROM basin a JOIN basin b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 AND a.label <> b.label GROUP BY 1, 2")
def basin_saddles(spark, sf_dir):
    return pixels.saddles(basin_plane(spark, sf_dir)).select("low", "high", F.round("saddle", 5).alias("saddle"))


@query("W4 opening of the union mask", f"{_MASK}, er AS (SELECT a.y, a.x FROM m a JOIN m b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 GROUP BY 1, 2 HAVING count(*) = 9) SELECT DISTINCT m.y, m.x FROM m JOIN er ON abs(m.y-er.y) <= 1 AND abs(m.x-er.x) <= 1")
def opening_3x3(spark, sf_dir):
    return pixels.opening(snr_plane(spark, sf_dir).where("snr >= 3")).select("y", "x")


@query("W5 neighbour count", f"{_MASK} SELECT a.y, a.x, count(*) AS n_near FROM m a JOIN m b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 GROUP BY 1, 2")
def neighbor_count(spark, sf_dir):
    return pixels.neighbour_count(snr_plane(spark, sf_dir).where("snr >= 3")).select("y", "x", "n_near")


@query("W10 dilation within the image", f"{_MASK} SELECT DISTINCT s.y, s.x FROM s JOIN m ON (s.y-m.y)*(s.y-m.y)+(s.x-m.x)*(s.x-m.x) <= 9")
def dilation_disc(spark, sf_dir):
    plane = snr_plane(spark, sf_dir)
    return pixels.dilate(plane.where("snr >= 3"), pixels.disc(3.0)).join(plane.select("y", "x"), ["y", "x"])


@query("A8 peak count", f"{_SNR} SELECT count(*) AS n_peaks FROM (SELECT a.y, a.x FROM s a JOIN s b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 GROUP BY 1, 2, a.snr HAVING a.snr >= 4 AND a.snr >= max(b.snr))")
def source_count_peaks(spark, sf_dir):
    return pixels.count_peaks(snr_plane(spark, sf_dir).withColumn("value", F.col("snr")), 4.0)


_BLOCKS = f"""WITH {I.PLANE_INJ}, w AS (SELECT y // 50 AS cell_y, x // 32 AS cell_x, value FROM plane_inj)"""


@query("A6 block noise", f"{_BLOCKS}{_clips_sql(10)} SELECT CAST(cell_y AS BIGINT) AS block_y, CAST(cell_x AS BIGINT) AS block_x, round(median(value), 5) AS median, round(stddev_pop(value), 5) AS sigma FROM c10 GROUP BY 1, 2")
def block_noise(spark, sf_dir):
    dealt = I.plane_inj(spark, sf_dir).select((F.floor(F.col("y") / 50) * 64 + F.pmod("y", F.lit(50))).alias("y"), (F.floor(F.col("x") / 32) * 64 + F.pmod("x", F.lit(32))).alias("x"), "value")
    return noise.block_noise(dealt, 64).select("block_y", "block_x", F.round("median", 5).alias("median"), F.round("sigma", 5).alias("sigma"))


@query(
    "A7 F22 E2 expected sources",
    f"""WITH {I.PLANE_INJ}, w AS (SELECT y // 64 AS cell_y, x // 64 AS cell_x, value FROM plane_inj){_clips_sql(10)}, n AS (SELECT cell_y, cell_x, median(value) AS md, stddev_pop(value) AS sg FROM c10 GROUP BY 1, 2),
    r AS (SELECT median(sg) AS ref FROM n), pk AS (SELECT a.y, a.x, a.value FROM plane_inj a JOIN plane_inj b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 GROUP BY 1, 2, 3 HAVING a.value >= max(b.value))
    SELECT count(*) AS n_sources FROM pk JOIN n ON pk.y // 64 = cell_y AND pk.x // 64 = cell_x, r WHERE pk.value >= md + 4.0*least(sg, ref)""",
)
def expected_sources(spark, sf_dir):
    return noise.expected_source_count(I.plane_inj(spark, sf_dir), 4.0, 64)


def _b3_sql(source: str, column: str, out: str, d: int) -> str:
    taps = ((-2, 0.0625), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625))
    one = lambda axis: " + ".join(f"{w}*coalesce(lag(v, {-k * d}) OVER (PARTITION BY {'y' if axis == 'x' else 'x'} ORDER BY {axis}), 0)" if k < 0 else f"{w}*coalesce(lead(v, {k * d}) OVER (PARTITION BY {'y' if axis == 'x' else 'x'} ORDER BY {axis}), 0)" for k, w in taps)
    return f"{out}r AS (SELECT y, x, {one('x')} AS v FROM (SELECT y, x, {column} AS v FROM {source})), {out} AS (SELECT y, x, {one('y')} AS v FROM {out}r)"


_ATROUS = f"WITH {I.PLANE_INJ}, s0 AS (SELECT y, x, value AS s, CAST(1 AS DOUBLE) AS m FROM plane_inj)" + "".join(
    f", {_b3_sql(f's{k - 1}', 's*m', f'n{k}', d)}, {_b3_sql(f's{k - 1}', 'm', f'd{k}', d)}, s{k} AS (SELECT y, x, n{k}.v/d{k}.v AS s, d{k}.v AS m FROM n{k} JOIN d{k} USING (y, x))" for k, d in ((1, 1), (2, 2), (3, 4))
)


def _atrous_query(k: int):
    def run(spark, sf_dir):
        out = pixels.atrous(I.plane_inj(spark, sf_dir).withColumn("valid", F.lit(True)))
        return out.select("y", "x", F.round(f"coefficient_{k}", 5).alias("coefficient"), F.round(f"support_{k}", 5).alias("support"))

    run.__name__ = f"b3_scale{k}"
    return query(f"W7 W8 scale {k}", f"{_ATROUS} SELECT y, x, CASE WHEN b.m >= 0.5 THEN round(a.s - b.s, 5) END AS coefficient, round(b.m, 5) AS support FROM s{k - 1} a JOIN s{k} b USING (y, x)")(run)


b3_scale1, b3_scale2, b3_scale3 = (_atrous_query(k) for k in (1, 2, 3))


@query(
    "J21 U1 merged influence boxes",
    """WITH RECURSIVE b AS (SELECT s_suppkey AS id, greatest(0, (s_suppkey*97) % 1500 - 20) AS y0, least(1500, (s_suppkey*97) % 1500 + 21) AS y1, greatest(0, (s_suppkey*61) % 900 - 20) AS x0, least(900, (s_suppkey*61) % 900 + 21) AS x1 FROM supplier),
    e AS (SELECT a.id AS a, c.id AS b FROM b a JOIN b c ON a.y0 <= c.y1 AND c.y0 <= a.y1 AND a.x0 <= c.x1 AND c.x0 <= a.x1),
    r AS (SELECT id AS a, id AS r FROM b UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.a), g AS (SELECT a AS id, min(r) AS region FROM r GROUP BY 1)
    SELECT region, min(y0) AS y0, max(y1) AS y1, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM b JOIN g USING (id) GROUP BY 1""",
)
def box_overlap_regions(spark, sf_dir):
    k = F.col("s_suppkey")
    spots = I.table(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 97) % 1500).alias("y"), ((k * 61) % 900).alias("x"))
    return noise.merged_regions(spots, (1500, 900), 20)


@query(
    "F23 smoothstep blend",
    f"""WITH {I.PLANE_LI}, d AS (SELECT y, x, value, sqrt((y-30)*(y-30)+(x-60)*(x-60)) AS dist, CASE WHEN (y + x) % 7 > 0 THEN value*0.5 END AS fb, value*(1.0 + (x % 3 - 1)*0.5) AS fr FROM plane_li),
    t AS (SELECT *, least(greatest((30-dist)/20, 0), 1) AS t FROM d), w AS (SELECT *, CASE WHEN fb IS NULL THEN 0 ELSE t*t*(3-2*t) END AS w FROM t)
    SELECT y, x, round(CASE WHEN w > 0 THEN (1-w)*value + w*fb ELSE value END, 3) AS background, round(CASE WHEN w > 0 AND fr > value THEN greatest((1-w)*value + w*fr, value) ELSE value END, 3) AS rms FROM w""",
)
def background_blend(spark, sf_dir):
    p = I.plane_li(spark, sf_dir)
    dist = F.sqrt((F.col("y") - 30) * (F.col("y") - 30) + (F.col("x") - 60) * (F.col("x") - 60))
    fb = F.when((F.col("y") + F.col("x")) % 7 > 0, F.col("value") * 0.5)
    fr = F.col("value") * (1.0 + (F.col("x") % 3 - 1) * 0.5)
    b, r = noise.blend(noise.smooth_weight(dist, 30.0, 20.0), F.col("value"), F.col("value"), fb, fr)
    return p.select("y", "x", F.round(b, 3).alias("background"), F.round(r, 3).alias("rms"))
