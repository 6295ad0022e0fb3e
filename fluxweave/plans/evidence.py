"""Queries of grouping evidence, envelopes, adapters and pooled reports."""

from __future__ import annotations

import os

from pyspark.sql import functions as F


from fluxweave.operators import groups, measure
from fluxweave.plans import inputs as I
from fluxweave.plans import sector
from fluxweave.plans.detect import _BASINS, _MASK, basin_plane, labelled, snr_plane
from fluxweave.plans.registry import query
from fluxweave.runtime import cut, new_path


@query("J23", f"WITH {'b AS (SELECT p_partkey AS id, p_size % 3 + 1 AS scale, (p_partkey*7) % 400 AS y0, (p_partkey*7) % 400 + p_size AS y1, (p_partkey*13) % 300 AS x0, (p_partkey*13) % 300 + p_size AS x1 FROM part)'} SELECT a.id AS a_id, c.id AS b_id FROM b a JOIN b c ON a.id < c.id AND a.y0 < c.y1 AND c.y0 < a.y1 AND a.x0 < c.x1 AND c.x0 < a.x1 WHERE a.scale = c.scale OR (a.scale >= 2 AND c.scale >= 2)")
def envelope_candidates(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    b = I.table(spark, sf_dir, "part").select(k.alias("id"), (s % 3 + 1).alias("scale"), ((k * 7) % 400).alias("y0"), ((k * 7) % 400 + s).alias("y1"), ((k * 13) % 300).alias("x0"), ((k * 13) % 300 + s).alias("x1"))
    return groups.envelope_candidates(b, 3, 64)


@query("J24", f"{_BASINS}, a AS (SELECT DISTINCT l.label AS a_id, b.label AS b_id FROM lab l JOIN basin b USING (y, x) WHERE l.label < b.label) SELECT * FROM a")
def envelope_overlaps(spark, sf_dir):
    a = labelled(spark, sf_dir).select(F.col("label").alias("id"), "y", "x")
    b = basin_plane(spark, sf_dir).select(F.col("label").alias("id"), "y", "x")
    both = cut(a.unionByName(b).distinct(), "support")
    boxes = both.groupBy("id").agg(F.lit(1).alias("scale"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    return groups.envelopes_overlap(groups.envelope_candidates(boxes, 3), both)


@query("J25 J26", f"{_BASINS} SELECT DISTINCT b.label AS id, l.label FROM basin b JOIN lab l ON abs(b.y-l.y) <= 6 AND abs(b.x-l.x) <= 6")
def influence_owners(spark, sf_dir):
    return groups.influence_owners(basin_plane(spark, sf_dir).select(F.col("label").alias("id"), "y", "x"), labelled(spark, sf_dir).select("y", "x", "label"), 6)


@query("J16", f"{_MASK} SELECT y, x, arg_min(c.k, ((y-cy)*(y-cy)+(x-cx)*(x-cx), c.k)) AS id FROM m, (VALUES (1, 100, 20), (2, 106, 25), (3, 300, 40)) c(k, cy, cx) GROUP BY 1, 2")
def nearest_centre(spark, sf_dir):
    centres = [(k, y, x) for k, (y, x, _, _) in enumerate(I.SOURCES, 1)]  # three fixed centres
    offers = [F.struct(((F.col("y") - y) * (F.col("y") - y) + (F.col("x") - x) * (F.col("x") - x)).alias("d"), F.lit(k).alias("id")) for k, y, x in centres]
    return snr_plane(spark, sf_dir).where("snr >= 3").select("y", "x", F.least(*offers)["id"].alias("id"))


@query("G13 G14 G15 G16 G17 T13")
def feature_groups(spark, sf_dir):
    """Components of a ring of elongated sources, as fitted models on their own emission."""
    import math

    fits_ = []
    for k in range(8):
        t = 2 * math.pi * k / 8
        fits_.append((1, k + 1, 40 + 14 * math.cos(t), 40 + 14 * math.sin(t), 4.5, 1.6, math.degrees(t) + 90, 30.0))
    f = spark.createDataFrame(fits_, "feature long, id long, cx double, cy double, sigma_1 double, sigma_2 double, angle double, amplitude double")
    grid = spark.range(80 * 80).select(F.lit(1).cast("long").alias("feature"), F.floor(F.col("id") / 80).alias("y"), (F.col("id") % 80).alias("x"))
    total = F.lit(0.0)
    owner = []
    for _, k, cx, cy, s1, s2, a, amp in fits_:
        c, s = math.cos(math.radians(a)), math.sin(math.radians(a))
        dx, dy = F.col("x") - cx, F.col("y") - cy
        u, v = c * dx + s * dy, c * dy - s * dx
        total = total + amp * F.exp(-0.5 * (u * u / (s1 * s1) + v * v / (s2 * s2)))
        owner.append(F.struct((dx * dx + dy * dy).alias("d"), F.lit(k).cast("long").alias("k")))
    px = grid.withColumn("value", total).withColumn("rms", F.lit(1.0)).withColumn("label", F.least(*owner)["k"])
    return groups.group_components(px, f, (1.6, 1.6, 0.0)).select("feature", "id", "group", "evidence")


@query("G12")
def inadequate_fits(spark, sf_dir):
    f = spark.createDataFrame([(1, 1, 20.0, 20.0, 1.5, 1.5, 0.0, 20.0, "beam"), (1, 2, 50.0, 20.0, 1.5, 1.5, 0.0, 20.0, "beam")], "feature long, id long, cx double, cy double, sigma_1 double, sigma_2 double, angle double, amplitude double, model string")
    grid = spark.range(70 * 40).select(F.lit(1).cast("long").alias("feature"), F.floor(F.col("id") / 70).alias("y"), (F.col("id") % 70).alias("x"))
    g = lambda cx, s: F.exp(-0.5 * ((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - 20) * (F.col("y") - 20)) / (s * s))
    px = grid.withColumn("value", 20 * g(20.0, 1.5) + 20 * g(50.0, 4.0)).withColumn("rms", F.lit(0.5)).withColumn("label", F.when(F.col("x") < 35, 1).otherwise(2).cast("long"))
    return groups.inadequate_fits(px, f)


@query("J34", "SELECT coalesce(a.k, b.k) AS role, CASE WHEN a.k IS NULL THEN 'only-b' WHEN b.k IS NULL THEN 'only-a' WHEN a.h = b.h THEN 'equal' ELSE 'different' END AS state FROM (SELECT s_name AS k, s_nationkey % 3 AS h FROM supplier WHERE s_suppkey % 5 > 0) a FULL JOIN (SELECT s_name AS k, s_nationkey % 4 AS h FROM supplier WHERE s_suppkey % 7 > 0) b ON a.k = b.k")
def product_comparison(spark, sf_dir):
    s = I.table(spark, sf_dir, "supplier")
    side = lambda m, h: s.where(f"s_suppkey % {m} > 0").select(F.col("s_name").alias("role"), F.lit(1).alias("bytes"), (F.col("s_nationkey") % h).cast("string").alias("sha256"))
    return sector.compare_products(side(5, 3), side(7, 4)).select("role", "state")


_SEP = "2*degrees(asin(sqrt(least(1, pow(sin(radians(b.dec-a.dec)/2),2)+cos(radians(a.dec))*cos(radians(b.dec))*pow(sin(radians(b.ra-a.ra)/2),2)))))"


@query("A38", f"WITH {I.CATALOGUES}, cand AS (SELECT a.id AS a_id, b.id AS b_id, {_SEP} AS separation FROM catalogue_a a JOIN catalogue_b b ON abs(a.dec-b.dec) <= 0.5 WHERE {_SEP} <= 0.5), na AS (SELECT a_id, arg_min(b_id, (separation, b_id)) AS b_id FROM cand GROUP BY 1), nb AS (SELECT b_id, arg_min(a_id, (separation, a_id)) AS a_id FROM cand GROUP BY 1), m AS (SELECT a_id % 4 > 0 AS a, b_id % 5 > 0 AS b FROM na JOIN nb USING (a_id, b_id)) SELECT count(*) AS matched, count(*) FILTER (a = b) AS alike, count(*) FILTER (b AND NOT a) AS dropped, count(*) FILTER (a AND NOT b) AS added FROM m")
def catalogue_cuts(spark, sf_dir):
    return sector.compare_cuts(I.catalogue_a(spark, sf_dir).withColumn("kept", F.col("id") % 4 > 0), I.catalogue_b(spark, sf_dir).withColumn("kept", F.col("id") % 5 > 0), 0.5)


@query("A29", "WITH q AS (SELECT count(*) AS cases, CAST(sum(p_size) AS BIGINT) AS r, CAST(sum(p_size % 40) AS BIGINT) AS c, CAST(sum(p_size % 20) AS BIGINT) AS m FROM part), z AS (SELECT *, 1.959963984540054 AS z, m*1.0/r AS p FROM q) SELECT cases, r AS n_reference, c AS n_candidate, m AS n_matched, round(p, 6) AS completeness, round((p+z*z/(2*r))/(1+z*z/r) - z*sqrt(p*(1-p)/r+z*z/(4.0*r*r))/(1+z*z/r), 6) AS completeness_low FROM z")
def pooled_comparison(spark, sf_dir):
    s = F.col("p_size")
    rows = I.table(spark, sf_dir, "part").select(s.alias("n_reference"), (s % 40).alias("n_candidate"), (s % 20).alias("n_matched"), F.lit(0).alias("n_split"), F.lit(0).alias("n_merged"))
    return sector.pool_comparisons(rows).select("cases", "n_reference", "n_candidate", "n_matched", F.round("completeness", 6).alias("completeness"), F.round("completeness_low", 6).alias("completeness_low"))


@query("S37", f"WITH {I.CATALOGUES}, t AS (SELECT id, flux, dec, CAST(round(ra/15*3600*1000000) AS BIGINT) AS a, CAST(round(abs(dec)*3600*1000000) AS BIGINT) AS d FROM catalogue_a) SELECT 's' || id || ', POINT, ' || printf('%02d:%02d:%02d.%06d', a // 3600000000, a // 60000000 % 60, a // 1000000 % 60, a % 1000000) || ', ' || CASE WHEN dec < 0 THEN '-' ELSE '+' END || printf('%02d.%02d.%02d.%06d', d // 3600000000, d // 60000000 % 60, d // 1000000 % 60, d % 1000000) || ', ' || printf('%.6f', flux) || ', 144000000.0' AS line FROM t")
def sky_model_text(spark, sf_dir):
    c = I.catalogue_a(spark, sf_dir).withColumn("name", F.concat(F.lit("s"), F.col("id").cast("string")))
    return measure.sky_model_lines(c, 1.44e8)


@query("S32 S33: another finder's text catalogue", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_suppkey*0.5 AS ra, s_nationkey*1.0 AS dec, s_acctbal AS flux FROM supplier")
def external_catalogue(spark, sf_dir):
    path = new_path(spark, "external")
    s = I.table(spark, sf_dir, "supplier")
    head = spark.createDataFrame([("# made for a check",), ("# Source_id, RA, DEC, Total_flux",)], "value string")
    rows = s.select(F.concat_ws(", ", F.col("s_suppkey").cast("string"), (F.col("s_suppkey") * 0.5).cast("string"), F.col("s_nationkey").cast("string"), F.col("s_acctbal").cast("string")).alias("value"))
    head.unionByName(rows).write.text(path)
    return sector.load_external_catalogue(spark, path).select("id", "ra", "dec", "flux")


@query("F28 catalogue rows as JSON", "SELECT s_suppkey AS id, '{\"id\":' || s_suppkey || ',\"name\":\"' || s_name || '\"}' AS json FROM supplier")
def catalogue_json(spark, sf_dir):
    return I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("json"))


@query("E4 E6 sector adapter, end to end")
def sector_files(spark, sf_dir):
    from fluxweave.sources import fits, synthetic

    folder = new_path(spark, "sector").replace("file://", "")
    os.makedirs(folder)
    cards = [("BUNIT", "Jy/beam"), ("BMAJ", 0.0094), ("BMIN", 0.0075), ("BPA", 0.0), ("RESTFRQ", 1.44e8), ("CTYPE1", "RA---SIN"), ("CTYPE2", "DEC--SIN"), ("CRVAL1", 80.0), ("CRVAL2", 45.0), ("CRPIX1", 60.0), ("CRPIX2", 60.0), ("CDELT1", -0.002), ("CDELT2", 0.002)]
    stars = [{"x": 30, "y": 40, "peak": 30, "sigma_1": 2, "sigma_2": 1.6, "angle": 90}, {"x": 80, "y": 70, "peak": 45, "sigma_1": 2, "sigma_2": 1.6, "angle": 90}]
    from fluxweave.sources import products

    for name, seed in (("true", 1), ("flat", 2)):
        plane = synthetic.image(spark, (120, 120), seed=seed, noise=1.0, sources=stars)
        fits.write_image(f"{folder}/{name}.fits", (120, 120), products.row_blocks(plane, (120, 120)), cards, -64)
    out = sector.find_sector_sources(spark, f"{folder}/true.fits", f"{folder}/flat.fits", f"{folder}/out", sector.SectorConfig(5.0, 3.0))
    return sector.read_catalogue_view(spark, out["catalogue"]).select("Source_id", F.round("RA", 6).alias("RA"), F.round("DEC", 6).alias("DEC"), F.round("Total_flux", 4).alias("Total_flux"))
