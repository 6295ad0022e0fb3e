"""Queries of group-wise models, association graphs, sources and the finder as a whole."""

from __future__ import annotations

import os
import tempfile

import pyarrow as pa
from pyspark.sql import functions as F

from fluxweave.functions import scalars as S
from fluxweave.functions.sky import Wcs, sky_position, sky_shape
from fluxweave.operators import association, deblend, fit, multiscale, tiling
from fluxweave.plans import finder
from fluxweave.plans import inputs as I
from fluxweave.plans.detect import labelled
from fluxweave.plans.objects import measured, r
from fluxweave.plans.registry import query
from fluxweave.runtime import cut, drop_path, new_path
from fluxweave.sources import fits, products, synthetic

BEAM = (2.0, 2.0, 0.0)  # sigmas of the injected sources, in pixels
HEADER = {"CTYPE1": "RA---SIN", "CTYPE2": "DEC--SIN", "CRVAL1": 120.0, "CRVAL2": 35.0, "CRPIX1": 32.0, "CRPIX2": 250.0, "CDELT1": -0.001, "CDELT2": 0.001}


# --- group-wise models --------------------------------------------------------------------


@query("G1 G2 G3 W1 O2 O3 O1 T11")
def deblended_regions(spark, sf_dir):
    parts = deblend.deblend(labelled(spark, sf_dir).select("y", "x", "label", "snr"), least_peak=5.0)
    return parts.groupBy("label", "region").agg(F.count("*").alias("n_pixels"), F.min("y").alias("y0"), F.min("x").alias("x0"))


@query("G4 G5 G6 G7 G8 G9 G10 G11 T12")
def gaussian_fit(spark, sf_dir):
    found = cut(measured(spark, sf_dir), "measured")
    snr = found.withColumn("snr", F.col("residual") / I.NOISE)
    regions = found.join(deblend.deblend(snr.select("y", "x", "label", "snr"), least_peak=5.0), ["label", "y", "x"])
    rows = fit.fit_parents(regions.select("y", "x", F.col("label").alias("parent"), "region", F.col("residual").alias("value"), "rms"), BEAM)
    return rows.select("parent", "region", "model", "reason", *[r(c, 4) for c in ("amplitude", "cx", "cy", "sigma_1", "sigma_2")])


@query("J17 R4 touching models and their groups")
def touching_models(spark, sf_dir):
    p = I.table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    models = p.select(k.alias("id"), ((k * 37) % 1000 * 1.0).alias("cx"), ((k * 91) % 1000 * 1.0).alias("cy"), (s / 10.0 + 1).alias("sigma_1"), (s / 20.0 + 1).alias("sigma_2"), (k % 180 * 1.0).alias("angle"))
    return fit.touching_classes(models, 32.0)


@query("W9 G20 G23 G24 T8 matched filters on halo tiles")
def matched_filter(spark, sf_dir):
    plane = I.plane_inj(spark, sf_dir).withColumn("rms", F.lit(I.NOISE))
    bank = multiscale.matched_filters(plane, BEAM, core=128)
    snr = [multiscale.scale_snr(F.col(f"response_{k}"), F.col(f"effective_rms_{k}"), F.col(f"support_{k}")) for k in (1, 2, 3)]
    return bank.select("y", "x", *[F.round(c, 4).alias(f"snr_{k}") for k, c in enumerate(snr, 1)])


@query("G21", f"WITH {I.PLANE_INJ} SELECT y, x, CASE WHEN (y + x) % 5 / 4.0 >= 0.5 THEN round(value/(0.1 + x % 3*0.05), 8) END AS snr FROM plane_inj")
def scale_snr(spark, sf_dir):
    p = I.plane_inj(spark, sf_dir)
    return p.select("y", "x", F.round(multiscale.scale_snr(F.col("value"), 0.1 + F.col("x") % 3 * 0.05, (F.col("y") + F.col("x")) % 5 / 4.0), 8).alias("snr"))


@query("G22", f"WITH {I.PLANE_INJ} SELECT y, x, round(0.01 + CASE WHEN abs(value) >= 0.375 THEN value ELSE 0 END + CASE WHEN abs(value/2) >= 0.3 THEN value/2 ELSE 0 END, 9) AS value FROM plane_inj")
def denoised_plane(spark, sf_dir):
    v = F.col("value")
    total = multiscale.denoised([(v, F.lit(0.125)), (v / 2, F.lit(0.1))], F.lit(0.01), 3.0)
    return I.plane_inj(spark, sf_dir).select("y", "x", F.round(total, 9).alias("value"))


@query("G19 noise gains of the B3 scales")
def atrous_noise_gains(spark, sf_dir):
    return spark.createDataFrame([(k, float(g)) for k, g in enumerate(multiscale.atrous_gains(), 1)], "scale int, gain double")


@query("A24 detection rule", """WITH q AS (SELECT l_orderkey AS label, l_quantity/10 AS snr, l_quantity/10 + l_tax*10 AS combined FROM lineitem) SELECT label, count(*) AS n_pixels FROM q GROUP BY 1 HAVING max(combined) >= 5 AND (count(*) >= 6 OR max(snr) >= 5)""")
def detection_rule(spark, sf_dir):
    li = I.table(spark, sf_dir, "lineitem")
    q = li.select(F.col("l_orderkey").alias("label"), (F.col("l_quantity") / 10).alias("snr"), (F.col("l_quantity") / 10 + F.col("l_tax") * 10).alias("combined"))
    return multiscale.detection_rule(q, 6).select("label", "n_pixels")


@query("halo exchange", f"WITH {I.PLANE_LI} SELECT ty AS tile_y, tx AS tile_x, count(*) AS n FROM plane_li, range(8) a(ty), range(16) b(tx) WHERE y >= ty*8 - 2 AND y < ty*8 + 10 AND x >= tx*8 - 2 AND x < tx*8 + 10 GROUP BY 1, 2")
def halo_tiles(spark, sf_dir):
    t = tiling.with_halo(I.plane_li(spark, sf_dir), 8, 2).where("tile_y between 0 and 7 and tile_x between 0 and 15")
    return t.groupBy(F.col("tile_y").cast("long"), F.col("tile_x").cast("long")).agg(F.count("*").alias("n"))


# --- sky ----------------------------------------------------------------------------------


@query("F6 F7 F8 F13 F16 S10")
def wcs_transform(spark, sf_dir):
    wcs = Wcs(HEADER)
    p = I.plane_inj(spark, sf_dir).where("value > 0.6")
    one = F.lit(1.0)
    out = p.withColumn("sky", sky_position(wcs, F.col("x"), F.col("y"))).withColumn("s", sky_shape(wcs, F.col("x"), F.col("y"), one * 4, one * 0, one))
    major, minor, angle = S.ellipse_of(F.col("s.ee"), F.col("s.en"), F.col("s.nn"))
    return out.select("y", "x", r(F.col("sky.ra"), 8).alias("ra"), r(F.col("sky.dec"), 8).alias("dec"), r(major, 8).alias("major"), r(minor, 8).alias("minor"), r(angle, 4).alias("pa"))


@query("S1 S2 S9 S20 S21 S24: an image written, read by the data source with pushed bounds", f"WITH {I.PLANE_INJ} SELECT y, x, round(value, 6) AS value FROM plane_inj WHERE y >= 90 AND y < 120")
def fits_roundtrip(spark, sf_dir):
    plane = I.plane_inj(spark, sf_dir)
    high = plane.agg(F.max("y"), F.max("x")).first()
    shape = (high[0] + 1, high[1] + 1)
    folder = new_path(spark, "fits").replace("file://", "")
    os.makedirs(folder)
    path = f"{folder}/plane.fits"
    cards = [("BUNIT", "Jy/beam"), ("BMAJ", 0.005), ("BMIN", 0.004), ("BPA", 10.0), ("RESTFRQ", 1.4e8), *HEADER.items()]
    fits.write_image(path, shape, products.row_blocks(plane, shape), cards, -64)
    fits.register(spark)
    return spark.read.format("fits").load(path).where("y >= 90 and y < 120").select("y", "x", F.round("value", 6).alias("value"))


@query("S18 S19 S29 S30: tables written and read back", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS flux FROM supplier")
def fits_table_roundtrip(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        rows = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("flux")).toPandas()
        fits.write_tables(f"{folder}/t.fits", {"SOURCES": pa.Table.from_pandas(rows, preserve_index=False)})
        return spark.createDataFrame(fits.read_tables(f"{folder}/t.fits")["SOURCES"].to_pandas(), "id long, name string, flux double")


@query("S13 S14 S15 S16: planes by tile, one window read back", f"WITH {I.PLANE_LI} SELECT y, x, value FROM plane_li WHERE y >= 5 AND y < 9 AND x >= 30 AND x < 50")
def plane_window(spark, sf_dir):
    path = new_path(spark, "planes")
    products.write_planes(I.plane_li(spark, sf_dir).withColumn("product", F.lit("rms")), path, 16)
    return products.read_window(spark, path, "rms", (5, 9, 30, 50), 16)


@query("S38 S39 F20 F21")
def synthetic_image(spark, sf_dir):
    stars = [{"x": 20, "y": 30, "peak": 9.0, "sigma_1": 2.0, "sigma_2": 1.5, "angle": 30.0}]
    return synthetic.image(spark, (64, 96), seed=7, background=-0.1, noise=0.5, gradient=(0.6, -0.2), sources=stars, invalid=[(0, 4, 0, 10)]).select("y", "x", r("value"))


@query("S35 S36: rows in canonical JSON", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def json_rows(spark, sf_dir):
    path = new_path(spark, "json")
    I.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.json(path)
    return spark.read.schema("id int, name string").json(path)


@query("S34: components joined to islands, counts checked", "SELECT o_custkey AS island, count(*) AS n_components, bool_and(c_custkey IS NOT NULL) AS complete FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def island_components(spark, sf_dir):
    o, c = I.table(spark, sf_dir, "orders"), I.table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"], "left").groupBy(F.col("o_custkey").alias("island")).agg(F.count("*").alias("n_components"), F.bool_and(F.col("c_custkey").isNotNull()).alias("complete"))


@query("S6 S7 S8 header values fill in", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 3 > 0 THEN p_size*1.0 END, CASE WHEN p_size % 2 > 0 THEN p_size*2.0 END, 1.0) AS frequency FROM part")
def header_fill(spark, sf_dir):
    s = F.col("p_size")
    return I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.coalesce(F.when(s % 3 > 0, s * 1.0), F.when(s % 2 > 0, s * 2.0), F.lit(1.0)).alias("frequency"))


# --- association --------------------------------------------------------------------------

#: Features of three levels: four parts under one, three of those under one; some of the second level have two parents.
_TREE = """WITH RECURSIVE mid AS (SELECT DISTINCT p_partkey // 4 AS k FROM part), edges AS (SELECT p_partkey AS child, 10000000 + p_partkey // 4 AS parent FROM part UNION ALL SELECT 10000000 + k, 20000000 + k // 3 FROM mid UNION ALL SELECT 10000000 + k, 20000001 + k // 3 FROM mid WHERE k % 17 = 0),
feats AS (SELECT p_partkey AS feature FROM part UNION SELECT 10000000 + k FROM mid), pc AS (SELECT child, count(*) AS n, min(parent) AS parent FROM edges GROUP BY 1),
up AS (SELECT feature, feature AS ancestor, 0 AS depth FROM feats UNION ALL SELECT up.feature, pc.parent, up.depth + 1 FROM up JOIN pc ON pc.child = up.ancestor AND pc.n = 1 WHERE up.depth < 2),
lin AS (SELECT * FROM up WHERE feature NOT IN (SELECT u.feature FROM up u JOIN pc ON pc.child = u.ancestor AND pc.n > 1))"""


def _tree(spark, sf_dir):
    k = F.col("p_partkey")
    p = I.table(spark, sf_dir, "part")
    mid, j = p.select(F.floor(k / 4).alias("j")).distinct(), F.col("j")
    edges = p.select(k.alias("child"), (10_000_000 + F.floor(k / 4)).alias("parent")).unionByName(mid.select((j + 10_000_000).alias("child"), (20_000_000 + F.floor(j / 3)).alias("parent")))
    edges = edges.unionByName(mid.where("j % 17 = 0").select((j + 10_000_000).alias("child"), (20_000_001 + F.floor(j / 3)).alias("parent")))
    feats = p.select(k.alias("feature")).unionByName(mid.select((j + 10_000_000).alias("feature")))
    return association.lineages(feats, edges, 2)


@query("R5", f"{_TREE} SELECT feature, ancestor, CAST(depth AS BIGINT) AS depth FROM lin")
def feature_lineage(spark, sf_dir):
    return _tree(spark, sf_dir).select("feature", "ancestor", F.col("depth").cast("long"))


_OWNED = f"{_TREE}, att AS (SELECT p_partkey // 5 AS owner, p_partkey AS feature FROM part), sz AS (SELECT owner, count(DISTINCT feature) AS n FROM att GROUP BY 1), rc AS (SELECT owner, ancestor, count(DISTINCT feature) AS k, max(depth) AS far FROM att JOIN lin USING (feature) GROUP BY 1, 2), own AS (SELECT owner, arg_min(ancestor, (far, ancestor)) AS feature FROM rc JOIN sz USING (owner) WHERE k = n GROUP BY 1)"


def _owned(spark, sf_dir, lineage):
    att = I.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 5).alias("owner"), F.col("p_partkey").alias("feature"))
    return association.owner_features(att, lineage)


@query("R6", f"{_OWNED} SELECT owner, feature FROM own")
def owner_feature(spark, sf_dir):
    return _owned(spark, sf_dir, _tree(spark, sf_dir))


@query("R9 R15 R16", f"{_TREE}, own AS (SELECT p_partkey AS owner, p_partkey AS feature FROM part), ol AS (SELECT owner, ancestor, depth FROM own JOIN lin USING (feature)), sh AS (SELECT ancestor FROM ol GROUP BY 1 HAVING count(DISTINCT owner) >= 2) SELECT owner, arg_min(ancestor, (depth, ancestor)) AS \"group\" FROM ol WHERE ancestor IN (SELECT ancestor FROM sh) GROUP BY 1")
def hierarchy_groups(spark, sf_dir):
    own = I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("owner"), F.col("p_partkey").alias("feature"))
    return association.hierarchy_groups(own, _tree(spark, sf_dir))


def _graph(spark, sf_dir):
    """Every order is an edge to a near feature, or none: pairs, trees and cycles at any size."""
    a = F.floor(F.col("o_orderkey") / 3)
    b = a + F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey") % 5 + 1).otherwise(0)
    return I.table(spark, sf_dir, "orders").select(a.alias("a"), b.alias("b"))


_EDGES = "e AS (SELECT DISTINCT o_orderkey // 3 AS a, o_orderkey // 3 + o_custkey % 5 + 1 AS b FROM orders WHERE o_custkey % 3 = 0)"


@query("R7 2-core and components")
def cycle_core(spark, sf_dir):
    return association.two_core(_graph(spark, sf_dir))


@query("R8", f"WITH {_EDGES}, d AS (SELECT n FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY 1 HAVING count(*) = 1) SELECT a, b FROM e WHERE a IN (SELECT n FROM d) AND b IN (SELECT n FROM d)")
def isolated_pairs(spark, sf_dir):
    return association.isolated_pairs(_graph(spark, sf_dir))


@query("R11 terminal cycles and siblings")
def cycle_groups(spark, sf_dir):
    owned = I.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_custkey").alias("feature"))
    return association.cycle_groups(owned, _graph(spark, sf_dir))


_GROUPED = "SELECT c_custkey AS owner, c_nationkey AS grp FROM customer WHERE c_custkey % 3 = 0"


@query("R10", f"WITH g AS ({_GROUPED}), i AS (SELECT c_custkey AS owner, (c_custkey // 7) % 300 AS grp FROM customer WHERE c_custkey % 4 = 1 UNION SELECT c_custkey, (c_custkey // 5) % 300 FROM customer WHERE c_custkey % 8 = 1), f AS (SELECT DISTINCT * FROM i WHERE owner NOT IN (SELECT owner FROM g)), o AS (SELECT owner, min(grp) AS grp FROM f GROUP BY 1 HAVING count(*) = 1) SELECT owner, grp AS \"group\" FROM o WHERE grp IN (SELECT grp FROM o GROUP BY 1 HAVING count(*) = 1)")
def influence_recovery(spark, sf_dir):
    c = I.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    grouped = c.where("c_custkey % 3 = 0").select(k.alias("owner"), F.col("c_nationkey").alias("group"))
    inf = c.where("c_custkey % 4 = 1").select(k.alias("owner"), (F.floor(k / 7) % 300).alias("group")).unionByName(c.where("c_custkey % 8 = 1").select(k.alias("owner"), (F.floor(k / 5) % 300).alias("group")))
    return association.influence_recovery(inf, grouped)


@query("R12", "WITH c AS (SELECT c_custkey // 6 AS grp, c_custkey AS feature FROM customer UNION ALL SELECT 500000 + (c_custkey + 3) // 11, c_custkey FROM customer WHERE c_custkey % 5 = 0), p AS (SELECT c_custkey AS feature FROM customer WHERE c_custkey % 13 > 0), x AS (SELECT feature FROM (SELECT DISTINCT grp, feature FROM c) GROUP BY 1 HAVING count(*) = 1), m AS (SELECT grp, feature FROM c WHERE feature NOT IN (SELECT feature FROM p)), g AS (SELECT grp FROM m GROUP BY 1 HAVING count(*) = 1 AND min(feature) IN (SELECT feature FROM x) UNION SELECT grp FROM c WHERE grp NOT IN (SELECT grp FROM m)) SELECT DISTINCT feature + 1000000 AS owner, grp AS \"group\" FROM c WHERE grp IN (SELECT grp FROM g)")
def missing_child_groups(spark, sf_dir):
    k = F.col("c_custkey")
    c = I.table(spark, sf_dir, "customer")
    both = c.select(F.floor(k / 6).alias("group"), k.alias("feature")).unionByName(c.where("c_custkey % 5 = 0").select((500_000 + F.floor((k + 3) / 11)).alias("group"), k.alias("feature")))
    return association.missing_child_groups(c.select((k + 1_000_000).alias("owner"), k.alias("feature")), both, c.where("c_custkey % 13 > 0").select(k.alias("feature")))


@query("R13", "SELECT o_custkey AS support, list_sort(list_distinct(list(o_orderkey))) AS owners FROM orders WHERE o_orderkey % 9 > 0 GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 2")
def connected_support(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    return association.connected_support(o.select(F.col("o_orderkey").alias("owner"), F.col("o_custkey").alias("support")), o.where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("owner")))


@query("R14", "WITH g AS (SELECT c_custkey AS owner, c_custkey // 3 AS grp FROM customer), m AS (SELECT c_custkey AS owner, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 2 END AS s FROM customer), k AS (SELECT grp FROM g JOIN m USING (owner) GROUP BY 1 HAVING count(DISTINCT s) = 1) SELECT owner, grp AS \"group\" FROM g WHERE grp IN (SELECT grp FROM k)")
def supported_groups(spark, sf_dir):
    c, k = I.table(spark, sf_dir, "customer"), F.col("c_custkey")
    return association.supported_groups(c.select(k.alias("owner"), F.floor(k / 3).alias("group")), c.select(k.alias("owner"), F.when(k % 10 == 0, 1).otherwise(2).alias("support")))


@query("R17 T15", "WITH m AS (SELECT c_custkey AS component, c_custkey // 4 AS grp FROM customer WHERE c_custkey % 4 < 2), s AS (SELECT grp, min(component) AS source FROM m GROUP BY 1) SELECT c_custkey AS component, coalesce(source, c_custkey) AS source FROM customer LEFT JOIN m ON component = c_custkey LEFT JOIN s USING (grp)")
def source_memberships(spark, sf_dir):
    c, k = I.table(spark, sf_dir, "customer"), F.col("c_custkey")
    groups = c.where("c_custkey % 4 < 2").select(k.alias("component"), F.floor(k / 4).alias("group"))
    return association.constrain_memberships(c.select(k.alias("component")), groups, groups).select("component", "source")


@query("G18", "WITH RECURSIVE b AS (SELECT c_custkey AS c, 'p' || c_custkey // 3 AS g FROM customer UNION ALL SELECT c_custkey, 'f' || c_custkey % 120 FROM customer WHERE c_custkey % 5 = 0), e AS (SELECT DISTINCT x.c AS a, y.c AS b FROM b x JOIN b y USING (g)), r AS (SELECT a, a AS r FROM e UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.a) SELECT a AS component, min(r) AS \"group\" FROM r GROUP BY 1")
def reconciled_groups(spark, sf_dir):
    c, k = I.table(spark, sf_dir, "customer"), F.col("c_custkey")
    return association.reconcile_groups(c.select(k.alias("component"), F.floor(k / 3).alias("group")), c.where("c_custkey % 5 = 0").select(k.alias("component"), (k % 120).alias("group")))


# --- the whole finder ---------------------------------------------------------------------


def _image(spark, sf_dir) -> finder.Image:
    plane = cut(I.plane_inj(spark, sf_dir), "plane")
    high = plane.agg(F.max("y"), F.max("x")).first()
    return finder.Image(plane, (high[0] + 1, high[1] + 1), (2.0 * S.FWHM, 2.0 * S.FWHM, 0.0), Wcs(HEADER))


@query("E1 T1 T2 T5 T6 T7 T12 T17 T18 T19 T20 T21 T22 (compact profile)")
def find_sources(spark, sf_dir):
    found = finder.find_sources(_image(spark, sf_dir), finder.FinderConfig(profile="compact"))
    return found.sources.select("source_id", "n_components", r("flux", 4), r("centroid_x", 3), r("centroid_y", 3), r("ra", 7), r("dec", 7), "flags")


@query("E1 T8 T13 (continuum profile)")
def find_sources_continuum(spark, sf_dir):
    found = finder.find_sources(_image(spark, sf_dir), finder.FinderConfig())
    return found.components.select("component_id", "source_id", "model", "reason", r("flux", 4), r("ra", 7), r("dec", 7))


def _continuum(spark, sf_dir):
    image = _image(spark, sf_dir)
    return image, finder.FinderConfig(coarse=(48, 16), bright_sigma=9.0, fine=(12, 4))


@query("T3 T4 protected coarse windows and local noise around bright peaks")
def protected_noise(spark, sf_dir):
    image, config = _continuum(spark, sf_dir)
    plane = finder.estimate_noise(image, config)
    return plane.where("rms is not null").groupBy(F.floor(F.col("y") / 50).alias("band")).agg(F.round(F.avg("rms"), 4).alias("rms"), F.round(F.avg("background"), 4).alias("background"), F.count("*").alias("n"))


def _features(spark, sf_dir):
    image, config = _continuum(spark, sf_dir)
    plane = image.pixels.select("y", "x", "value", F.lit(0.0).alias("background"), F.lit(I.NOISE).alias("rms"))
    return image, config, plane, *finder.detect(plane, image, config)


@query("T9 persistent features of adjacent scales")
def support_topology(spark, sf_dir):
    scales = _features(spark, sf_dir)[-1]
    return scales.groupBy("scale", "label").agg(F.count("*").alias("n_pixels"), F.round(F.max("snr"), 3).alias("peak"))


@query("T10 published support of refined, restored and bridged owners")
def publication_mask(spark, sf_dir):
    _, config, _, found, scales = _features(spark, sf_dir)
    return finder.published_support(found, scales, config).select("y", "x", "label")


@query("T14 proposals of the scale hierarchy")
def hierarchy_overlap(spark, sf_dir):
    image, config, _, found, scales = _features(spark, sf_dir)
    components, regions = finder.measure_components(found, image, config)
    named = regions.join(components.select("label", "region", "component"), ["label", "region"])
    return finder.hierarchy(named, scales)


@query("T16 sources take the persistent support near them")
def source_support(spark, sf_dir):
    _, _, plane, found, scales = _features(spark, sf_dir)
    owned = found.select("y", "x", "label", "residual", "rms")
    every = finder.source_support(owned, scales, plane, 6.0)
    return every.groupBy("label").agg(F.count("*").alias("n_pixels"), F.round(F.sum("residual"), 4).alias("flux"))


@query("S22 S23 S25 S26 S28 T22: products of a run, with checksums")
def published_products(spark, sf_dir):
    image = _image(spark, sf_dir)
    found = finder.find_sources(image, finder.FinderConfig(profile="compact"))
    base = tempfile.mkdtemp()
    rows = finder.publish(found, image, f"{base}/run")
    again = [products.describe(f"{base}/run/{x['path']}", x["role"]) for x in rows]
    drop_path(spark, f"file://{base}")
    return spark.createDataFrame([(x["role"], x["path"], x["bytes"], x == y) for x, y in zip(rows, again, strict=True)], "role string, path string, bytes long, verified boolean")


