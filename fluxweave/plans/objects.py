"""Queries of scales, ownership, measurement, catalogues and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxweave.functions import scalars as S
from fluxweave.operators import compare, labels, measure, pixels, support
from fluxweave.plans import inputs as I
from fluxweave.plans.detect import _BASINS, _MASK, basin_plane, labelled, snr_plane
from fluxweave.plans.registry import query
from fluxweave.runtime import cut

BEAM_AREA = 12.5


def r(c, n=6):
    return F.round(c, n).alias(c) if isinstance(c, str) else F.round(c, n)


# --- scales -------------------------------------------------------------------------------

_SCALES = f"""{_MASK}, sc AS (SELECT 1 AS scale, y, x, label FROM lab UNION ALL SELECT 2, y, x, (y // 5)*1000 + x // 5 FROM s WHERE snr >= 2.5 AND (y + x) % 2 = 0
UNION ALL SELECT 3, y, x, (y // 9)*1000 + x // 9 FROM s WHERE snr >= 4),
ed AS (SELECT DISTINCT a.scale, a.label AS child, b.label AS parent FROM sc a JOIN sc b ON b.scale = a.scale + 1 AND a.y = b.y AND a.x = b.x)"""


def scales(spark, sf_dir):
    plane = snr_plane(spark, sf_dir)
    block = lambda n: F.floor(F.col("y") / n) * 1000 + F.floor(F.col("x") / n)
    one = labelled(spark, sf_dir).select(F.lit(1).alias("scale"), "y", "x", "label")
    two = plane.where("snr >= 2.5 and (y + x) % 2 = 0").select(F.lit(2).alias("scale"), "y", "x", block(5).alias("label"))
    three = plane.where("snr >= 4").select(F.lit(3).alias("scale"), "y", "x", block(9).alias("label"))
    return one.unionByName(two).unionByName(three)


@query("J1 J2", f"{_SCALES} SELECT CAST(scale AS BIGINT) AS scale, child, parent FROM ed")
def adjacent_scale_edges(spark, sf_dir):
    return support.adjacent_edges(scales(spark, sf_dir)).select(F.col("scale").cast("long"), "child", "parent")


@query("J6 J7 J8", f"{_SCALES} SELECT CAST(scale AS BIGINT) AS scale, y, x, label FROM sc WHERE (scale, label) IN (SELECT scale, child FROM ed) OR (scale, label) IN (SELECT scale + 1, parent FROM ed)")
def persistent_features(spark, sf_dir):
    return support.persistent_features(scales(spark, sf_dir)).select(F.col("scale").cast("long"), "y", "x", "label")


@query(
    "R4 O4",
    f"""{_SCALES}, f AS (SELECT scale, label, count(*) AS n, max(s.snr) AS peak FROM sc JOIN s USING (y, x) GROUP BY 1, 2), nd AS (SELECT scale*1000000000000000 + label AS id, scale, label FROM f),
    ee AS (SELECT scale*1000000000000000 + child AS a, (scale+1)*1000000000000000 + parent AS b FROM ed), sym AS (SELECT a, b FROM ee UNION ALL SELECT b, a FROM ee UNION ALL SELECT id, id FROM nd),
    rr AS (SELECT id AS a, id AS r FROM nd UNION SELECT sym.b, rr.r FROM rr JOIN sym ON sym.a = rr.a), g AS (SELECT a AS id, min(r) AS grp FROM rr GROUP BY 1)
    SELECT CAST(arg_max(scale, (peak, n, -scale, -label)) AS BIGINT) AS scale, arg_max(label, (peak, n, -scale, -label)) AS label, round(max(peak), 5) AS peak FROM f JOIN nd USING (scale, label) JOIN g USING (id) GROUP BY grp""",
)
def scale_representatives(spark, sf_dir):
    sc = cut(scales(spark, sf_dir), "scales")
    peaks = sc.join(snr_plane(spark, sf_dir).select("y", "x", "snr"), ["y", "x"]).groupBy(F.col("scale").cast("long").alias("scale"), "label").agg(F.max("snr").alias("peak"), F.count("*").alias("n_pixels"))
    found = peaks.join(support.scale_components(sc), ["scale", "label"])
    return support.representatives(found).select("scale", "label", F.round("peak", 5).alias("peak"))


@query("J5 A24 seed semi-join", f"{_MASK} SELECT y, x, label FROM lab WHERE label IN (SELECT label FROM lab GROUP BY 1 HAVING max(snr) >= 5 AND count(*) >= 7)")
def seed_semi_join(spark, sf_dir):
    return support.seeded_regions(labelled(spark, sf_dir), F.col("snr") >= 5.0, 7).select("y", "x", "label")


# --- ownership ----------------------------------------------------------------------------

_NEAR = f"""{_BASINS}, o AS (SELECT s.y, s.x, b.label, (s.y-b.y)*(s.y-b.y)+(s.x-b.x)*(s.x-b.x) AS d2 FROM s JOIN basin b ON (s.y-b.y)*(s.y-b.y)+(s.x-b.x)*(s.x-b.x) <= 16 WHERE s.snr >= 1),
near AS (SELECT y, x, arg_min(label, (d2, label)) AS label, min(d2) AS d2 FROM o GROUP BY 1, 2)"""


@query("J9 J10 J11 J12", f"{_NEAR} SELECT y, x, label, CAST(d2 AS BIGINT) AS d2 FROM near")
def nearest_seed(spark, sf_dir):
    seeds = basin_plane(spark, sf_dir)
    return support.nearest_seed(seeds, snr_plane(spark, sf_dir).where("snr >= 1").select("y", "x"), 4.0).select("y", "x", "label", F.col("d2").cast("long"))


@query("J14 J15", f"{_NEAR} SELECT label, count(*) AS n_pixels FROM (SELECT s.y, s.x, arg_min(b.label, ((s.y-b.y)*(s.y-b.y)+(s.x-b.x)*(s.x-b.x), b.label)) AS label FROM s JOIN basin b ON (s.y-b.y)*(s.y-b.y)+(s.x-b.x)*(s.x-b.x) <= 9 GROUP BY 1, 2) GROUP BY 1")
def aperture_expand(spark, sf_dir):
    return support.aperture(basin_plane(spark, sf_dir), snr_plane(spark, sf_dir), 3.0).groupBy("label").agg(F.count("*").alias("n_pixels"))


@query(
    "J13 geodesic nearest seed",
    f"""{_BASINS}, sup AS (SELECT y, x FROM s WHERE snr >= 1.5), walk AS (SELECT y, x, label, CAST(0 AS DOUBLE) AS d, 0 AS n FROM basin
    UNION SELECT p.y, p.x, w.label, w.d + CASE WHEN p.y = w.y OR p.x = w.x THEN 1.0 ELSE sqrt(2.0) END, w.n + 1 FROM walk w JOIN sup p ON abs(p.y-w.y) <= 1 AND abs(p.x-w.x) <= 1 AND (p.y <> w.y OR p.x <> w.x)
    WHERE w.n < 3 AND w.d + CASE WHEN p.y = w.y OR p.x = w.x THEN 1.0 ELSE sqrt(2.0) END <= 3.000000001),
    b AS (SELECT y, x, arg_min(label, (round(d, 9), label)) AS label, round(min(d), 6) AS dist FROM walk GROUP BY 1, 2)
    SELECT y, x, label, dist FROM b WHERE (y, x) NOT IN (SELECT y, x FROM basin)""",
)
def geodesic_support(spark, sf_dir):
    out = support.geodesic(basin_plane(spark, sf_dir).select("y", "x", "label"), snr_plane(spark, sf_dir).where("snr >= 1.5"), 3.0)
    return out.select("y", "x", "label", r("dist"))


@query(
    "P16 P17",
    f"""{_BASINS}, sup AS (SELECT y, x FROM s WHERE snr >= 1), ms AS (SELECT s.y, s.x, b.label FROM s JOIN (SELECT label, min(y) AS y0, max(y) AS y1 FROM basin GROUP BY 1) b ON s.y = b.y0 AND s.x % 3 = 0)
    SELECT sup.y, sup.x, coalesce(f.label, m.label) AS label FROM sup LEFT JOIN basin f ON f.y = sup.y AND f.x = sup.x
    LEFT JOIN (SELECT DISTINCT ms.y, ms.x, min(ms.label) OVER (PARTITION BY ms.y, ms.x) AS label FROM ms) m ON m.y = sup.y AND m.x = sup.x AND EXISTS (SELECT 1 FROM basin q WHERE q.label = m.label AND abs(q.y-sup.y) <= 1 AND abs(q.x-sup.x) <= 1)
    WHERE coalesce(f.label, m.label) IS NOT NULL""",
)
def published_owner(spark, sf_dir):
    basin = cut(basin_plane(spark, sf_dir), "basin")
    plane = snr_plane(spark, sf_dir)
    rows = basin.groupBy("label").agg(F.min("y").alias("y"))
    measured = plane.where("x % 3 = 0").select("y", "x").join(rows, "y").groupBy("y", "x").agg(F.min("label").alias("label"))
    return support.published_owner(plane.where("snr >= 1"), measured, basin)


@query("P15", f"{_MASK}, er AS (SELECT a.y, a.x FROM m a JOIN m b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 GROUP BY 1, 2 HAVING count(*) = 9) SELECT y, x FROM m WHERE snr >= 6 OR EXISTS (SELECT 1 FROM er WHERE abs(m.y-er.y) <= 1 AND abs(m.x-er.x) <= 1)")
def refinement_kept(spark, sf_dir):
    mask = snr_plane(spark, sf_dir).where("snr >= 3")
    return pixels.opening(mask).select("y", "x").unionByName(mask.where("snr >= 6").select("y", "x")).distinct()


@query(
    "W5 W6 refinement",
    f"""{_MASK}, er AS (SELECT a.y, a.x FROM m a JOIN m b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 GROUP BY 1, 2 HAVING count(*) = 9),
    op AS (SELECT DISTINCT lab.y, lab.x, lab.label FROM lab JOIN er ON abs(lab.y-er.y) <= 1 AND abs(lab.x-er.x) <= 1), dn AS (SELECT a.y, a.x, a.label FROM op a JOIN op b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1 GROUP BY 1, 2, 3 HAVING count(*) >= 5),
    rc AS (SELECT s.y, s.x FROM s WHERE s.snr >= 2 AND EXISTS (SELECT 1 FROM op WHERE abs(s.y-op.y) + abs(s.x-op.x) <= 2)),
    fr AS (SELECT rc.y, rc.x, arg_min(op.label, ((rc.y-op.y)*(rc.y-op.y)+(rc.x-op.x)*(rc.x-op.x), op.label)) AS label FROM rc JOIN op ON (rc.y-op.y)*(rc.y-op.y)+(rc.x-op.x)*(rc.x-op.x) <= 4 WHERE (rc.y, rc.x) NOT IN (SELECT y, x FROM m) GROUP BY 1, 2)
    SELECT y, x, label FROM dn UNION SELECT y, x, label FROM lab WHERE snr >= 6 UNION SELECT lab.y, lab.x, lab.label FROM lab JOIN rc USING (y, x) UNION SELECT * FROM fr""",
)
def refined_support(spark, sf_dir):
    lab = cut(labelled(spark, sf_dir).select("y", "x", "label", "snr"), "labelled")
    return support.refined_support(lab, snr_plane(spark, sf_dir).where("snr >= 2"), 2.0)


_PARTS = f"""{_MASK}, ow AS (SELECT y, x, label AS own FROM lab), rf AS (SELECT y, x, own FROM ow WHERE x % 8 <> 3), pe AS (SELECT a.own, a.y*4294967296+a.x AS a, b.y*4294967296+b.x AS b FROM rf a JOIN rf b ON a.own = b.own AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1),
pr AS (SELECT own, a, a AS r FROM pe UNION SELECT pe.own, pe.b, pr.r FROM pr JOIN pe ON pe.a = pr.a AND pe.own = pr.own), pt AS (SELECT own, a, min(r) AS part FROM pr GROUP BY 1, 2),
bad AS (SELECT own FROM (SELECT DISTINCT own FROM ow) LEFT JOIN (SELECT own, count(DISTINCT part) AS n FROM pt GROUP BY 1) USING (own) WHERE coalesce(n, 0) <> 1)"""


def _refined(spark, sf_dir):
    original = cut(labelled(spark, sf_dir).select("y", "x", "label"), "original")
    return original, original.where("x % 8 <> 3")


@query("U6 R19", f"{_PARTS} SELECT own AS label FROM bad")
def owners_to_restore(spark, sf_dir):
    return support.owners_to_restore(*_refined(spark, sf_dir))


@query("U7 R18", f"{_PARTS} SELECT y, x, own AS label FROM rf WHERE own NOT IN (SELECT own FROM bad) UNION ALL SELECT y, x, own FROM ow WHERE own IN (SELECT own FROM bad)")
def restored_owners(spark, sf_dir):
    original, refined = _refined(spark, sf_dir)
    return support.restore(original, refined, support.owners_to_restore(original, refined)).select("y", "x", "label")


@query(
    "U4 U5 bridges",
    f"""{_PARTS}, rm AS (SELECT ow.* FROM ow ANTI JOIN rf USING (y, x)), ge AS (SELECT a.own, a.y*4294967296+a.x AS a, b.y*4294967296+b.x AS b FROM rm a JOIN rm b ON a.own = b.own AND abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1),
    gr AS (SELECT own, a, a AS r FROM ge UNION SELECT ge.own, ge.b, gr.r FROM gr JOIN ge ON ge.a = gr.a AND ge.own = gr.own), rg AS (SELECT own, a, min(r) AS region FROM gr GROUP BY 1, 2),
    q AS (SELECT rm.y, rm.x, rm.own, rg.region FROM rm JOIN rg ON rg.own = rm.own AND rg.a = rm.y*4294967296+rm.x), tp AS (SELECT q.own, q.region, count(DISTINCT pt.part) AS n FROM q JOIN rf ON rf.own = q.own AND abs(rf.y-q.y) <= 1 AND abs(rf.x-q.x) <= 1 JOIN pt ON pt.own = rf.own AND pt.a = rf.y*4294967296+rf.x GROUP BY 1, 2)
    SELECT q.y, q.x, q.own AS label FROM q JOIN tp USING (own, region) WHERE n >= 2""",
)
def bridge_regions(spark, sf_dir):
    return support.bridges(*_refined(spark, sf_dir)).select("y", "x", "label")


@query("J3", f"{_BASINS} SELECT b.label AS owner, list_sort(list_distinct(list(printf('island-%d', lab.label % 100000)))) AS island_ids FROM basin b JOIN lab USING (y, x) GROUP BY 1")
def islands_by_owner(spark, sf_dir):
    pairs = support.overlap_edges(basin_plane(spark, sf_dir), labelled(spark, sf_dir))
    named = pairs.select(F.col("child").alias("owner"), F.format_string("island-%d", F.col("parent") % 100000).alias("island_id"))
    return support.owner_islands(named)


@query(
    "J4",
    """SELECT p_partkey AS component, CASE WHEN p_size % 3 = 0 THEN ['own-' || p_size] ELSE CASE WHEN p_size % 2 = 0 THEN ['up-' || p_size % 10] ELSE CAST([] AS VARCHAR[]) END END AS islands FROM part""",
)
def islands_by_component(spark, sf_dir):
    p = I.table(spark, sf_dir, "part")
    own = p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("component"), F.array(F.concat(F.lit("own-"), F.col("p_size").cast("string"))).alias("islands"))
    parents = p.select(F.col("p_partkey").alias("component"), F.concat_ws("-", F.col("p_size") % 2, F.col("p_size") % 10).alias("parent"))
    ups = p.where("p_size % 2 = 0").select(F.concat_ws("-", F.col("p_size") % 2, F.col("p_size") % 10).alias("parent"), F.array(F.concat(F.lit("up-"), (F.col("p_size") % 10).cast("string"))).alias("islands")).distinct()
    return support.component_islands(own, parents, ups)


@query("J19 J20 fit parents", f"{_BASINS}, pb AS (SELECT DISTINCT a.label AS a, b.label AS b FROM basin a JOIN basin b ON abs(a.y-b.y) <= 7 AND abs(a.x-b.x) <= 7), pr AS (SELECT a, a AS r FROM pb UNION SELECT pb.b, pr.r FROM pr JOIN pb ON pb.a = pr.a) SELECT a AS label, min(r) AS parent FROM pr GROUP BY 1")
def fit_parents(spark, sf_dir):
    return support.fit_parents(cut(basin_plane(spark, sf_dir), "basin"), 3)


@query("J18 transitive merge of groups", """WITH RECURSIVE g AS (SELECT DISTINCT o_custkey % 400 AS grp, o_orderkey % 900 * 7 AS label FROM orders), e AS (SELECT DISTINCT a.label AS a, b.label AS b FROM g a JOIN g b USING (grp)), r AS (SELECT a, a AS r FROM e UNION SELECT e.b, r.r FROM r JOIN e ON e.a = r.a) SELECT a AS label, min(r) AS merged FROM r GROUP BY 1""")
def merged_groups(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    return support.merge_label_groups(o.select((F.col("o_custkey") % 400).alias("group"), (F.col("o_orderkey") % 900 * 7).alias("label")).distinct())


@query("T11 running offset", "SELECT p_size AS parent, n AS n_components, CAST(coalesce(sum(n) OVER (ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1)")
def component_numbering(spark, sf_dir):
    p = I.table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("parent")).agg(F.count("*").alias("n_components"))
    return support.running_offset(p, "parent")


# --- measurement --------------------------------------------------------------------------

_MEAS = f"{_MASK}, px AS (SELECT y, x, label, round(snr*{I.NOISE}, 6) AS residual, {I.NOISE} + (x % 5)*0.01 AS rms FROM lab)"


def measured(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    return lab.select("y", "x", "label", F.round(F.col("snr") * I.NOISE, 6).alias("residual"), (F.lit(I.NOISE) + (F.col("x") % 5) * 0.01).alias("rms"))


@query(
    "A14 A15 moments",
    f"""{_MEAS}, a AS (SELECT label, sum(residual) AS s, sum(residual*x)/sum(residual) AS cx, sum(residual*y)/sum(residual) AS cy, count(*) AS n, max(residual) AS peak, avg(rms) AS lr FROM px GROUP BY 1),
    b AS (SELECT px.label, sum(residual*(x-cx)*(x-cx))/any_value(s) AS xx, sum(residual*(x-cx)*(y-cy))/any_value(s) AS xy, sum(residual*(y-cy)*(y-cy))/any_value(s) AS yy FROM px JOIN a USING (label) GROUP BY 1),
    c AS (SELECT *, sqrt((xx-yy)*(xx-yy)+4*xy*xy) AS d FROM a JOIN b USING (label)), fin AS (SELECT *, n >= 3 AND (xx+yy-d)/2 > 1e-12*(xx+yy+d)/2 AND xx+yy+d > 0 AS ok FROM c)
    SELECT label, n AS n_pixels, round(s/{BEAM_AREA}, 5) AS flux, peak, round(lr, 5) AS local_rms, CASE WHEN n < 3 THEN 'underdetermined-region' WHEN NOT ok THEN 'singular-covariance' END AS reason,
    CASE WHEN ok THEN round(cx, 5) END AS centroid_x, CASE WHEN ok THEN round(cy, 5) END AS centroid_y, CASE WHEN ok THEN round(sqrt((xx+yy+d)/2), 5) END AS sigma_1, CASE WHEN ok THEN round(sqrt((xx+yy-d)/2), 5) END AS sigma_2 FROM fin""",
)
def moments(spark, sf_dir):
    m = measure.moments(cut(measured(spark, sf_dir), "measured"), 1.0, BEAM_AREA)
    return m.select("label", "n_pixels", r("flux", 5), "peak", r("local_rms", 5), "reason", r("centroid_x", 5), r("centroid_y", 5), r("sigma_1", 5), r("sigma_2", 5))


@query("A19 A16 positive moments", f"{_MEAS} SELECT label, round(sum(greatest(residual-0.4,0)*x)/sum(greatest(residual-0.4,0)), 5) AS centroid_x, round(sum(greatest(residual-0.4,0)*y)/sum(greatest(residual-0.4,0)), 5) AS centroid_y FROM px GROUP BY 1 HAVING sum(greatest(residual-0.4,0)) > 0")
def positive_moments(spark, sf_dir):
    m = measure.positive_moments(cut(measured(spark, sf_dir).withColumn("residual", F.col("residual") - 0.4), "measured"))
    return m.select("label", r("centroid_x", 5), r("centroid_y", 5))


@query(
    "A17 segment position",
    f"""{_MEAS}, q AS (SELECT y, x, label, residual - 0.42 AS w FROM px), a AS (SELECT label, sum(w) AS s, sum(abs(w)) AS ab, sum(w*x) AS sx, sum(w*y) AS sy, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM q GROUP BY 1),
    b AS (SELECT *, s > 0 AND s > ab*n*pow(2,-40) AND sx/s BETWEEN x0-1e-9 AND x1+1e-9 AND sy/s BETWEEN y0-1e-9 AND y1+1e-9 AS ok FROM a) SELECT label, ok AS available, CASE WHEN ok THEN round(sx/s, 5) END AS centroid_x, CASE WHEN ok THEN round(sy/s, 5) END AS centroid_y FROM b""",
)
def segment_position(spark, sf_dir):
    m = measure.segment_position(measured(spark, sf_dir).withColumn("residual", F.col("residual") - 0.42))
    return m.select("label", "available", r("centroid_x", 5), r("centroid_y", 5))


@query(
    "A18 T18 segment rows",
    f"""{_MEAS}, a AS (SELECT label, sum(residual) AS s, sum(residual*x)/sum(residual) AS cx, sum(residual*y)/sum(residual) AS cy, max(residual) AS peak FROM px GROUP BY 1), p AS (SELECT label, sum(residual) - 3 AS ap FROM px GROUP BY 1)
    SELECT label, round(cx, 5) AS centroid_x, round(cy, 5) AS centroid_y, peak, round(CASE WHEN ap > 0 THEN ap ELSE s END/{BEAM_AREA}, 5) AS flux, ap > 0 AS signed FROM a JOIN p USING (label)""",
)
def segment_rows(spark, sf_dir):
    own = cut(measured(spark, sf_dir), "owned")
    extra = own.groupBy("label").agg(F.min("y").alias("y"), F.min("x").alias("x"), F.lit(-3.0).alias("residual"))
    rows = measure.segment_rows(own, own.select("y", "x", "label", "residual").unionByName(extra.select("y", "x", "label", "residual")), BEAM_AREA)
    return rows.select("label", r("centroid_x", 5), r("centroid_y", 5), "peak", r("flux", 5), F.array_contains("flags", "source-owned-signed-aperture").alias("signed"))


@query("A20 segment local RMS", f"{_MEAS} SELECT label, round(median(rms), 6) AS local_rms FROM px GROUP BY 1")
def segment_local_rms(spark, sf_dir):
    return measure.local_rms(measured(spark, sf_dir)).select("label", r("local_rms"))


@query("A21 A22 T17 F19 island rows", f"{_MEAS} SELECT label, count(*) AS n_pixels, round(sum(residual)/{BEAM_AREA}, 5) AS flux, round(median(rms), 6) AS local_rms, round(avg(residual), 5) AS mean_brightness, 'island-detection-' || (label // 4294967296) || '-' || (label % 4294967296) AS island_id FROM px GROUP BY 1")
def island_rows(spark, sf_dir):
    return measure.island_rows(measured(spark, sf_dir), BEAM_AREA).select("label", "n_pixels", r("flux", 5), r("local_rms"), r("mean_brightness", 5), "island_id")


@query("A16 component records", f"{_MEAS}, d AS (SELECT label, md5(y || ',' || x) AS m FROM px) SELECT label, sha256('demo,' || count(*) || ',' || bit_xor(CAST('0x' || m[1:15] AS BIGINT)) || ',' || bit_xor(CAST('0x' || m[16:30] AS BIGINT))) AS record_id FROM d GROUP BY 1")
def component_records(spark, sf_dir):
    return measure.component_records(measured(spark, sf_dir), "demo").select("label", "record_id")


#: Every customer is a component; some sources have many, some one, some none.
_COMPONENTS = "SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey % 40 + 1 END AS source_id, c_custkey AS component_id, c_acctbal/1000 AS flux, CASE WHEN c_custkey % 53 > 0 THEN c_custkey % 8 * 0.01e0 + 0.01e0 END AS flux_error, c_nationkey*2e0 + 1 AS major, c_nationkey + 0.5e0 AS minor, c_custkey % 180 * 1e0 AS angle FROM customer"


def _components(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    source = F.when(k % 3 == 0, k).otherwise(k % 40 + 1)
    error = F.when(k % 53 > 0, k % 8 * 0.01 + 0.01)
    return I.table(spark, sf_dir, "customer").select(source.alias("source_id"), k.alias("component_id"), (F.col("c_acctbal") / 1000).alias("flux"), error.alias("flux_error"), (n * 2.0 + 1).alias("major"), (n + 0.5).alias("minor"), (k % 180 * 1.0).alias("angle"))


@query("A23 quadrature error", f"WITH c AS ({_COMPONENTS}) SELECT source_id, round(sum(flux), 6) AS flux, CASE WHEN count(flux_error) = count(*) THEN round(sqrt(sum(flux_error*flux_error)), 6) END AS flux_error, count(*) AS n_components FROM c GROUP BY 1")
def quadrature_error(spark, sf_dir):
    return measure.summed_flux(_components(spark, sf_dir), "source_id").select("source_id", r("flux"), r("flux_error"), "n_components")


@query(
    "T20 T21 P18 source rows",
    f"""WITH c AS ({_COMPONENTS}), g AS (SELECT source_id, sum(flux) AS f, count(*) AS n, any_value(major) AS mj FROM c GROUP BY 1)
    SELECT s_suppkey AS source_id, round(coalesce(f, s_acctbal), 6) AS flux, coalesce(n, 0) AS n_components, CASE WHEN n = 1 THEN mj END AS major, f IS NULL AS aperture_only, n IS NOT NULL OR s_acctbal > 0 AS published FROM supplier LEFT JOIN g ON s_suppkey = source_id""",
)
def source_rows(spark, sf_dir):
    s = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_acctbal").alias("flux"))
    rows = measure.source_rows(s, cut(_components(spark, sf_dir), "components"))
    rows = rows.join(s.withColumnRenamed("flux", "ap"), "source_id")
    return rows.select("source_id", r("flux"), "n_components", "major", F.array_contains("flags", "aperture-flux-without-fitted-component").alias("aperture_only"), measure.publishable(F.col("n_components") > 0, F.col("ap")).alias("published"))


@query(
    "S29 S31 compatibility view",
    """SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS "Source_id", (s_suppkey*7 % 360)*1.0 AS "RA", (s_suppkey % 90)*1.0 AS "DEC", n_nationkey + 0.5 AS "Isl_Total_flux", s_acctbal AS "Total_flux",
    CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey*0.1 WHEN s_suppkey % 3 = 1 THEN 0.0 ELSE CAST('nan' AS DOUBLE) END AS "DC_Maj", 0.01 AS "E_RA", 0.02 AS "E_DEC" FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def compat_view(spark, sf_dir):
    s = I.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    src = s.select(k.alias("source_id"), F.col("s_nationkey").alias("island_id"), ((k * 7 % 360) * 1.0).cast("double").alias("ra"), ((k % 90) * 1.0).cast("double").alias("dec"), F.lit(0.01).alias("ra_error"), F.lit(0.02).alias("dec_error"), F.col("s_acctbal").alias("flux"),
        F.when(k % 3 == 0, k * 0.1).cast("double").alias("full_major"), F.lit(None).cast("double").alias("axis_major"), F.when(k % 3 == 1, F.array(F.lit("unresolved"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    isl = I.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("island_id"), (F.col("n_nationkey") + 0.5).cast("double").alias("flux"))
    return measure.compatibility_view(src, isl)


@query("T23 dispositions", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN 'published' WHEN a.id IS NOT NULL THEN 'withheld' ELSE 'unexpected' END AS disposition FROM (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 > 0) a FULL JOIN (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 > 0) b ON a.id = b.id")
def dispositions(spark, sf_dir):
    c = I.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return measure.dispositions(c.where("id % 3 > 0"), c.where("id % 4 > 0"))


# --- scalar functions ---------------------------------------------------------------------

_SHAPE = "SELECT p_partkey AS id, (p_size + 20)*1.0 AS mj, (p_size % 7 + 8)*1.0 AS mn, (p_partkey % 180)*1.0 AS pa FROM part"


def _shapes(spark, sf_dir):
    p = I.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") + 20.0).alias("mj"), (F.col("p_size") % 7 + 8.0).alias("mn"), (F.col("p_partkey") % 180 + 0.0).alias("pa"))


@query("F1 F2 F3 F4", "SELECT p_partkey AS id, round(pi()*radians(p_size/100.0)*radians(p_size/200.0)/(4*ln(2))*1e6, 6) AS beam, round(p_retailprice*2*pi()*2*1.5*3/7, 3) AS flux, CAST(greatest(1, ceil(pi()/(4*ln(2))*p_size*p_size/20)) AS BIGINT) AS least_a, CAST(greatest(6, CAST(floor(p_size/3.0) AS BIGINT)) AS BIGINT) AS least_b FROM part")
def beam_area(spark, sf_dir):
    s = F.col("p_size")
    return I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), r(S.beam_solid_angle(s / 100.0, s / 200.0) * 1e6).alias("beam"), r(S.gaussian_flux(F.col("p_retailprice"), F.lit(2.0), F.lit(1.5), F.lit(3.0), F.lit(7.0)), 3).alias("flux"),
        S.least_island_pixels(s / 2.0, s / 10.0).alias("least_a"), S.least_island_pixels_external(s * 1.0).alias("least_b"))


@query(
    "F9 F10 F11 ellipse round trip",
    f"""WITH s AS ({_SHAPE}) SELECT id, round(pow(mj/2,2)*pow(cos(radians(pa)),2)+pow(mn/2,2)*pow(sin(radians(pa)),2), 4) AS xx, round((pow(mj/2,2)-pow(mn/2,2))*sin(radians(pa))*cos(radians(pa)), 4) AS xy, round(mj, 4) AS major, round(mn, 4) AS minor, round(pa, 3) % 180 AS angle FROM s""",
)
def ellipse_covariance(spark, sf_dir):
    s = _shapes(spark, sf_dir)
    xx, xy, _ = S.pixel_covariance(F.col("mj") / 2, F.col("mn") / 2, F.col("pa"))
    major, minor, angle = S.ellipse_of(*S.sky_covariance(F.col("mj"), F.col("mn"), F.col("pa")))
    return s.select("id", r(xx, 4).alias("xx"), r(xy, 4).alias("xy"), r(major, 4).alias("major"), r(minor, 4).alias("minor"), (r(angle, 3) % 180).alias("angle"))


@query(
    "F12 deconvolution",
    f"""WITH s AS ({_SHAPE}), k AS (SELECT *, 8*ln(2) AS c FROM s), v AS (SELECT id, (mj*mj*pow(sin(radians(pa)),2)+mn*mn*pow(cos(radians(pa)),2) - 225)/c AS ee, (mj*mj-mn*mn)*sin(radians(pa))*cos(radians(pa))/c AS en, (mj*mj*pow(cos(radians(pa)),2)+mn*mn*pow(sin(radians(pa)),2) - 225)/c AS nn, 1e-6*(mj*mj+mn*mn)/c AS fl, c FROM k),
    e AS (SELECT id, (ee+nn)/2 AS m, sqrt(pow((nn-ee)/2,2)+en*en) AS h, fl, c FROM v)
    SELECT id, CASE WHEN m+h <= fl THEN 'unresolved' WHEN m-h <= fl THEN 'major-axis-only' ELSE 'resolved' END AS state, CASE WHEN m+h > fl THEN round(sqrt(c*(m+h)), 4) END AS major, CASE WHEN m-h > fl THEN round(sqrt(c*(m-h)), 4) END AS minor FROM e""",
)
def deconvolve_2x2(spark, sf_dir):
    s = _shapes(spark, sf_dir)
    d = S.deconvolve((F.col("mj"), F.col("mn"), F.col("pa")), (F.lit(15.0), F.lit(15.0), F.lit(0.0)))
    return s.select("id", d.alias("d")).select("id", "d.state", F.round("d.major", 4).alias("major"), F.round("d.minor", 4).alias("minor"))


@query("F14 P12 P13 P14", "SELECT p_partkey AS id, ln(p_retailprice/1000) > 5*sqrt(2)*0.01 AS extended, p_size > 30 OR p_size*p_size > 1500 AS deferred, 6*p_size <= 96 AND 6*p_size*p_partkey <= 100000 AS admitted FROM part")
def admission(spark, sf_dir):
    price, s = F.col("p_retailprice"), F.col("p_size")
    return I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.extended(price, price * 0.01, F.lit(1000.0), F.lit(10.0)).alias("extended"), S.deferred_parent(s, s * s, 30, 1500).alias("deferred"), S.joint_fit_admitted(s, F.col("p_partkey"), 96, 100_000).alias("admitted"))


@query("F24 criterion", "SELECT p_partkey AS id, p_retailprice/4 + 6*ln(greatest(1, p_size*20/4.0)) < p_retailprice*1.01/4 + 3*ln(greatest(1, p_size*20/4.0)) AS free FROM part")
def information_criterion(spark, sf_dir):
    price, n = F.col("p_retailprice"), F.col("p_size") * 20
    return I.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), S.free_fit_preferred(price, price * 1.01, n, F.lit(4.0), F.lit(6), F.lit(3)).alias("free"))


@query("F17 F18 stable identity", "SELECT c_custkey AS id, 'src-' || sha256('space' || c_name || chr(0) || CAST(c_nationkey AS VARCHAR) || chr(0)) AS stable_id FROM customer")
def stable_id_sha256(spark, sf_dir):
    return I.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), S.stable_id("space", "src", F.col("c_name"), F.col("c_nationkey")).alias("stable_id"))


@query(
    "F25 F26 S37 sexagesimal text",
    f"""WITH {I.CATALOGUES}, t AS (SELECT id, dec, CAST(round(ra/15*3600*1000000) AS BIGINT) AS a, CAST(round(abs(dec)*3600*1000000) AS BIGINT) AS d FROM catalogue_a)
    SELECT id, printf('%02d:%02d:%02d.%06d', a // 3600000000, a // 60000000 % 60, a // 1000000 % 60, a % 1000000) AS ra_text, CASE WHEN dec < 0 THEN '-' ELSE '+' END || printf('%02d.%02d.%02d.%06d', d // 3600000000, d // 60000000 % 60, d // 1000000 % 60, d % 1000000) AS dec_text FROM t""",
)
def sexagesimal(spark, sf_dir):
    return I.catalogue_a(spark, sf_dir).select("id", S.right_ascension_text(F.col("ra")).alias("ra_text"), S.declination_text(F.col("dec")).alias("dec_text"))


@query("U8 flag sets", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 6 = 0 THEN 1.0 WHEN c_custkey % 4 = 0 OR c_custkey % 6 = 0 THEN 0.0 ELSE round(CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END + 1.0, 1)/ (CASE WHEN c_custkey % 2 = 0 THEN 2.0 ELSE 3.0 END) END AS likeness FROM customer")
def flag_jaccard(spark, sf_dir):
    k = F.col("c_custkey")
    none = F.array().cast("array<string>")
    a = F.when(k % 4 == 0, none).otherwise(F.array(F.lit("edge"), F.when(k % 2 == 0, "blend").otherwise("noisy")))
    b = F.when(k % 6 == 0, none).otherwise(F.array(F.lit("edge"), F.lit("blend")))
    return I.table(spark, sf_dir, "customer").select(k.alias("id"), S.flag_jaccard(a, b).alias("likeness"))


@query("A30", "WITH c AS (SELECT p_brand, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS k, count(*) AS n FROM part GROUP BY 1), z AS (SELECT *, 1.959963984540054 AS z, k*1.0/n AS p FROM c) SELECT p_brand, round(greatest(0, (p+z*z/(2*n))/(1+z*z/n) - z*sqrt(p*(1-p)/n+z*z/(4*n*n))/(1+z*z/n)), 6) AS low, round(least(1, (p+z*z/(2*n))/(1+z*z/n) + z*sqrt(p*(1-p)/n+z*z/(4*n*n))/(1+z*z/n)), 6) AS high FROM z")
def wilson_interval(spark, sf_dir):
    g = I.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 25).alias("k"), F.count("*").alias("n"))
    low, high = S.wilson_interval(F.col("k"), F.col("n"))
    return g.select("p_brand", r(low).alias("low"), r(high).alias("high"))


@query("F27", "SELECT event_id, CASE WHEN event_id % 5 > 0 THEN value END AS value FROM events")
def optional_float(spark, sf_dir):
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return I.table(spark, sf_dir, "events").select("event_id", S.optional_float(v).alias("value"))


# --- comparison ---------------------------------------------------------------------------

_SEP = "2*degrees(asin(sqrt(least(1, pow(sin(radians(b.dec-a.dec)/2),2)+cos(radians(a.dec))*cos(radians(b.dec))*pow(sin(radians(b.ra-a.ra)/2),2)))))"
_CAND = f"WITH {I.CATALOGUES}, cand AS (SELECT a.id AS a_id, b.id AS b_id, {_SEP} AS separation, a.flux AS a_flux, b.flux AS b_flux FROM catalogue_a a JOIN catalogue_b b ON abs(a.dec-b.dec) <= 1.0 WHERE {_SEP} <= 1.0)"


def candidates(spark, sf_dir):
    return compare.match_candidates(I.catalogue_a(spark, sf_dir), I.catalogue_b(spark, sf_dir), 1.0)


@query("F5 J31 gate", f"{_CAND} SELECT a_id, b_id, round(separation, 6) AS separation FROM cand")
def haversine_match_gate(spark, sf_dir):
    return candidates(spark, sf_dir).select("a_id", "b_id", r("separation"))


@query("J31 mutual nearest", f"{_CAND}, na AS (SELECT a_id, arg_min(b_id, (separation, b_id)) AS b_id FROM cand GROUP BY 1), nb AS (SELECT b_id, arg_min(a_id, (separation, a_id)) AS a_id FROM cand GROUP BY 1) SELECT a_id, b_id FROM na JOIN nb USING (a_id, b_id)")
def mutual_nearest_match(spark, sf_dir):
    return compare.mutual_pairs(candidates(spark, sf_dir))


@query("J31 assignment")
def assignment_match(spark, sf_dir):
    return compare.assign_matches(candidates(spark, sf_dir)).select("a_id", "b_id", r("separation"))


@query(
    "A27",
    f"""{_CAND}, na AS (SELECT a_id, arg_min(b_id, (separation, b_id)) AS b_id FROM cand GROUP BY 1), nb AS (SELECT b_id, arg_min(a_id, (separation, a_id)) AS a_id FROM cand GROUP BY 1), mt AS (SELECT * FROM cand JOIN na USING (a_id, b_id) JOIN nb USING (a_id, b_id)),
    na_ AS (SELECT count(*) AS n FROM catalogue_a), nb_ AS (SELECT count(*) AS n FROM catalogue_b)
    SELECT na_.n AS n_reference, nb_.n AS n_candidate, count(*) AS n_matched, round(median(separation), 6) AS median_separation, round(median(abs(b_flux-a_flux)/a_flux), 6) AS median_flux_fraction, round(count(*)*1.0/na_.n, 6) AS completeness, round(count(*)*1.0/nb_.n, 6) AS reliability FROM mt, na_, nb_ GROUP BY na_.n, nb_.n""",
)
def catalogue_comparison(spark, sf_dir):
    m = compare.mutual_nearest(cut(candidates(spark, sf_dir), "candidates"))
    out = compare.compare_catalogues(I.catalogue_a(spark, sf_dir), I.catalogue_b(spark, sf_dir), m)
    return out.select("n_reference", "n_candidate", "n_matched", r("median_separation"), r("median_flux_fraction"), r("completeness"), r("reliability"))


_MASKS = f"WITH {I.PLANE_INJ}, q AS (SELECT value > 0.3 AS r, value + (x % 3)*0.05 > 0.35 AS c, (y + x) % 11 > 0 AS v, value + 1 AS ra, CASE WHEN x % 13 > 0 THEN value + 1 + (y % 5)*0.01 END AS rb FROM plane_inj)"


def _masks(spark, sf_dir):
    v, x, y = F.col("value"), F.col("x"), F.col("y")
    return I.plane_inj(spark, sf_dir).select((v > 0.3).alias("reference"), (v + (x % 3) * 0.05 > 0.35).alias("candidate"), ((y + x) % 11 > 0).alias("valid"), (v + 1).alias("ra"), F.when(x % 13 > 0, v + 1 + (y % 5) * 0.01).alias("rb"))


@query("A25", f"{_MASKS}, n AS (SELECT count(*) FILTER (v) AS compared, count(*) FILTER (v AND r AND c) AS tp, count(*) FILTER (v AND NOT r AND c) AS fp, count(*) FILTER (v AND r AND NOT c) AS fn, count(*) FILTER (v AND NOT r AND NOT c) AS tn FROM q) SELECT compared, tp, fp, fn, tn, round(tp*1.0/(tp+fp), 6) AS \"precision\", round(tp*1.0/(tp+fn), 6) AS recall, round(tp*1.0/(tp+fp+fn), 6) AS iou FROM n")
def mask_confusion(spark, sf_dir):
    return compare.compare_masks(_masks(spark, sf_dir)).select("compared", "tp", "fp", "fn", "tn", r("precision"), r("recall"), r("iou"))


@query("A26", f"{_MASKS} SELECT count(rb) AS compared, count(*) FILTER (rb IS NULL) AS excluded, round(median(abs(rb-ra)), 6) AS median_difference, round(quantile_cont(abs(rb-ra), 0.95), 6) AS p95_difference, round(median(abs(rb-ra)/ra) FILTER (ra > 0), 6) AS median_fraction FROM q")
def rms_map_compare(spark, sf_dir):
    m = _masks(spark, sf_dir).select(F.col("ra").alias("reference"), F.col("rb").alias("candidate"))
    return compare.compare_rms(m).select("compared", "excluded", r("median_difference"), r("p95_difference"), r("median_fraction"))


_OVER = f"{_BASINS}, ov AS (SELECT lab.label AS a_label, b.label AS b_label, count(*) AS n_pixels FROM lab JOIN basin b USING (y, x) GROUP BY 1, 2)"


@query("J33", f"{_OVER} SELECT * FROM ov")
def label_overlap(spark, sf_dir):
    return support.overlap_counts(labelled(spark, sf_dir), basin_plane(spark, sf_dir))


@query("J32", f"{_OVER} SELECT a_label, max(n_pixels) AS n_pixels FROM ov GROUP BY 1")
def label_match(spark, sf_dir):
    return compare.assign_overlaps(support.overlap_counts(labelled(spark, sf_dir), basin_plane(spark, sf_dir))).select("a_label", "n_pixels")


@query("A28", f"{_OVER} SELECT (SELECT count(DISTINCT label) FROM lab) AS n_reference, (SELECT count(DISTINCT label) FROM basin) AS n_candidate, (SELECT count(DISTINCT a_label) FROM ov) AS n_matched, (SELECT count(*) FROM (SELECT a_label FROM ov GROUP BY 1 HAVING count(*) > 1)) AS n_split, CAST(0 AS BIGINT) AS n_merged")
def island_comparison(spark, sf_dir):
    a, b = cut(labelled(spark, sf_dir), "a"), cut(basin_plane(spark, sf_dir), "b")
    ov = cut(support.overlap_counts(a, b), "overlap")
    size = lambda d: d.groupBy("label").agg(F.count("*").alias("n_pixels"))
    return compare.compare_islands(ov, size(a), size(b), compare.assign_overlaps(ov)).drop("mean_iou")


@query("A33", f"WITH {I.PLANE} SELECT y // 32 AS box_y, x // 32 AS box_x, count(*) FILTER (value < 0) AS n_negative, CASE WHEN count(*) FILTER (value < 0) >= 100 THEN round(sqrt(avg(value*value) FILTER (value < 0)), 6) END AS noise FROM plane GROUP BY 1, 2")
def negative_pixel_noise(spark, sf_dir):
    return compare.negative_noise(I.plane(spark, sf_dir), 32, 100).select("box_y", "box_x", "n_negative", r("noise"))


@query("A35", f"{_MASKS} SELECT count(*) AS pixels, count(*) FILTER (rb/ra > 1.02) AS inflated, count(*) FILTER (rb/ra < 1/1.02) AS deflated, round(sum(ln(rb/ra)), 3) AS log_ratio_sum FROM q WHERE ra > 0 AND rb > 0")
def noise_comparison(spark, sf_dir):
    return compare.compare_noise(_masks(spark, sf_dir).select(F.col("rb").alias("rms"), F.col("ra").alias("noise")), 0.02).select("pixels", "inflated", "deflated", r("log_ratio_sum", 3))


@query("A34", f"{_MASKS} SELECT count(*) FILTER (r) AS ideal_pixels, count(*) FILTER (r AND c) AS covered_pixels, round(sum(CASE WHEN r THEN ra ELSE 0 END), 3) AS ideal_flux, round(sum(CASE WHEN r AND c THEN ra ELSE 0 END), 3) AS covered_flux, count(*) FILTER (c) AS mask_pixels, count(*) FILTER (c AND ra < 1.4) AS off_emission_pixels FROM q")
def emission_recall(spark, sf_dir):
    q = _masks(spark, sf_dir).select(F.col("candidate").alias("mask"), F.col("reference").alias("ideal"), F.col("ra").alias("emission"), F.lit(1.4).alias("noise"))
    return compare.emission_recall(q).select("ideal_pixels", "covered_pixels", r("ideal_flux", 3), r("covered_flux", 3), "mask_pixels", "off_emission_pixels")


@query("A36", "SELECT CAST(p_size AS DOUBLE) AS snr, count(*) AS injected, count(*) FILTER (p_partkey % 3 > 0) AS kept, count(*) FILTER (p_partkey % 4 > 0) AS matched, round(median(p_retailprice) FILTER (p_partkey % 4 > 0), 4) AS median_flux_ratio FROM part GROUP BY 1")
def recovery_levels(spark, sf_dir):
    k = F.col("p_partkey")
    o = I.table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("snr"), (k % 3 > 0).alias("kept"), (k % 4 > 0).alias("matched"), F.col("p_retailprice").alias("flux_ratio"))
    return compare.recovery_by_level(o).select("snr", "injected", "kept", "matched", r("median_flux_ratio", 4))


@query("A31", "WITH q AS (SELECT (value - 245)/140 AS p FROM events) SELECT count(*) AS n, round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS dispersion, round(avg(CASE WHEN abs(p) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS coverage_1, round(avg(p) - 1.959963984540054*stddev_samp(p)/sqrt(count(*)), 6) AS mean_low FROM q")
def uncertainty_calibration(spark, sf_dir):
    q = I.table(spark, sf_dir, "events").select(((F.col("value") - 245) / 140).alias("pull"))
    return compare.calibration(q).select("n", r("mean"), r("dispersion"), r("coverage_1"), r("mean_low"))


@query("A32 A37", "WITH q AS (SELECT CASE WHEN p_size < 5 THEN 'faint' WHEN p_size < 20 THEN 'medium' ELSE 'bright' END || '-' || CASE WHEN p_retailprice/1000 < 1.5 THEN 'compact' ELSE 'extended' END AS stratum, p_retailprice/1000 AS e, (p_partkey % 9 - 4)/2.0 AS p FROM part) SELECT stratum, count(*) AS n, round(median(e), 6) AS median_excess, round(median(p), 6) AS median_pull, round(avg(CASE WHEN abs(p) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM q GROUP BY 1")
def calibration_strata(spark, sf_dir):
    p = I.table(spark, sf_dir, "part").select(F.col("p_size").alias("snr"), (F.col("p_retailprice") / 1000).alias("beams"), (F.col("p_retailprice") / 1000).alias("excess"), ((F.col("p_partkey") % 9 - 4) / 2.0).alias("pull"))
    return compare.calibration_by_stratum(compare.strata(p)).select("stratum", "n", r("median_excess"), r("median_pull"), r("coverage"))


@query("J35 A38", f"{_MASK}, cp AS (SELECT s_suppkey AS id, 'g' || s_suppkey % 3 AS stratum, (s_suppkey*13) % 120 + 60 AS y, (s_suppkey*5) % 40 + 5 AS x FROM supplier), q AS (SELECT stratum, (y, x) IN (SELECT y, x FROM m) AS a, (y, x) IN (SELECT y, x FROM s WHERE snr >= 1) AS b FROM cp) SELECT stratum, count(*) AS n, count(*) FILTER (a AND b) AS \"both\", count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM q GROUP BY 1")
def mask_decisions(spark, sf_dir):
    k = F.col("s_suppkey")
    c = I.table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("g"), (k % 3).cast("string")).alias("stratum"), ((k * 13) % 120 + 60).alias("y"), ((k * 5) % 40 + 5).alias("x"))
    plane = snr_plane(spark, sf_dir)
    return compare.compare_decisions(c, plane.where("snr >= 3"), plane.where("snr >= 1"))


@query("A39 interval overlap", "WITH st AS (SELECT n_nationkey AS stage, n_nationkey*1000.0 AS t0, n_nationkey*1000.0 + 700 AS t1 FROM nation), tk AS (SELECT event_id*3.7 AS t0, event_id*3.7 + event_id % 90 AS t1 FROM events) SELECT stage, round(coalesce(sum(least(st.t1, tk.t1) - greatest(st.t0, tk.t0)) FILTER (tk.t0 IS NOT NULL), 0), 3) AS busy FROM st LEFT JOIN tk ON tk.t0 < st.t1 AND st.t0 < tk.t1 GROUP BY 1")
def stage_occupancy(spark, sf_dir):
    st = I.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("stage"), (F.col("n_nationkey") * 1000.0).alias("t0"), (F.col("n_nationkey") * 1000.0 + 700).alias("t1"))
    e = I.table(spark, sf_dir, "events")
    tk = e.select((F.col("event_id") * 3.7).alias("t0"), (F.col("event_id") * 3.7 + F.col("event_id") % 90).alias("t1"))
    return compare.occupancy(st, tk, 4).select("stage", r("busy", 3))


@query("O6", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey*10+l_linenumber LIMIT 20")
def top_by_value(spark, sf_dir):
    li = I.table(spark, sf_dir, "lineitem").withColumn("_k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return compare.top_k(li, "l_extendedprice", 20, "_k").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("J36", f"{_MASK}, sp AS (SELECT s_suppkey AS id, (s_suppkey*13) % 120 + 60.25 AS py, (s_suppkey*5) % 40 + 5.5 AS px FROM supplier) SELECT id FROM sp WHERE (CAST(floor(py) AS BIGINT), CAST(floor(px) AS BIGINT)) IN (SELECT y, x FROM s WHERE snr >= 0.5) AND px > 8 AND px < 40 AND py > 70 AND py < 170")
def filter_by_mask(spark, sf_dir):
    k = F.col("s_suppkey")
    sp = I.table(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 13) % 120 + 60.25).cast("double").alias("py"), ((k * 5) % 40 + 5.5).cast("double").alias("px"))
    return compare.filter_by_mask(sp, snr_plane(spark, sf_dir).where("snr >= 0.5"), [(8.0, 70.0), (40.0, 70.0), (40.0, 170.0), (8.0, 170.0)]).select("id")


@query("A12 U2 grouping of pixels", f"{_MASK} SELECT label, count(DISTINCT (y // 16)*100 + x // 16) AS n_tiles, count(*) AS n_pixels FROM lab GROUP BY 1")
def cores_holding(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    return lab.groupBy("label").agg(F.count_distinct(F.floor(F.col("y") / 16), F.floor(F.col("x") / 16)).alias("n_tiles"), F.count("*").alias("n_pixels"))


@query("U3 union of supports", f"{_MASK} SELECT y, x FROM m UNION SELECT y, x FROM s WHERE snr < -3")
def support_union(spark, sf_dir):
    plane = snr_plane(spark, sf_dir)
    return plane.where("snr >= 3").select("y", "x").union(plane.where("snr < -3").select("y", "x")).distinct()


@query("P19", f"WITH {I.PLANE_LI} SELECT bool_or(value > 0) AS usable FROM plane_li")
def usable_noise(spark, sf_dir):
    return I.plane_li(spark, sf_dir).agg(F.bool_or(F.col("value") > 0).alias("usable"))


@query("J28 touching labels", f"{_BASINS} SELECT DISTINCT a.label AS a_label, b.label AS b_label FROM basin a JOIN basin b ON abs(a.y-b.y) <= 1 AND abs(a.x-b.x) <= 1")
def touching_labels(spark, sf_dir):
    b = cut(basin_plane(spark, sf_dir), "basin")
    return labels.touching_labels(b, b)
