"""Kernels and sources against analytic values, tile invariance, degenerate inputs."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fluxweave.functions import scalars as S
from fluxweave.functions.sky import Wcs, axis_significance
from fluxweave.operators import association, compare, deblend, fit, groups, kernels, labels, multiscale, noise, pixels, tiling
from fluxweave.plans import finder
from fluxweave.sources import fits, products, synthetic

HEADER = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CRVAL1": 10.0, "CRVAL2": -40.0, "CRPIX1": 50.0, "CRPIX2": 60.0, "CDELT1": -0.002, "CDELT2": 0.002}


def flood(mask):
    """Plain 8-connected labels in raster order."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not out[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                    out[a, b] = n
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**31))
def test_labels_equal_a_flood_fill(h, w, seed):
    mask = np.random.default_rng(seed).random((h, w)) < 0.45
    assert (kernels.label_plane(mask) == flood(mask)).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**31))
def test_nearest_true_is_exact_with_ties(h, w, seed):
    mask = np.random.default_rng(seed).random((h, w)) < 0.3
    if not mask.any():
        return
    y, x, d2 = noise.nearest_true(mask)
    spots = np.argwhere(mask)
    for a in range(h):
        for b in range(w):
            best = min(((a - p) ** 2 + (b - q) ** 2, p, q) for p, q in spots)
            assert (d2[a, b], y[a, b], x[a, b]) == best


@pytest.mark.parametrize("core", [3, 8, 64])
def test_labels_do_not_depend_on_tiles(spark, core):
    mask = np.random.default_rng(6).random((30, 41)) < 0.42
    want = flood(mask)
    df = spark.createDataFrame([(int(y), int(x)) for y, x in np.argwhere(mask)], "y long, x long")
    got = {(r.y, r.x): r.label for r in labels.label_regions(df, core).collect()}
    names = {}
    for (y, x), label in got.items():
        assert names.setdefault(want[y, x], label) == label
    assert len(set(names.values())) == want.max()


def test_clip_keeps_what_the_rule_says():
    v = np.concatenate([np.random.default_rng(1).normal(0, 1, 500), [50.0, 60.0, np.nan]])
    median, rms, n = kernels.clip_statistics(v)
    assert abs(median) < 0.15 and 0.8 < rms < 1.1 and n <= 500
    assert kernels.clip_statistics(np.full(50, 3.25)) == (None, None, 50)
    assert kernels.clip_statistics(np.array([np.nan])) == (None, None, 0)


def test_window_blocks_agree_with_plain_windows(spark):
    rng = np.random.default_rng(2)
    plane = rng.normal(size=(53, 71))
    df = spark.createDataFrame([(y, x, float(plane[y, x])) for y in range(53) for x in range(71)], "y long, x long, value double")
    got = {(r.cell_y, r.cell_x): r for r in noise.window_statistics(df, (53, 71), (20, 20), (6, 6)).collect()}
    ys, h = noise.axis_starts(53, 20, 6)
    xs, w = noise.axis_starts(71, 20, 6)
    assert len(got) == len(ys) * len(xs)
    for i, y in enumerate(ys):
        for j, x in enumerate(xs):
            median, rms, n = kernels.clip_statistics(plane[y : y + h, x : x + w].ravel())
            assert got[i, j].n_retained == n and abs(got[i, j].rms - rms) < 1e-12 and got[i, j].background == median


def test_interpolation_is_exact_for_a_plane(spark):
    shape = (40, 50)
    df = spark.createDataFrame([(y, x, 1.0) for y in range(40) for x in range(50)], "y long, x long, value double")
    cells = noise.plan_grid(spark, shape, (12, 12), (5, 5)).select("cell_y", "cell_x", (F.col("sample_y") * 2 + F.col("sample_x") * 3).alias("background"), F.lit(2.0).alias("rms"))
    for r in noise.interpolate(df, cells, shape, (12, 12), (5, 5)).collect():
        assert abs(r.background - (2 * r.y + 3 * r.x)) < 1e-9 and abs(r.rms - 2) < 1e-12


def test_atrous_scales_sum_to_the_image(spark):
    plane = np.random.default_rng(3).normal(size=(24, 24))
    df = spark.createDataFrame([(y, x, float(plane[y, x]), True) for y in range(24) for x in range(24)], "y long, x long, value double, valid boolean")
    for r in pixels.atrous(df, 0.0).collect():
        assert abs(r.coefficient_1 + r.coefficient_2 + r.coefficient_3 + r.coarse - plane[r.y, r.x]) < 1e-9


@pytest.mark.parametrize("core", [16, 64])
def test_matched_filter_is_the_same_for_any_tile(spark, core):
    plane = np.random.default_rng(4).normal(size=(50, 40))
    plane[25, 20] += 30
    df = spark.createDataFrame([(y, x, float(plane[y, x]), 1.0) for y in range(50) for x in range(40)], "y long, x long, value double, rms double")
    rows = multiscale.matched_filters(df, (1.5, 1.2, 30.0), core=core).collect()
    k, gain = multiscale.filter_bank((1.5, 1.2, 30.0))[0]
    want = gain * kernels.convolve(plane, k) / kernels.convolve(np.ones_like(plane), k)
    for r in rows:
        if r.support_1 >= 0.5:
            assert abs(r.response_1 - want[r.y, r.x]) < 1e-8


def test_deblend_separates_two_peaks_and_merges_a_ripple():
    y, x = np.mgrid[0:30, 0:40].astype(float)
    two = 20 * np.exp(-((y - 15) ** 2 + (x - 12) ** 2) / 8) + 16 * np.exp(-((y - 15) ** 2 + (x - 26) ** 2) / 8)
    assert deblend.deblend_plane(two, two > 0.1).max() == 2
    one = 20 * np.exp(-((y - 15) ** 2 + (x - 12) ** 2) / 40)
    one[15, 16] += 0.6
    assert deblend.deblend_plane(one, one > 0.5).max() == 1
    assert deblend.deblend_plane(np.zeros((3, 3)), np.zeros((3, 3), bool)).max() == 0


def test_fit_recovers_a_noiseless_gaussian():
    y, x = (a.ravel().astype(float) for a in np.mgrid[0:21, 0:23])
    p = np.array([5.0, 11.3, 9.7, 3.1, 1.9, np.deg2rad(35)])
    value, _ = fit.gaussian(p, x, y)
    keep = value > 0.05
    row = fit.fit_object(y[keep], x[keep], np.ones(keep.sum(), int), value[keep], np.full(keep.sum(), 0.01), (1.5, 1.5, 0.0)).iloc[0]
    assert row["model"] == "free"
    assert np.allclose([row["amplitude"], row["cx"], row["cy"], row["sigma_1"], row["sigma_2"], row["angle"]], [5, 11.3, 9.7, 3.1, 1.9, 35], rtol=1e-4)


def test_fit_says_why_there_is_none():
    y, x = (a.ravel().astype(float) for a in np.mgrid[0:2, 0:1])
    few = fit.fit_object(y, x, np.ones(2, int), np.ones(2), np.ones(2), (1.5, 1.5, 0.0))
    assert few["reason"].tolist() == ["underdetermined-region"]
    bad = fit.fit_object(y, x, np.ones(2, int), np.array([1, np.nan]), np.ones(2), (1.5, 1.5, 0.0))
    assert bad["reason"].tolist() == ["non-finite-owned-pixels"]


def test_gaussian_derivatives_are_numeric_ones():
    p, x, y = np.array([2.0, 1.0, -0.5, 2.2, 1.1, 0.4]), np.linspace(-3, 3, 7), np.linspace(-2, 4, 7)
    _, j = fit.gaussian(p, x, y)
    for k in range(6):
        h = np.zeros(6)
        h[k] = 1e-6
        assert np.allclose(j[:, k], (fit.gaussian(p + h, x, y)[0] - fit.gaussian(p - h, x, y)[0]) / 2e-6, atol=1e-7)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 6), st.integers(0, 2**31))
def test_assignment_is_the_cheapest(n, seed):
    from itertools import permutations

    cost = np.random.default_rng(seed).random((n, n))
    chosen = compare.assign(cost)
    assert sorted(chosen) == list(range(n))
    assert np.isclose(cost[np.arange(n), chosen].sum(), min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n))))


def _least(edges):
    """Most pairs, then the least total, by trying everything: edges {(left, right): weight}."""
    if not edges:
        return 0, 0.0
    i = min(a for a, _ in edges)
    ways = [_least({e: w for e, w in edges.items() if e[0] != i})]
    for (a, j), w in edges.items():
        if a == i:
            n, total = _least({e: x for e, x in edges.items() if e[0] != i and e[1] != j})
            ways.append((n - 1, total + w))
    return min(ways)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 2**31))
def test_assignment_along_edges_has_most_pairs_then_least_weight(a, b, seed):
    g = np.random.default_rng(seed)
    edges = {(i, j): round(float(g.uniform(-1, 1)), 1) for i in range(a) for j in range(b) if j == i % b or g.random() < 0.4}
    chosen = compare.assign_edges([i for i, _ in edges], [j for _, j in edges], list(edges.values()))
    taken = [list(edges)[k] for k in chosen if k >= 0]
    assert all(k < 0 or list(edges)[k][0] == i for i, k in enumerate(chosen)) and len({j for _, j in taken}) == len(taken)
    n, total = _least(edges)
    assert -len(taken) == n and np.isclose(sum(edges[e] for e in taken), total)


def test_matches_of_one_crowded_component_are_the_cheapest(spark):
    """A short side of large ids that compete, and a chain too long for a square matrix of its component."""
    g, big = np.random.default_rng(5), 2**60
    crowd = {(i, j): float(g.random()) for i in range(40) for j in range(30) if (i + j) % 30 < 6}
    rows = [(big + i, big + j, w, 1.0, 1.0) for (i, j), w in crowd.items()]
    chain = 40_000
    rows += [(i, i, 0.5, 1.0, 1.0) for i in range(chain)] + [(i, i + 1, 0.6, 1.0, 1.0) for i in range(chain - 1)]
    got = compare.assign_matches(spark.createDataFrame(rows, "a_id long, b_id long, separation double, a_flux double, b_flux double")).toPandas()
    cost = np.full((40, 40), 1000.0)
    for (i, j), w in crowd.items():
        cost[i, j] = w
    best = [w for w in cost[np.arange(40), compare.assign(cost)] if w < 1000]
    mine = got[got["a_id"] >= big]
    assert mine["a_id"].is_unique and mine["b_id"].is_unique and len(mine) == len(best) and np.isclose(mine["separation"].sum(), sum(best))
    assert all((a - big, b - big) in crowd for a, b in zip(mine["a_id"], mine["b_id"], strict=True))
    assert len(got) == len(mine) + chain and (got["separation"][got["a_id"] < big] == 0.5).all()


def test_flux_breaks_ties_of_separation_and_may_be_missing(spark):
    rows = [(1, 1, 0.5, 2.0, 2.0), (1, 2, 0.5, 2.0, 9.0), (2, 1, 0.5, 9.0, 2.0), (2, 2, 0.5, 9.0, 9.0), (3, 3, 0.1, None, 1.0)]
    pairs = spark.createDataFrame(rows, "a_id long, b_id long, separation double, a_flux double, b_flux double")
    assert sorted((r["a_id"], r["b_id"]) for r in compare.assign_matches(pairs).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert compare.assign_matches(pairs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["mutual_nearest_match", "catalogue_cuts"])
def test_matching_sends_no_growing_table_to_the_driver(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_touching_classes_tell_every_pair_once(spark):
    g = np.random.default_rng(3)
    kinds = [(float(x), float(y), float(s), float(s) / 2, float(t)) for x, y, s, t in zip(g.uniform(0, 60, 30), g.uniform(0, 60, 30), g.uniform(1, 6, 30), g.uniform(0, 180, 30), strict=True)]
    kinds += [(kinds[0][0], kinds[0][1], 2.0, 1.0, 0.0), (5.0, 5.0, None, 1.0, 0.0)]
    rows = [(2**60 + i, *kinds[int(k)]) for i, k in enumerate(g.integers(0, len(kinds), 120))]
    models = spark.createDataFrame(rows, "id long, cx double, cy double, sigma_1 double, sigma_2 double, angle double")

    def meet(p, q):
        dx, dy = q[0] - p[0], q[1] - p[1]
        d = np.hypot(dx, dy)

        def along(m):
            c, s = np.cos(np.radians(m[4])), np.sin(np.radians(m[4]))
            return d / np.hypot((c * dx + s * dy) / m[2], (c * dy - s * dx) / m[3]) if d else m[2]

        return d <= np.sqrt(2 * np.log(2)) * (along(p) + along(q))

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and None not in a + b and meet(a[1:], b[1:])}
    told = fit.touching_classes(models, 32.0).collect()
    group = {r["b_id"]: r["a_id"] for r in told if r["copy"]}
    links = {(r["a_id"], r["b_id"]) for r in told if not r["copy"]}
    home = lambda i: group.get(i, i)
    whole = [r[0] for r in rows if None not in r]
    same = lambda a, b: home(a) == home(b) or (min(home(a), home(b)), max(home(a), home(b))) in links
    assert {(a, b) for a in whole for b in whole if a < b and same(a, b)} == want
    assert len(told) == len(group) + len(links) and len(told) < len(want)
    assert {(r["a_id"], r["b_id"]) for r in fit.touching_models(models, 32.0).collect()} == want


def test_copies_of_boxes_meet_once_and_are_compared_as_one(spark):
    g = np.random.default_rng(8)
    kinds = [(int(s), int(y), int(y + h), int(x), int(x + w)) for s, y, x, h, w in zip(g.integers(1, 4, 25), g.integers(0, 90, 25), g.integers(0, 90, 25), g.integers(1, 40, 25), g.integers(1, 40, 25), strict=True)]
    rows = [(i, *kinds[int(k)]) for i, k in enumerate(g.integers(0, 25, 90))]
    boxes = spark.createDataFrame(rows, "id long, scale int, y0 long, y1 long, x0 long, x1 long")
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] == b[1] or min(a[1], b[1]) >= 2) and a[2] < b[3] and b[2] < a[3] and a[4] < b[5] and b[4] < a[5]]
    assert sorted((r["a_id"], r["b_id"]) for r in groups.envelope_candidates(boxes, 3, 16).collect()) == sorted(want)
    distinct = boxes.drop("id").distinct()
    assert groups._meeting_boxes(distinct, 3, 16).count() <= len(want) // 4


@pytest.mark.parametrize("kind", ["TAN", "SIN"])
def test_wcs_round_trip_and_area(kind):
    wcs = Wcs(HEADER | {"CTYPE1": f"RA---{kind}", "CTYPE2": f"DEC--{kind}", "CROTA2": 12.0})
    x, y = np.array([0.0, 49.0, 120.5]), np.array([3.0, 59.0, -20.25])
    ra, dec = wcs.to_sky(x, y)
    assert np.allclose(wcs.to_pixel(ra, dec), [x, y], atol=1e-8)
    assert np.allclose([ra[1], dec[1]], [10, -40]) and np.isclose(wcs.pixel_area(x, y)[1], np.deg2rad(0.002) ** 2, rtol=1e-6)
    with pytest.raises(ValueError):
        Wcs(HEADER | {"RADESYS": "FK4"})


def test_axis_significance():
    assert axis_significance((10.0, 8.0, 20.0), (0.1, 0.1, 1.0), (4.0, 4.0, 0.0)) == (True, True)
    assert axis_significance((4.05, 4.0, 20.0), (0.5, 0.5, 5.0), (4.0, 4.0, 0.0)) == (False, False)


def test_fits_image_contract(spark, tmp_path):
    cards = [("BUNIT", "JY/BEAM"), ("BMAJ", 0.01), ("BMIN", 0.008), ("BPA", 5.0), ("RESTFREQ", 1.5e8), *HEADER.items()]
    plane = np.arange(30.0).reshape(5, 6)
    plane[2, 3] = np.nan
    path = str(tmp_path / "a.fits")
    fits.write_image(path, (5, 6), [plane[:2], plane[2:]], cards, -64)
    meta = fits.image_metadata(path)
    assert meta["shape"] == (5, 6) and meta["beam"] == (0.01, 0.008, 5.0) and meta["frequency"] == 1.5e8
    assert np.array_equal(fits.read_windows(meta, [(1, 4, 2, 5)])[0], plane[1:4, 2:5], equal_nan=True)
    fits.register(spark)
    rows = spark.read.format("fits").load(path).where("y >= 1 and y < 4 and x = 3").collect()
    assert [(r.y, r.x, r.value) for r in rows] == [(1, 3, 9.0), (2, 3, None), (3, 3, 21.0)]
    with pytest.raises(FileExistsError):
        fits.write_image(path, (5, 6), [plane], cards)
    for bad in ([c for c in cards if c[0] != "BUNIT"], [c for c in cards if c[0] != "BMAJ"], [c for c in cards if c[0] != "RESTFREQ"], [c for c in cards if c[0] != "CTYPE1"]):
        other = str(tmp_path / f"bad{len(list(tmp_path.iterdir()))}.fits")
        fits.write_image(other, (5, 6), [plane], bad, -64)
        with pytest.raises(ValueError):
            fits.image_metadata(other)


def test_fits_tables_round_trip(tmp_path):
    t = pa.table({"id": pa.array([1, 2], pa.int64()), "n": pa.array([3, 4], pa.int32()), "v": pa.array([1.5, None]), "s": ["ab", "c"], "f": [["x", "y"], []], "b": [True, False]})
    fits.write_tables(str(tmp_path / "t.fits"), {"A": t, "EMPTY": t.slice(0, 0)})
    back = fits.read_tables(str(tmp_path / "t.fits"))
    assert back["A"].to_pydict() == {"id": [1, 2], "n": [3, 4], "v": [1.5, None], "s": ["ab", "c"], "f": ["x,y", ""], "b": [True, False]}
    assert back["EMPTY"].num_rows == 0


def test_staging_and_publishing(tmp_path):
    out = str(tmp_path / "run")
    with products.staging_directory(out) as stage:
        (stage / "p").mkdir()
        products.write_json(str(stage / "p/d.json"), {"b": 1, "a": [1, 2]})
        products.rename_without_replacement(str(stage / "p"), out)
    assert products.read_json(f"{out}/d.json") == {"a": [1, 2], "b": 1} and [p.name for p in tmp_path.iterdir()] == ["run"]
    with products.staging_directory(out) as stage:
        (stage / "p").mkdir()
        with pytest.raises(FileExistsError):
            products.rename_without_replacement(str(stage / "p"), out)
    dead = tmp_path / ".run.x.staging"
    dead.mkdir()
    import os

    (dead / "owner").write_text(f"999999999 {os.uname().nodename}")
    assert products.reclaim_abandoned_staging(out) == 1 and not dead.exists()


def test_synthetic_image_does_not_depend_on_partitions(spark):
    one = synthetic.image(spark, (20, 30), seed=4, noise=1.0, gradient=(0.5, 0.1)).coalesce(1).collect()
    many = synthetic.image(spark, (20, 30), seed=4, noise=1.0, gradient=(0.5, 0.1)).repartition(7).collect()
    assert sorted(one) == sorted(many)
    v = np.array([r.value for r in synthetic.image(spark, (100, 100), seed=1).collect()])
    assert abs(v.mean()) < 0.05 and abs(v.std() - 1) < 0.03


def test_two_core_keeps_cycles_only(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (7, 8)], "a long, b long")
    assert sorted(tuple(r) for r in association.two_core(edges).collect()) == [(1, 1), (2, 1), (3, 1)]
    assert association.two_core(edges.where("a > 5")).count() == 0


def _found(spark, profile, invalid=(), sources=None):
    stars = sources if sources is not None else [{"x": 40, "y": 50, "peak": 30, "sigma_1": 2, "sigma_2": 1.6, "angle": 20}, {"x": 100, "y": 90, "peak": 60, "sigma_1": 2, "sigma_2": 1.6, "angle": 20}, {"x": 107, "y": 94, "peak": 40, "sigma_1": 2, "sigma_2": 1.6, "angle": 20}]
    image = synthetic.image(spark, (128, 144), seed=3, noise=1.0, sources=stars, invalid=invalid).cache()
    return finder.Image(image, (128, 144), (2 * S.FWHM, 1.6 * S.FWHM, 20.0), Wcs(HEADER)), stars


@pytest.mark.parametrize("profile", ["compact", "continuum"])
def test_finder_recovers_injected_sources(spark, profile, tmp_path):
    image, stars = _found(spark, profile, [(0, 20, 120, 144)])
    found = finder.find_sources(image, finder.FinderConfig(profile=profile))
    rows = found.components.where("reason is null").collect()
    assert found.usable and len(rows) == len(stars) == found.sources.count()
    for s in stars:
        r = min(rows, key=lambda r: (r.cx - s["x"]) ** 2 + (r.cy - s["y"]) ** 2)
        assert abs(r.cx - s["x"]) < 0.15 and abs(r.cy - s["y"]) < 0.15 and abs(r.amplitude / s["peak"] - 1) < 0.06
    if profile == "compact":
        manifest = finder.publish(found, image, str(tmp_path / "run"))
        assert {m["role"] for m in manifest} == {"catalogue", "rms", "mask", "diagnostics"}
        tables = fits.read_tables(str(tmp_path / "run/catalogue.fits"))
        assert tables["SOURCES"].num_rows == 3 and tables["ISLANDS"].num_rows == 2


def test_finder_steps_on_an_extended_source(spark):
    """Protected noise, persistent scales, hierarchy, published and source support: what each adds, against plain sets."""
    from pyspark.sql import functions as F

    stars = [{"x": 70, "y": 60, "peak": 14, "sigma_1": 7, "sigma_2": 6, "angle": 0}, {"x": 64, "y": 58, "peak": 30, "sigma_1": 2, "sigma_2": 1.6, "angle": 20}, {"x": 78, "y": 63, "peak": 25, "sigma_1": 2, "sigma_2": 1.6, "angle": 20}]
    image, _ = _found(spark, "continuum", sources=stars)
    config = finder.FinderConfig(coarse=(32, 16), bright_sigma=1e9)
    mean = lambda profile: finder.estimate_noise(image, finder.FinderConfig(profile=profile, coarse=(32, 16), bright_sigma=1e9)).where("x between 50 and 90 and y between 40 and 80").agg(F.avg("rms")).first()[0]
    assert mean("continuum") < mean("compact")
    plane = image.pixels.select("y", "x", "value", F.lit(0.0).alias("background"), F.lit(1.0).alias("rms"))
    found, scales = finder.detect(plane, image, config)
    at: dict = {}
    for r in scales.collect():
        at.setdefault((r.scale, r.label), set()).add((r.y, r.x))
    assert at and all(any(abs(s - t) == 1 and p & q for (t, _), q in at.items()) for (s, _), p in at.items())
    components, regions = finder.measure_components(found, image, config)
    named = regions.join(components.select("label", "region", "component"), ["label", "region"])
    groups = {r.component: r.group for r in finder.hierarchy(named, scales).collect()}
    assert len(groups) >= 2 and len(set(groups.values())) == 1
    original = {(r.y, r.x): r.label for r in found.collect()}
    published = {(r.y, r.x): r.label for r in finder.published_support(found, scales, config).collect()}
    assert published and set(published.values()) == set(original.values())
    for label in set(published.values()):
        mask = np.zeros(image.shape, bool)
        mask[tuple(np.array([k for k, v in published.items() if v == label]).T)] = True
        assert kernels.label_plane(mask).max() == 1
    owned = found.select("y", "x", "label", "residual", "rms")
    grown = {(r.y, r.x) for r in finder.source_support(owned, scales, plane, 6.0).collect()}
    every = set().union(*at.values())
    free = every - set(original)
    near = {(y, x) for y, x in free if min((y - b) ** 2 + (x - a) ** 2 for b, a in original) <= 36}
    assert near and grown == set(original) | near


def test_finder_on_an_empty_and_an_invalid_image(spark):
    image, _ = _found(spark, "compact", sources=[])
    quiet = finder.find_sources(image, finder.FinderConfig(profile="compact", detection_sigma=8.0))
    assert quiet.usable and quiet.sources.count() == 0 and quiet.islands.count() == 0
    image, _ = _found(spark, "compact", [(0, 128, 0, 144)], [])
    blank = finder.find_sources(image, finder.FinderConfig(profile="compact"))
    assert not blank.usable and blank.sources.count() == 0


def test_configuration_is_checked():
    for bad in ({"detection_sigma": 2.0}, {"profile": "other"}, {"least_pixels": 0}, {"least_pixels": 9, "most_pixels": 3}, {"island_sigma": -1.0}):
        with pytest.raises(ValueError):
            finder.FinderConfig(**bad)


def test_tiles_cover_the_image_once(spark):
    t = tiling.plan_tiles(spark, (50, 61), (16, 20), (3, 3), (5, 7)).collect()
    seen = np.zeros((50, 61), int)
    for r in t:
        seen[r.y0 : r.y1, r.x0 : r.x1] += 1
        assert r.read_y0 <= r.y0 and r.read_y1 >= r.y1
    assert (seen == 1).all()


def test_ring_is_one_group_and_misfit_is_found(spark):
    from fluxweave import plans

    rows = plans.QUERIES["feature_groups"](spark, "").collect()
    assert {r.id for r in rows if r.evidence == "resolved-loop"} == set(range(1, 9)) and {r.group for r in rows} == {1}
    assert [(r.feature, r.id) for r in plans.QUERIES["inadequate_fits"](spark, "").collect()] == [(1, 2)]


def test_every_query_names_what_it_covers():
    from fluxweave import plans

    assert set(plans.COVERS) == set(plans.QUERIES) and all(plans.COVERS.values())
    assert set(plans.SQL) <= set(plans.QUERIES)


def test_the_finder_claims_no_step_it_lacks():
    from fluxweave import plans

    assert "T16" not in plans.COVERS["find_sources_continuum"].split()
