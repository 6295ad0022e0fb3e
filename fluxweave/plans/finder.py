"""The source finder: one image in; islands, components, sources, RMS and mask out.

Steps are DataFrames; a step whose result several others read is cut to the shared folder.
"""

from __future__ import annotations

import json
import math
import os
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.functions import scalars as S
from fluxweave.functions.sky import Wcs, sky_position, sky_shape
from fluxweave.operators import association, deblend, fit, groups, labels, measure, multiscale, noise, pixels, support
from fluxweave.operators.graph import connected_components
from fluxweave.runtime import cut
from fluxweave.sources import fits, products


@dataclass(frozen=True)
class FinderConfig:
    """Thresholds in RMS, sizes in pixels; the defaults are the engine's only ones."""

    detection_sigma: float = 5.0
    island_sigma: float = 3.0
    least_pixels: int | None = None  # None: one beam area
    most_pixels: int | None = None
    profile: str = "continuum"
    background: str = "estimated"
    coarse: tuple[int, int] = (150, 50)
    fine: tuple[int, int] = (35, 7)
    bright_sigma: float = 75.0
    influence: float = 75.0
    transition: float = 20.0
    aperture_beams: float = 1.5
    refine_radius: float = 2.0
    core: int = 512

    def __post_init__(self):
        if not (0 < self.island_sigma <= self.detection_sigma) or not math.isfinite(self.detection_sigma):
            raise ValueError("thresholds must be finite, positive and in order")
        if self.profile not in ("continuum", "compact") or self.background not in ("estimated", "zero"):
            raise ValueError("unknown profile or background")
        if self.least_pixels is not None and self.least_pixels < 1 or self.most_pixels is not None and self.most_pixels < (self.least_pixels or 1):
            raise ValueError("pixel limits must be positive and in order")


@dataclass(frozen=True)
class Image:
    """pixels(y, x, value) with what the finder must know of the image. beam: FWHM, FWHM in pixels, angle from x."""

    pixels: DataFrame
    shape: tuple[int, int]
    beam: tuple[float, float, float]
    wcs: Wcs | None = None
    frequency: float | None = None


@dataclass
class Found:
    """The finder's tables; `usable` is false when no pixel has noise.

    published: the mask's support with its label; of the continuum profile also scales (scale,
    y, x, label), the persistent features, and hierarchy (component, group), the proposals of
    the scale hierarchy, which join nothing without measured evidence.
    """

    noise: DataFrame
    labels: DataFrame
    islands: DataFrame
    components: DataFrame
    sources: DataFrame
    published: DataFrame | None = None
    scales: DataFrame | None = None
    hierarchy: DataFrame | None = None
    usable: bool = True
    facts: dict = field(default_factory=dict)


def estimate_noise(image: Image, config: FinderConfig) -> DataFrame:
    """background and rms at each pixel: coarse grid, then fine grids blended around bright candidates."""
    side = min(image.shape)
    window, step = config.coarse
    if window > side / 4:  # small images shrink the windows
        window = max(8, side // 4)
        step = max(2, window // 3)
    boxes = (window, window), (step, step)

    def over(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
        grid = cut(noise.fill_grid(noise.window_statistics(samples, image.shape, *boxes)), "coarse")
        plane = noise.interpolate(image.pixels, grid, image.shape, *boxes)
        return grid, cut(plane.select("y", "x", "value", "background", "rms"), "noise")

    grid, plane = over(image.pixels)
    if config.profile == "continuum":
        guarded = protected_samples(plane, config)
        if not guarded.isEmpty():  # once more without the emission that stands out
            free = image.pixels.join(guarded.withColumn("_p", F.lit(True)), ["y", "x"], "left")
            grid, plane = over(free.select("y", "x", F.when(F.col("_p").isNull(), F.col("value")).alias("value")))
    snr = pixels.normalize_residual(F.col("value"), F.col("background"), F.col("rms"))
    bright = plane.where(snr > config.bright_sigma).withColumn("snr", snr)
    fine_window, fine_step = config.fine
    if bright.isEmpty() or fine_window > side / 4:
        return plane
    peaks = labels.summarize(bright.join(labels.label_regions(bright, config.core), ["y", "x"]), F.lit(True)).select(F.col("label").alias("id"), F.col("peak_at.y").alias("y"), F.col("peak_at.x").alias("x"))
    peaks = cut(peaks, "peaks")
    guard = plane.select("y", "x", "value", F.coalesce(snr >= config.island_sigma, F.lit(False)).alias("protected"))
    fine_boxes = (fine_window, fine_window), (fine_step, fine_step)
    fine_grid = cut(local_noise(noise.window_statistics(guard, image.shape, *fine_boxes, protected=True), grid, image, boxes, fine_boxes), "fine")
    fine = noise.interpolate(plane.select("y", "x", "value"), fine_grid, image.shape, (fine_window, fine_window), (fine_step, fine_step), extrapolate_rms=False)
    reach = int(config.influence)
    # Distances to peaks: each peak offers itself to the tiles its influence meets.
    tile = 64
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile)))
    offers = peaks.withColumn("_ty", span("y")).withColumn("_tx", span("x")).select("_ty", "_tx", F.col("y").alias("_py"), F.col("x").alias("_px"))
    near = plane.select("y", "x", F.floor(F.col("y") / tile).alias("_ty"), F.floor(F.col("x") / tile).alias("_tx")).join(offers, ["_ty", "_tx"])
    d = F.sqrt((F.col("y") - F.col("_py")) * (F.col("y") - F.col("_py")) + (F.col("x") - F.col("_px")) * (F.col("x") - F.col("_px")))
    distance = near.groupBy("y", "x").agg(F.min(d).alias("_d"))
    both = plane.join(fine.select("y", "x", F.col("background").alias("_fb"), F.col("rms").alias("_fr")), ["y", "x"], "left").join(distance, ["y", "x"], "left")
    weight = F.coalesce(noise.smooth_weight(F.col("_d"), config.influence, config.transition), F.lit(0.0))
    b, r = noise.blend(weight, F.col("background"), F.col("rms"), F.col("_fb"), F.col("_fr"))
    return cut(both.select("y", "x", "value", b.alias("background"), r.alias("rms")), "blended")


def protected_samples(plane: DataFrame, config: FinderConfig) -> DataFrame:
    """Pixels (y, x) of significant emission with a seed: they say nothing of the noise."""
    snr = pixels.normalize_residual(F.col("value"), F.col("background"), F.col("rms"))
    mask = cut(plane.select("y", "x", snr.alias("snr")).where(F.col("snr") >= config.island_sigma), "protect")
    named = mask.join(labels.label_regions(mask.select("y", "x"), config.core), ["y", "x"])
    return cut(support.seeded_regions(named, F.col("snr") > config.detection_sigma).select("y", "x"), "protected")


def local_noise(own: DataFrame, coarse: DataFrame, image: Image, boxes: tuple, fine_boxes: tuple) -> DataFrame:
    """The fine grid with its unavailable cells filled: from clean windows near by, else by the coarse estimate's word."""
    keys = ["cell_y", "cell_x"]
    cells = noise.plan_grid(coarse.sparkSession, image.shape, *fine_boxes).select(*keys, F.col("sample_y").alias("y"), F.col("sample_x").alias("x"), F.lit(0.0).alias("value"))
    wide = noise.interpolate(cells, coarse, image.shape, *boxes).select(*keys, F.col("rms").alias("coarse_rms"))
    own = cut(own, "fine_windows")
    filled = noise.fill_grid(own)
    joined = filled.join(own.select(*keys, F.col("rms").alias("own_rms")), keys).join(wide, keys)
    return noise.choose_local_noise(joined).select(*keys, "background", "rms", "available")


def scale_features(scale_snr: DataFrame, config: FinderConfig, least: int) -> DataFrame:
    """(scale, y, x, label, snr): seeded features of each scale that overlap one of an adjacent scale."""
    long = scale_snr.select("y", "x", F.explode(F.array(*[F.struct(F.lit(k).alias("scale"), F.col(f"snr_{k}").alias("snr")) for k in (1, 2, 3)])).alias("s")).select("s.scale", "y", "x", "s.snr")
    mask = cut(long.where(F.col("snr") >= config.island_sigma), "scales")
    named = mask.join(labels.label_regions(mask.select("scale", "y", "x"), config.core, by=["scale"]), ["scale", "y", "x"])
    seeded = cut(support.seeded_regions(named, F.col("snr") > config.detection_sigma, least, ["scale"]), "seeded")
    return cut(support.persistent_features(seeded), "persistent")


def hierarchy(regions: DataFrame, scales: DataFrame) -> DataFrame:
    """(component, group): components that meet at a feature of a coarser scale and share persistent support."""
    name = lambda scale, label: F.struct(scale.cast("long").alias("scale"), label.alias("label"))
    edges = support.adjacent_edges(scales).select(name(F.col("scale"), F.col("child")).alias("child"), name(F.col("scale") + 1, F.col("parent")).alias("parent"))
    features = scales.select(name(F.col("scale"), F.col("label")).alias("feature")).distinct()
    first = scales.where("scale = 1").select("y", "x", name(F.lit(1), F.col("label")).alias("feature"))
    attached = regions.select("y", "x", F.col("component").alias("owner")).join(first, ["y", "x"]).select("owner", "feature").distinct()
    lineage = association.lineages(features, edges, 2)
    met = association.hierarchy_groups(association.owner_features(attached, lineage), lineage)
    whole = scales.select("y", "x").distinct()
    part = whole.join(labels.label_regions(whole), ["y", "x"]).withColumnRenamed("label", "support")
    held = regions.select("y", "x", F.col("component").alias("owner")).join(part, ["y", "x"]).select("owner", "support").distinct()
    return association.supported_groups(met, held).select(F.col("owner").alias("component"), "group")


def published_support(found: DataFrame, persistent: DataFrame | None, config: FinderConfig) -> DataFrame:
    """(y, x, label) of the mask: refined support, with owners restored that refinement split or took away, and bridges kept."""
    if persistent is None:
        return found.select("y", "x", "label")
    original = found.select("y", "x", "label", "snr")
    refined = cut(support.refined_support(original, persistent, config.refine_radius).dropDuplicates(["y", "x"]), "refined")
    bridged = refined.unionByName(support.bridges(original, refined).select("y", "x", "label")).dropDuplicates(["y", "x"])
    bridged = cut(bridged, "bridged")
    return cut(support.restore(original, bridged, support.owners_to_restore(original, bridged)), "published")


def source_support(owned: DataFrame, scales: DataFrame, plane: DataFrame, reach: float) -> DataFrame:
    """owned(y, x, label, residual, rms) with the persistent pixels that no source owns, each to the nearest source within reach."""
    free = scales.select("y", "x").distinct().join(owned.select("y", "x"), ["y", "x"], "left_anti")
    near = support.nearest_seed(owned.select("y", "x", "label"), free, reach).select("y", "x", "label")
    measured_ = plane.where("value is not null and rms > 0").select("y", "x", (F.col("value") - F.col("background")).alias("residual"), "rms")
    return owned.unionByName(near.join(measured_, ["y", "x"]).select(owned.columns))


def detect(plane: DataFrame, image: Image, config: FinderConfig) -> tuple[DataFrame, DataFrame | None]:
    """Accepted labels with S/N and residual, and the persistent features of the continuum profile's matched filters."""
    sigma = [b / S.FWHM for b in image.beam[:2]]
    snr = pixels.normalize_residual(F.col("value"), F.col("background"), F.col("rms"))
    full = plane.withColumn("snr", snr).withColumn("residual", F.col("value") - F.col("background"))
    combined, features = full.withColumn("combined", F.col("snr")), None
    least = config.least_pixels or multiscale.least_pixels(image.beam[:2])
    if config.profile == "continuum":
        bank = multiscale.matched_filters(full.select("y", "x", F.col("residual").alias("value"), "rms"), (sigma[0], sigma[1], image.beam[2]), core=config.core)
        scales = [multiscale.scale_snr(F.col(f"response_{k}"), F.col(f"effective_rms_{k}"), F.col(f"support_{k}")) for k in (1, 2, 3)]
        bank = cut(bank.select("y", "x", *[c.alias(f"snr_{k}") for k, c in enumerate(scales, 1)]), "bank")
        features = scale_features(bank, config, least)
        combined = full.join(bank, ["y", "x"], "left").withColumn("combined", F.greatest("snr", "snr_1", "snr_2", "snr_3")).select(*full.columns, "combined")
    mask = cut(combined.where(F.col("snr") >= config.island_sigma), "mask")
    named = mask.join(labels.label_regions(mask.select("y", "x"), config.core), ["y", "x"])
    if config.profile == "compact":
        good = labels.cut_regions(labels.summarize(named, F.col("snr") > config.detection_sigma), least, config.most_pixels)
    else:
        good = multiscale.detection_rule(named, least, config.detection_sigma)
        if config.most_pixels is not None:
            good = good.where(F.col("n_pixels") <= config.most_pixels)
    return cut(named.join(good.select("label"), "label", "left_semi"), "labels"), features


def measure_components(found: DataFrame, image: Image, config: FinderConfig) -> DataFrame:
    """Deblended regions with their fits: component is the region's first pixel id."""
    parts = deblend.deblend(found.select("y", "x", "label", "snr"), least_peak=config.detection_sigma - 1e-9)
    regions = cut(found.join(parts, ["label", "y", "x"]), "regions")
    sigma = tuple(b / S.FWHM for b in image.beam[:2])
    fits_ = fit.fit_parents(regions.select("y", "x", F.col("label").alias("parent"), "region", F.col("residual").alias("value"), "rms"), (*sigma, image.beam[2]))
    firsts = regions.groupBy("label", "region").agg(F.min(labels.pixel_id(F.col("y"), F.col("x"))).alias("component"))
    return cut(fits_.withColumnRenamed("parent", "label").join(firsts, ["label", "region"]), "components"), regions


def source_groups(regions: DataFrame, components: DataFrame, image: Image, config: FinderConfig) -> DataFrame:
    """(component, group) of measured groups: touching models, and loops, arcs and shared residuals within a label."""
    fitted = components.where("reason is null")
    shape = ["cx", "cy", "sigma_1", "sigma_2", "angle"]
    pairs = fit.touching_models(fitted.select(F.col("component").alias("id"), *shape), 8 * max(image.beam[:2]) + 64)
    touching = connected_components(pairs, "a_id", "b_id").select(F.col("node").alias("component"), F.col("component").alias("group"))
    several = fitted.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    named = regions.join(several, "label", "left_semi").join(components.select("label", "region", "component"), ["label", "region"])
    pixels_ = named.select(F.col("label").alias("feature"), "y", "x", F.col("residual").alias("value"), "rms", F.col("component").alias("label"))
    models = fitted.join(several, "label", "left_semi").select(F.col("label").alias("feature"), F.col("component").alias("id"), *shape, "amplitude")
    sigma = (image.beam[0] / S.FWHM, image.beam[1] / S.FWHM, image.beam[2])
    found = groups.group_components(pixels_, models, sigma, config.detection_sigma, config.island_sigma)
    return association.reconcile_groups(touching, found.select(F.col("id").alias("component"), F.concat_ws("-", "evidence", "group").alias("group")))


def find_sources(image: Image, config: FinderConfig | None = None) -> Found:
    """Run the finder over one image."""
    config = config or FinderConfig()
    plane = estimate_noise(image, config)
    usable = not plane.where("rms > 0").limit(1).isEmpty()
    if config.background == "zero":
        plane = plane.withColumn("background", F.when(F.col("background").isNotNull(), F.lit(0.0)))
    noises, plane = plane, plane if usable else plane.where("false")  # nothing can be found without noise
    found, scales = detect(plane, image, config)
    area = S.BEAM_AREA * image.beam[0] * image.beam[1]
    components, regions = measure_components(found, image, config)
    if config.profile == "continuum":
        measured = source_groups(regions, components, image, config)
        named = regions.join(components.select("label", "region", "component"), ["label", "region"])
        proposed = cut(hierarchy(named, scales), "hierarchy")
    else:
        measured = components.select("component", F.col("component").alias("group")).where("false")
        proposed = measured
    member = association.constrain_memberships(components, measured, measured).drop("proposed")
    member = cut(member, "members")
    flux = F.col("amplitude") * 2 * math.pi * F.col("sigma_1") * F.col("sigma_2") / area
    rows = components.join(member, "component").withColumn("flux", flux).withColumn("flux_error", F.abs(flux / F.col("amplitude") * F.col("amplitude_error")))
    rows = rows.withColumn("component_id", S.stable_id("component", "component", F.col("component"))).withColumn("source_id", S.stable_id("source", "source", F.col("source")))
    if image.wcs is not None:
        xx, xy, yy = S.pixel_covariance(F.col("sigma_1"), F.col("sigma_2"), F.col("angle"))
        rows = rows.withColumn("_p", sky_position(image.wcs, F.col("cx"), F.col("cy"))).withColumn("_s", sky_shape(image.wcs, F.col("cx"), F.col("cy"), xx, xy, yy))
        major, minor, angle = S.ellipse_of(F.col("_s.ee"), F.col("_s.en"), F.col("_s.nn"))
        rows = rows.withColumn("ra", F.col("_p.ra")).withColumn("dec", F.col("_p.dec")).withColumn("major", major).withColumn("minor", minor).withColumn("pa", angle).drop("_p", "_s")
    else:
        rows = rows.withColumn("ra", F.lit(None).cast("double")).withColumn("dec", F.lit(None).cast("double")).withColumn("major", F.col("sigma_1") * S.FWHM).withColumn("minor", F.col("sigma_2") * S.FWHM).withColumn("pa", F.col("angle"))
    rows = cut(rows, "rows")
    # Sources: owned pixels of their components, exclusive apertures around them.
    names = components.select("label", "region", "component").join(member, "component")
    owned = regions.join(names, ["label", "region"]).select("y", "x", F.col("source").alias("label"), "residual", "rms")
    if scales is not None:
        owned = source_support(owned, scales, plane, config.aperture_beams * max(image.beam[:2]))
    owned = cut(owned, "owned")
    valid = plane.where("value is not null and background is not null").select("y", "x", (F.col("value") - F.col("background")).alias("residual"))
    apertures = support.aperture(owned.select("y", "x", "label"), valid.select("y", "x"), config.aperture_beams * max(image.beam[:2])).join(valid, ["y", "x"])
    segments = measure.segment_rows(owned, apertures, area).withColumn("source_id", S.stable_id("source", "source", F.col("label")))
    fits_by_source = rows.where("reason is null").select("source_id", "component_id", "flux", "flux_error", "major", "minor", F.col("pa").alias("angle"))
    sources = measure.source_rows(segments.select("source_id", "flux"), fits_by_source)
    sources = sources.join(segments.select("source_id", "label", "centroid_x", "centroid_y", "peak", F.col("flags").alias("segment_flags")), "source_id")
    sources = sources.withColumn("flags", F.array_sort(F.array_union("flags", "segment_flags"))).drop("segment_flags")
    if image.wcs is not None:
        sources = sources.withColumn("_p", sky_position(image.wcs, F.col("centroid_x"), F.col("centroid_y"))).withColumn("ra", F.col("_p.ra")).withColumn("dec", F.col("_p.dec")).drop("_p")
    islands = measure.island_rows(found.select("y", "x", "label", "residual", "rms"), area)
    return Found(noises, found, islands, rows, sources, published_support(found, scales, config), scales, proposed, usable, {"shape": list(image.shape), "config": asdict(config)})


def open_fits(spark: SparkSession, path: str, **supplied) -> Image:
    """An Image of a FITS file; the beam is turned from sky to pixels at the reference position."""
    meta = fits.image_metadata(path, **supplied)
    fits.register(spark)
    wcs = Wcs(meta["header"])
    reader = spark.read.format("fits")
    if "unit" in supplied:
        reader = reader.option("unit", supplied["unit"])
    if supplied.get("frequency") is not None:
        reader = reader.option("frequency", str(supplied["frequency"]))
    for key, value in zip(("bmaj", "bmin", "bpa"), supplied.get("beam") or (None, None, None), strict=True):
        if value is not None:
            reader = reader.option(key, str(value))
    scale = math.degrees(math.sqrt(float(wcs.pixel_area(*wcs.pixel)[0])))
    major, minor, pa = meta["beam"]
    j = wcs.jacobian(*wcs.pixel)[0]
    east, north = math.sin(math.radians(pa)), math.cos(math.radians(pa))
    dx, dy = np.linalg.solve(j, np.array([east, north]))
    beam = (major / scale, minor / scale, math.degrees(math.atan2(dy, dx)) % 180)
    if beam[0] > 10:
        raise fits.FitsError("the beam is over ten pixels")
    return Image(reader.load(path), meta["shape"], beam, wcs, meta["frequency"])


def publish(found: Found, image: Image, output: str) -> list[dict]:
    """Write catalogue, RMS, mask and diagnostics into a new folder, all or nothing; returns the manifest."""
    cards = [("BUNIT", "Jy/beam")]
    tables = {}
    for name, df, order in (("ISLANDS", found.islands, "label"), ("SOURCES", found.sources, "source_id"), ("GAUSSIAN_COMPONENTS", found.components, "component_id")):
        tables[name] = pa.Table.from_pandas(df.orderBy(order).toPandas(), preserve_index=False)  # rows of objects, not of pixels
    with products.staging_directory(output) as stage:
        target = stage / "products"
        target.mkdir()
        fits.write_tables(str(target / "catalogue.fits"), tables, cards)
        fits.write_plane(str(target / "rms.fits"), image.shape, found.noise.select("y", "x", F.col("rms").alias("value")), cards)
        mask = (found.published if found.published is not None else found.labels).select("y", "x", F.lit(1.0).alias("value"))
        fits.write_plane(str(target / "mask.fits"), image.shape, mask, (), 8)
        counts = {k: len(t) for k, t in tables.items()}
        products.write_json(str(target / "diagnostics.json"), json.loads(json.dumps({"counts": counts, "usable_noise": found.usable, **found.facts})))
        manifest = [products.describe(str(p), p.stem) for p in sorted(target.iterdir())]
        products.write_json(str(target / "manifest.json"), {"products": manifest})
        products.rename_without_replacement(str(target), output)
    return manifest


def find_sources_in_file(spark: SparkSession, path: str, output: str, config: FinderConfig | None = None, **supplied) -> list[dict]:
    """FITS file in, folder of products out; a finished output is described, not made again."""
    done = os.path.join(output, "manifest.json")
    if os.path.exists(done):
        return products.read_json(done)["products"]
    products.reclaim_abandoned_staging(output)
    image = open_fits(spark, path, **supplied)
    return publish(find_sources(image, config), image, output)
