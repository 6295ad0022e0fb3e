"""The workflow adapter: two images of a sector in, catalogue, two RMS images and a mask out."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxweave.functions.scalars import BEAM_AREA
from fluxweave.operators import compare, measure
from fluxweave.plans import finder
from fluxweave.sources import fits, products


class BlankImageError(ValueError):
    """No pixel of the image has usable noise."""


@dataclass(frozen=True)
class SectorConfig:
    """The workflow's names for the two thresholds; the least size follows the beam."""

    threshpix: float
    threshisl: float
    profile: str = "continuum"
    background: str = "zero"

    def __post_init__(self):
        self.finder_config(6)

    def finder_config(self, least_pixels: int) -> finder.FinderConfig:
        return finder.FinderConfig(detection_sigma=self.threshpix, island_sigma=self.threshisl, least_pixels=least_pixels, profile=self.profile, background=self.background)


def least_island_pixels(beam: tuple[float, float, float]) -> int:
    """max(6, a third of the beam's area in pixels)."""
    return max(6, int(BEAM_AREA * beam[0] * beam[1] / 3))


def catalogue_view(found: finder.Found) -> DataFrame:
    """The eight columns the workflow reads."""
    by_source = found.components.groupBy("source_id").agg(F.min("label").alias("label"), F.max("cx_error").alias("_ex"), F.max("cy_error").alias("_ey"))
    joined = found.sources.drop("label").join(by_source, "source_id", "left").join(found.islands.select("label", "island_id"), "label", "left")
    ready = joined.select("source_id", "island_id", "ra", "dec", F.col("_ex").alias("ra_error"), F.col("_ey").alias("dec_error"), "flux", F.col("major").alias("full_major"), F.lit(None).cast("double").alias("axis_major"), "flags")
    return measure.compatibility_view(ready, found.islands)


def find_sector_sources(spark: SparkSession, true_sky: str, flat_noise: str, output: str, config: SectorConfig, **supplied) -> dict[str, str]:
    """Analyse the true-sky image, take the RMS of both, and publish four files in a new folder."""
    image = finder.open_fits(spark, true_sky, **supplied)
    settings = config.finder_config(least_island_pixels(image.beam))
    found = finder.find_sources(image, settings)
    if not found.usable:
        raise BlankImageError(true_sky)
    flat = finder.open_fits(spark, flat_noise, **supplied)
    flat_noise_plane = finder.estimate_noise(flat, settings)
    names = {"catalogue": "source_catalog.fits", "true_sky_rms": "true_sky_rms.fits", "flat_noise_rms": "flat_noise_rms.fits", "mask": "mask.fits"}
    with products.staging_directory(output) as stage:
        target = stage / "products"
        target.mkdir()
        rows = catalogue_view(found).orderBy("Source_id").toPandas()  # a row for each source
        fits.write_tables(str(target / names["catalogue"]), {"SOURCES": pa.Table.from_pandas(rows, preserve_index=False)})
        unit = [("BUNIT", "Jy/beam")]
        for key, plane, im in (("true_sky_rms", found.noise, image), ("flat_noise_rms", flat_noise_plane, flat)):
            fits.write_image(str(target / names[key]), im.shape, products.row_blocks(plane.select("y", "x", F.col("rms").alias("value")), im.shape), unit)
        mask = found.labels.select("y", "x", F.lit(1.0).alias("value"))
        import numpy as np

        fits.write_image(str(target / names["mask"]), image.shape, (np.nan_to_num(b) for b in products.row_blocks(mask, image.shape)), (), 8)
        products.rename_without_replacement(str(target), output)
    return {k: f"{output}/{v}" for k, v in names.items()}


def read_catalogue_view(spark: SparkSession, path: str) -> DataFrame:
    """Strict reader of the eight columns."""
    t = fits.read_tables(path)["SOURCES"]
    wanted = ["Source_id", "RA", "DEC", "Isl_Total_flux", "Total_flux", "DC_Maj", "E_RA", "E_DEC"]
    if t.column_names != wanted:
        raise fits.FitsError(f"columns {t.column_names}")
    return spark.createDataFrame(t.to_pandas(), "Source_id int, RA double, DEC double, Isl_Total_flux double, Total_flux double, DC_Maj double, E_RA double, E_DEC double")


def compare_products(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products of two runs side by side by role: products(role, bytes, sha256)."""
    left, right = (d.select("role", F.col("bytes").alias(f"{n}_bytes"), F.col("sha256").alias(f"{n}_sha256")) for d, n in ((a, "a"), (b, "b")))
    return left.join(right, "role", "full").withColumn("state", F.when(F.col("a_sha256").isNull(), "only-b").when(F.col("b_sha256").isNull(), "only-a").when(F.col("a_sha256") == F.col("b_sha256"), "equal").otherwise("different"))


def compare_cuts(candidate: DataFrame, reference: DataFrame, radius_degrees: float) -> DataFrame:
    """How two catalogues' cuts agree over mutual matches: (id, ra, dec, flux, kept) each; one row."""
    pairs = compare.mutual_pairs(compare.match_candidates(candidate, reference, radius_degrees))
    side = lambda d, p: d.select(F.col("id").alias(f"{p}_id"), F.col("kept").alias(f"_{p}")).hint("merge")  # noqa: E731 - both grow
    both = pairs.join(side(candidate, "a"), "a_id").join(side(reference, "b"), "b_id")
    return both.agg(F.count("*").alias("matched"), F.count_if(F.col("_a") == F.col("_b")).alias("alike"), F.count_if(F.col("_b") & ~F.col("_a")).alias("dropped"), F.count_if(F.col("_a") & ~F.col("_b")).alias("added"))


def pool_comparisons(reports: DataFrame) -> DataFrame:
    """Pooled island reports (n_reference, n_candidate, n_matched, n_split, n_merged) with Wilson intervals."""
    from fluxweave.functions.scalars import wilson_interval

    names = ("n_reference", "n_candidate", "n_matched", "n_split", "n_merged")
    s = reports.agg(F.count("*").alias("cases"), *[F.sum(n).alias(n) for n in names])
    low, high = wilson_interval(F.col("n_matched"), F.col("n_reference"))
    rlow, rhigh = wilson_interval(F.col("n_matched"), F.col("n_candidate"))
    return s.select("*", (F.col("n_matched") / F.nullif("n_reference", F.lit(0))).alias("completeness"), low.alias("completeness_low"), high.alias("completeness_high"), rlow.alias("reliability_low"), rhigh.alias("reliability_high"))


def driver_memory_bytes(shape: tuple[int, int], expected_sources: int) -> int:
    """What the driver needs beside Spark itself: object rows (about 16 kB each) and one block of rows of the image."""
    if min(shape) < 1 or expected_sources < 0:
        raise ValueError("sizes must be positive")
    return 512 * 2**20 + 16_384 * expected_sources + 8 * 256 * shape[1]


def load_external_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Another finder's text catalogue to canonical rows: comma-separated, one commented line of column names."""
    lines = spark.read.text(path).where("value rlike '^[^#]' or value rlike '^# *[A-Za-z_]+ *,'")
    head = lines.where("value rlike '^# *[A-Za-z_]+ *,'").first()[0]
    names = [c.strip() for c in head.lstrip("# ").split(",")]
    parts = F.split("value", ",")
    rows = lines.where("value rlike '^[^#]'").select(*[F.trim(F.get(parts, F.lit(k))).alias(n) for k, n in enumerate(names)])
    number = lambda n: F.col(n).cast("double") if n in names else F.lit(None).cast("double")
    identity = next(n for n in names if n.lower().startswith(("source_id", "gaus_id", "isl_id", "source")))
    return rows.select(F.col(identity).alias("id"), number("RA").alias("ra"), number("DEC").alias("dec"), number("Total_flux").alias("flux"), number("Peak_flux").alias("peak"), number("Maj").alias("major"), number("Min").alias("minor"), number("PA").alias("angle"))
