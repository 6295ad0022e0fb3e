"""Planes and catalogues derived from the driver's tables, in Spark and as DuckDB CTEs.

A plane is pixels(y long, x long, value double), one row for each pixel that exists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Injected sources: y, x, peak, sigma.
SOURCES = ((100, 20, 1.5, 2.0), (106, 25, 1.2, 2.0), (300, 40, 2.0, 3.0))
NOISE = 0.125  # of the plane of embeddings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as an image: a row for each vector, a column for each component."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "value")).select(
        F.col("y").cast("long"), F.col("x").cast("long"), F.col("value").cast("double")
    )


def plane_inj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane with Gaussian sources added."""
    added = F.lit(0.0)
    for sy, sx, peak, sigma in SOURCES:
        r2 = (F.col("y") - sy) * (F.col("y") - sy) + (F.col("x") - sx) * (F.col("x") - sx)
        added = added + F.lit(peak) * F.exp(-0.5 * r2 / (sigma * sigma))
    return plane(spark, sf_dir).withColumn("value", F.round(F.col("value") + added, 6))


def plane_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense 64 x 128 plane of order values."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 64).alias("y"), (F.col("l_partkey") % 128).alias("x")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("value")
    )


def plane_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse plane: users by hours."""
    ev = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("long") - 473352
    return ev.groupBy(F.col("user_id").alias("y"), hour.alias("x")).agg(F.round(F.sum("value"), 6).alias("value"))


def catalogue_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sky catalogue: id, ra and dec in degrees, flux."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b"))
    return c.select(
        F.col("k").alias("id"),
        ((F.col("k") * 137) % 36000 / 100.0).alias("ra"),
        ((F.col("k") * 71) % 17000 / 100.0 - 85).alias("dec"),
        (F.abs("b") + 1.0).alias("flux"),
    )


def catalogue_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sky seen again: every third source missing, positions and fluxes moved a little."""
    a = catalogue_a(spark, sf_dir).where("id % 3 <> 0")
    return a.select(
        F.col("id"),
        (F.col("ra") + (F.col("id") % 5) * 0.001).alias("ra"),
        (F.col("dec") + (F.col("id") % 7) * 0.001).alias("dec"),
        (F.col("flux") * (1 + (F.col("id") % 11) * 0.01)).alias("flux"),
    )


_ADDED = " + ".join(
    f"{a}*exp(-0.5*((y-{sy})*(y-{sy})+(x-{sx})*(x-{sx}))/({s}*{s}))" for sy, sx, a, s in SOURCES
)
PLANE = """plane AS (SELECT CAST(vec_id AS BIGINT) AS y, unnest(generate_series(0, len(embedding)-1)) AS x,
 CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
PLANE_INJ = f"{PLANE}, plane_inj AS (SELECT y, x, round(value + (0.0 + {_ADDED}), 6) AS value FROM plane)"
PLANE_LI = """plane_li AS (SELECT l_suppkey % 64 AS y, l_partkey % 128 AS x, round(sum(l_extendedprice), 2) AS value
 FROM lineitem GROUP BY 1, 2)"""
PLANE_EV = """plane_ev AS (SELECT user_id AS y, CAST(floor(epoch(ts)/3600) AS BIGINT)-473352 AS x, round(sum(value), 6) AS value
 FROM events GROUP BY 1, 2)"""
CATALOGUES = """catalogue_a AS (SELECT c_custkey AS id, (c_custkey*137) % 36000 / 100.0 AS ra, (c_custkey*71) % 17000 / 100.0 - 85 AS dec,
 abs(c_acctbal) + 1.0 AS flux FROM customer),
catalogue_b AS (SELECT id, ra + (id % 5) * 0.001 AS ra, dec + (id % 7) * 0.001 AS dec, flux * (1 + (id % 11) * 0.01) AS flux
 FROM catalogue_a WHERE id % 3 <> 0)"""
