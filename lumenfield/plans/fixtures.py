"""Pixel-shaped inputs derived from the given tables (see ``FIXTURES.md``).

64 consecutive vectors of ``embeddings`` form one 64 × 64 picture; the last picture may be only partly captured.
Frame size travels with every pixel, so no operator has to join a picture table to learn it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.functions.colour import luminance
from lumenfield.operators.geometry import with_geometry
from lumenfield.session import dealt

SIZE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixels(image_id, y, x, width, height, label, r, g, b)."""
    src = dealt(table(spark, sf_dir, "embeddings")).select(
        F.floor(F.col("vec_id") / F.lit(64.0)).cast("bigint").alias("image_id"),
        (F.col("vec_id") % 64).cast("int").alias("y"),
        F.col("label").cast("int").alias("label"),
        F.posexplode("embedding").alias("x", "e"),
    )
    rad = F.lit(150.0) * F.exp(F.lit(10.0) * F.col("e").cast("double")) / F.lit(179.0)
    src = src.withColumn("rad", rad)
    return src.select(
        "image_id",
        "y",
        "x",
        F.lit(SIZE).alias("width"),
        F.lit(SIZE).alias("height"),
        "label",
        (F.col("rad") * (F.lit(0.9) + F.lit(0.05) * ((F.col("x") + F.col("label")) % 5))).alias("r"),
        F.col("rad").alias("g"),
        (F.col("rad") * (F.lit(0.8) + F.lit(0.1) * (F.col("y") % 4))).alias("b"),
    )


def lum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px plus ``lum`` in cd/m²."""
    return px(spark, sf_dir).withColumn("lum", luminance())


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lum plus direction, solid angle and validity of a 180° equidistant view."""
    return with_geometry(lum(spark, sf_dir))


def geo_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo(spark, sf_dir).filter("valid")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large grouped input (k, p, line, o, v, w) from the line items; the factor keeps means off the rounding borders of whole cents."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("bigint").alias("k"),
        F.col("l_partkey").cast("bigint").alias("p"),
        F.col("l_linenumber").cast("int").alias("line"),
        F.col("l_orderkey").cast("bigint").alias("o"),
        (F.col("l_extendedprice").cast("double") * F.lit(1.0001234567)).alias("v"),
        F.col("l_quantity").cast("double").alias("w"),
    )
