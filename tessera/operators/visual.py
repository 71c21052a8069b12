"""Comparison of images as tables of pixels, and of colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expressions import grayscale, pixel_difference

#: Constants of the similarity index.
C1, C2 = 6.5025, 58.5225


def ssim(x: Column, y: Column) -> Column:
    """Global structural similarity of two columns of gray values: whole means, deviations and covariance."""
    mx, my = F.avg(x), F.avg(y)
    vx, vy, cov = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    return ((2 * mx * my + C1) * (2 * cov + C2)) / ((mx * mx + my * my + C1) * (vx + vy + C2))


def pixel_match(a: DataFrame, b: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """One row per image: pixels, those whose four channels differ in sum by more than threshold * 765, largest and total difference."""
    left = a.select(*key, "x", "y", *(F.col(c).alias(f"{c}1") for c in "rgba"))
    right = b.select(*key, "x", "y", *(F.col(c).alias(f"{c}2") for c in "rgba"))
    d = left.join(right, [*key, "x", "y"]).withColumn("d", pixel_difference([F.col(f"{c}1") for c in "rgba"], [F.col(f"{c}2") for c in "rgba"]))
    return d.groupBy(*key).agg(F.count("*").alias("pixels"), F.sum((F.col("d") > threshold * 765).cast("long")).alias("different"), F.max("d").alias("largest"), F.sum("d").alias("total"))


def colour_histogram(pixels: DataFrame, *key: str) -> DataFrame:
    """Counts by channel and value."""
    channels = F.array(*(F.struct(F.lit(n).alias("channel"), F.col(c).cast("int").alias("bin")) for n, c in (("red", "r"), ("green", "g"), ("blue", "b"))))
    return pixels.select(*key, F.explode(channels).alias("c")).groupBy(*key, "c.channel", "c.bin").agg(F.count("*").alias("n"))


def gray(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("gray", grayscale(F.col("r"), F.col("g"), F.col("b")))
