"""Feature vectors of images: statistics, morphology and texture, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.images import KEY, morphology
from skyloom.operators.stencils import convolved

#: The vector's names in order.
STATISTICS = ["mean", "std", "skew", "kurtosis", "p5", "p25", "median", "p75", "p95", "log_range"]
SHAPES = ["concentration", "asymmetry", "smoothness", "gini", "m20", "ellipticity"]
TEXTURE = ["gradient_mean", "gradient_std", "laplacian_mean", "laplacian_std"]
FEATURES = STATISTICS + SHAPES + TEXTURE
STEP, SMOOTH, BEND = {-1: -1.0, 1: 1.0}, {-1: 1.0, 0: 2.0, 1: 1.0}, {-1: 1.0, 0: -2.0, 1: 1.0}


def finite(pixels: DataFrame) -> DataFrame:
    return pixels.select(*KEY, "x", "y", F.col("v").cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))


def statistics(pixels: DataFrame) -> DataFrame:
    """Moments and percentiles of each image's finite pixels; skew and kurtosis are 0 where all are equal."""
    share = F.percentile("v", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    flat = lambda c: F.when(F.col("std") > 0, F.col(c)).otherwise(0.0).alias(c)
    own = finite(pixels).groupBy(*KEY).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurtosis"), share.alias("p"), F.log1p(F.max("v") - F.min("v")).alias("log_range"))
    return own.select(*KEY, "mean", "std", flat("skew"), flat("kurtosis"), *[F.col("p")[i].alias(c) for i, c in enumerate(STATISTICS[4:9])], "log_range")


def texture(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Mean and deviation, over all width x height pixels, of the Sobel gradient's size and of the Laplacian (its mean without signs).

    Images go on mirrored beyond their sides; absent pixels and those that aren't finite are 0.
    """
    own = finite(pixels)
    across = convolved(convolved(own, STEP, "x", width), SMOOTH, "y", height)
    down = convolved(convolved(own, STEP, "y", height), SMOOTH, "x", width)
    parts = {"gx": [across], "gy": [down], "lap": [convolved(own, BEND, "x", width), convolved(own, BEND, "y", height)]}
    every = None
    for name, found in parts.items():
        for df in found:
            row = df.select(*KEY, "x", "y", *[(F.col("v") if c == name else F.lit(0.0)).alias(c) for c in parts])
            every = row if every is None else every.unionByName(row)
    sums = every.groupBy(*KEY, "x", "y").agg(*[F.sum(c).alias(c) for c in parts])
    n, size = float(width * height), F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    mean = lambda e: F.sum(e) / n
    out = sums.withColumn("g", size).groupBy(*KEY).agg(mean(F.col("g")).alias("g1"), mean(F.col("g") * F.col("g")).alias("g2"), mean(F.abs("lap")).alias("a1"), mean(F.col("lap")).alias("l1"), mean(F.col("lap") * F.col("lap")).alias("l2"))
    spread = lambda one, two: F.sqrt(F.greatest(F.col(two) - F.col(one) * F.col(one), F.lit(0.0)))
    return out.select(*KEY, F.col("g1").alias("gradient_mean"), spread("g1", "g2").alias("gradient_std"), F.col("a1").alias("laplacian_mean"), spread("l1", "l2").alias("laplacian_std"))


def hand_features(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The twenty FEATURES of each image, 0 where one isn't defined; an image without a finite pixel has zeros alone."""
    own = finite(pixels)
    shapes = morphology(own, width, height).select(*KEY, *SHAPES)
    names = pixels.select(*KEY).distinct()
    return names.join(statistics(own), KEY, "left").join(shapes, KEY, "left").join(texture(own, width, height), KEY, "left").na.fill(0.0).select(*KEY, *FEATURES)
