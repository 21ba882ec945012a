"""Detection pipelines composed of operations on the pixel relation.

An operation takes the pixels of all images and gives them back changed, so a pipeline is one plan over all
images and a generation of pipelines is their union. Images are whole grids: pixels that a relation lacks are 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.images import KEY, label_pixels
from skyloom.operators.spatial import kept
from skyloom.operators.stencils import convolved, gaussian, smoothed

#: Parameters of each operation with their ranges or choices.
OPERATION_PARAMS: dict[str, dict[str, tuple | list[str]]] = {
    "mask_sources": {"radius_px": (2, 20, "int")},
    "subtract_model": {"smooth_sigma": (1, 10, "float")},
    "wavelet_residual": {"scale": (1, 7, "int")},
    "threshold_image": {"percentile": (50, 99, "float")},
    "convolve_kernel": {"kernel_size": (3, 15, "int"), "type": ["gaussian", "laplacian", "tophat"]},
    "cross_correlate": {"smooth_sigma": (1, 10, "float")},
    "combine_masks": {"mode": ["and", "or", "xor"]},
    "region_statistics": {"stat_type": ["mean", "std", "count"]},
    "edge_detect": {"method": ["sobel", "canny"], "threshold": (1, 10, "float")},
    "radial_profile_residual": {"center_method": ["peak", "centroid"]},
}
#: The ways to score what a pipeline leaves.
SCORE_METHODS = ["component_count", "max_residual", "area_fraction"]
#: Pipelines to begin with, as operations with parameters and a way to score.
PRESETS: dict[str, tuple[list[tuple[str, dict]], str]] = {
    "profile_residual": ([("subtract_model", {"smooth_sigma": 5.0}), ("threshold_image", {"percentile": 95}), ("region_statistics", {"stat_type": "count"})], "component_count"),
    "masked_wavelet": ([("mask_sources", {"radius_px": 5}), ("wavelet_residual", {"scale": 3}), ("threshold_image", {"percentile": 97})], "component_count"),
    "residual_edges": ([("subtract_model", {"smooth_sigma": 3.0}), ("edge_detect", {"method": "canny", "threshold": 5.0}), ("threshold_image", {"percentile": 90})], "area_fraction"),
    "radial_wavelet": ([("radial_profile_residual", {"center_method": "peak"}), ("wavelet_residual", {"scale": 2}), ("threshold_image", {"percentile": 95})], "max_residual"),
    "density_correlation": ([("subtract_model", {"smooth_sigma": 8.0}), ("cross_correlate", {"smooth_sigma": 5.0}), ("threshold_image", {"percentile": 92})], "area_fraction"),
    "smoothed_wavelet": ([("wavelet_residual", {"scale": 2}), ("convolve_kernel", {"kernel_size": 5, "type": "gaussian"}), ("threshold_image", {"percentile": 93}), ("region_statistics", {"stat_type": "count"})], "component_count"),
    "masked_radial": ([("mask_sources", {"radius_px": 8}), ("radial_profile_residual", {"center_method": "centroid"}), ("threshold_image", {"percentile": 96})], "max_residual"),
    "laplacian_count": ([("convolve_kernel", {"kernel_size": 7, "type": "laplacian"}), ("threshold_image", {"percentile": 90}), ("region_statistics", {"stat_type": "count"})], "component_count"),
}


@dataclass
class State:
    """What a pipeline has made so far: pixels, sources (image, x, y), the last mask combined, and the mask whose regions are counted."""

    pixels: DataFrame
    sources: DataFrame
    width: int
    height: int
    mask: DataFrame | None = None
    counted: DataFrame | None = None
    statistic: DataFrame | None = None


def dense(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """All pixels of each image's grid; those that lack, or are null or NaN, are 0."""
    rows = pixels.select(*KEY).distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("v", F.lit(0.0))
    own = pixels.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select(*KEY, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.when(F.col("v").isNull() | F.isnan("v"), 0.0).otherwise(F.col("v").cast("double")).alias("v"))
    return rows.unionByName(own).groupBy(*KEY, "x", "y").agg(F.sum("v").alias("v"))


def _of_image(state: State, value: Column, name: str) -> DataFrame:
    return state.pixels.join(state.pixels.groupBy(*KEY).agg(value.alias(name)), KEY)


def _with(state: State, values: DataFrame) -> DataFrame:
    """state's pixels with u, the value that values has for them; by a union and a sum, as both are whole grids."""
    both = state.pixels.select(*KEY, "x", "y", "v", F.lit(0.0).alias("u")).unionByName(values.select(*KEY, "x", "y", F.lit(0.0).alias("v"), F.col("v").alias("u")))
    return both.groupBy(*KEY, "x", "y").agg(F.sum("v").alias("v"), F.sum("u").alias("u"))


def _smooth(state: State, sigma: float) -> DataFrame:
    return smoothed(state.pixels, gaussian(float(sigma)), state.width, state.height)


def mask_sources(state: State, radius_px: int = 5) -> None:
    """Squares around the sources become 0."""
    r = int(radius_px)
    near = state.sources.withColumn("i", F.explode(F.sequence(F.lit(-r), F.lit(r)))).withColumn("j", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    hit = near.select(*KEY, (F.col("x") + F.col("i")).cast("int").alias("x"), (F.col("y") + F.col("j")).cast("int").alias("y")).distinct().withColumn("hit", F.lit(True))
    state.pixels = state.pixels.join(hit, [*KEY, "x", "y"], "left").select(*KEY, "x", "y", F.when(F.col("hit"), 0.0).otherwise(F.col("v")).alias("v"))


def subtract_model(state: State, smooth_sigma: float = 5.0) -> None:
    state.pixels = _with(state, _smooth(state, smooth_sigma)).select(*KEY, "x", "y", (F.col("v") - F.col("u")).alias("v"))


def wavelet_residual(state: State, scale: int = 3) -> None:
    """What the last of so many smoothings, each twice as wide as the one before, takes away."""
    for s in range(int(scale)):
        smooth = kept(_smooth(state, 2**s))
        rest = _with(state, smooth).select(*KEY, "x", "y", (F.col("v") - F.col("u")).alias("v"))
        state.pixels = smooth if s < int(scale) - 1 else rest


def threshold_image(state: State, percentile: float = 90) -> None:
    cut = _of_image(state, F.percentile("v", F.lit(percentile / 100)), "cut")
    state.pixels = cut.select(*KEY, "x", "y", F.when(F.col("v") > F.col("cut"), 1.0).otherwise(0.0).alias("v"))


def convolve_kernel(state: State, kernel_size: int = 5, type: str = "gaussian") -> None:  # noqa: A002
    size = int(kernel_size) + (int(kernel_size) % 2 == 0)
    if type == "laplacian":
        second = {-1: 1.0, 0: -2.0, 1: 1.0}
        parts = [convolved(state.pixels, second, axis, n) for axis, n in (("x", state.width), ("y", state.height))]
        state.pixels = parts[0].unionByName(parts[1]).groupBy(*KEY, "x", "y").agg(F.sum("v").alias("v"))
    elif type == "tophat":
        half = size // 2
        rows = {j: [i for i in range(-half, half + 1) if i * i + j * j <= size * size / 4] for j in range(-half, half + 1)}
        total = sum(map(len, rows.values()))
        out = None
        for j, taps in rows.items():  # a disc is a row of equal weights for each of its lines
            line = convolved(convolved(state.pixels, dict.fromkeys(taps, 1 / total), "x", state.width), {j: 1.0}, "y", state.height)
            out = line if out is None else out.unionByName(line)
        state.pixels = out.groupBy(*KEY, "x", "y").agg(F.sum("v").alias("v"))
    else:
        state.pixels = _smooth(state, size / 4)


def cross_correlate(state: State, smooth_sigma: float = 5.0) -> None:
    """Pixels times the smoothed density of sources, of which the greatest is 1; 0 where an image has no sources."""
    at = [F.greatest(F.lit(0), F.least(F.col(c), F.lit(n - 1))).cast("int").alias(c) for c, n in (("x", state.width), ("y", state.height))]
    points = state.sources.select(*KEY, *at).groupBy(*KEY, "x", "y").agg(F.count("*").cast("double").alias("v"))
    density = smoothed(points, gaussian(float(smooth_sigma)), state.width, state.height)
    own = _with(state, density)
    top = own.groupBy(*KEY).agg(F.max("u").alias("top"))
    state.pixels = own.join(top, KEY).select(*KEY, "x", "y", F.when(F.col("top") > 0, F.col("v") * F.col("u") / F.col("top")).otherwise(0.0).alias("v"))


def combine_masks(state: State, mode: str = "and") -> None:
    """Pixels above 0, combined with those of the last such operation, if any."""
    own = state.pixels.select(*KEY, "x", "y", F.when(F.col("v") > 0, 1.0).otherwise(0.0).alias("v"))
    before, state.mask = state.mask, own
    state.pixels = own
    if before is not None:
        rule = {"or": F.greatest("v", "u"), "xor": F.abs(F.col("v") - F.col("u"))}.get(mode, F.col("v") * F.col("u"))
        state.pixels = _with(state, before).select(*KEY, "x", "y", rule.alias("v"))


def region_statistics(state: State, stat_type: str = "count") -> None:
    """Mean or deviation of the pixels above 0, or the number of their connected regions; the image stays."""
    if stat_type == "count":
        state.counted = state.pixels.where(F.col("v") > 0)
    else:
        above = F.when(F.col("v") > 0, F.col("v"))
        state.statistic = state.pixels.groupBy(*KEY).agg(F.coalesce(F.avg(above) if stat_type == "mean" else F.stddev_pop(above), F.lit(0.0)).alias("statistic"))


def edge_detect(state: State, method: str = "sobel", threshold: float = 3.0) -> None:
    slope, across = {-1: 1.0, 1: -1.0}, {-1: 1.0, 0: 2.0, 1: 1.0}
    gx = convolved(convolved(state.pixels, slope, "x", state.width), across, "y", state.height)
    gy = convolved(convolved(state.pixels, slope, "y", state.height), across, "x", state.width)
    both = gx.withColumn("u", F.lit(0.0)).unionByName(gy.select(*KEY, "x", "y", F.lit(0.0).alias("v"), F.col("v").alias("u"))).groupBy(*KEY, "x", "y").agg(F.sum("v").alias("v"), F.sum("u").alias("u"))
    state.pixels = both.select(*KEY, "x", "y", F.hypot("v", "u").alias("v"))
    if method == "canny":
        own = _of_image(state, F.percentile("v", F.lit((100 - threshold) / 100)), "high")
        state.pixels = own.select(*KEY, "x", "y", F.when(F.col("v") > F.col("high"), 1.0).when(F.col("v") > F.col("high") * 0.4, 0.5).otherwise(0.0).alias("v"))
    else:
        own = _of_image(state, F.stddev_pop("v"), "s")
        state.pixels = own.select(*KEY, "x", "y", F.when(F.col("s") > 0, F.col("v") / F.col("s")).otherwise(F.col("v")).alias("v"))


def radial_profile_residual(state: State, center_method: str = "peak") -> None:
    """Pixels less the mean of those as far, in whole pixels, from the brightest pixel (ties: least y, then x) or the centre of light."""
    if center_method == "centroid":
        w, total = F.abs("v"), F.sum(F.abs("v"))
        middle = lambda c, n: F.when(total > 0, F.sum(F.col(c) * w) / total).otherwise(n / 2)
        centre = state.pixels.groupBy(*KEY).agg(middle("x", state.width).alias("x0"), middle("y", state.height).alias("y0"))
    else:
        m = state.pixels.groupBy(*KEY).agg(F.max(F.struct("v", (-F.col("y")).alias("y"), (-F.col("x")).alias("x"))).alias("m"))
        centre = m.select(*KEY, (-F.col("m.x")).cast("double").alias("x0"), (-F.col("m.y")).cast("double").alias("y0"))
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    own = state.pixels.join(centre, KEY).withColumn("r", F.floor(F.sqrt(dx * dx + dy * dy)))
    profile = own.groupBy(*KEY, "r").agg(F.avg("v").alias("mean_v"))
    state.pixels = own.join(profile, [*KEY, "r"]).select(*KEY, "x", "y", (F.col("v") - F.col("mean_v")).alias("v"))


OPERATIONS: dict[str, Callable[..., None]] = {
    f.__name__: f for f in (mask_sources, subtract_model, wavelet_residual, threshold_image, convolve_kernel, cross_correlate, combine_masks, region_statistics, edge_detect, radial_profile_residual)
}


def run(pixels: DataFrame, sources: DataFrame, pipelines: dict[str, tuple[list[tuple[str, dict]], str]], width: int, height: int) -> DataFrame:
    """(image, pipeline, score) of every pipeline on every image, between 0 and 1.

    Operations of unknown names leave the image as it is. Regions of all pipelines that count them are found by one
    component search.
    """
    base, scored, counted = kept(dense(pixels, width, height)), None, None
    for name, (operations, method) in pipelines.items():
        state = State(base, sources, width, height)
        for op, params in operations:
            if op in OPERATIONS:
                OPERATIONS[op](state, **params)
                state.pixels = kept(state.pixels)  # later operations read them more than once
        out = state.pixels.groupBy(*KEY)
        if method == "max_residual":
            s = F.stddev_pop("v")
            value = out.agg(F.when(s < 1e-10, 0.0).otherwise(F.least(F.max(F.abs("v")) / (5 * s), F.lit(1.0))).alias("score"))
        elif method == "area_fraction":
            share = _of_image(state, F.percentile("v", F.lit(0.9)), "cut").groupBy(*KEY).agg(F.avg((F.col("v") > F.col("cut")).cast("double")).alias("f"))
            f = F.col("f")
            value = share.select(*KEY, F.when(f < 0.005, 0.0).when(f > 0.2, F.greatest(F.lit(0.0), 1 - (f - 0.2) * 5)).otherwise(F.least(f * 10, F.lit(1.0))).alias("score"))
        else:
            mask = state.counted if state.counted is not None else _of_image(state, F.percentile("v", F.lit(0.95)), "cut").where(F.col("v") > F.col("cut"))
            own = mask.select(*KEY, F.lit(name).alias("pipeline"), "x", "y")
            counted = own if counted is None else counted.unionByName(own)
            value = out.agg(F.lit(0.0).alias("score"))
        value = value.withColumn("pipeline", F.lit(name))
        scored = value if scored is None else scored.unionByName(value)
    if counted is not None:
        regions = label_pixels(counted, [*KEY, "pipeline"]).groupBy(*KEY, "pipeline").agg(F.countDistinct("label").alias("n"))
        scored = scored.join(regions, [*KEY, "pipeline"], "left").withColumn("score", F.when(F.col("n").isNotNull(), F.least(F.col("n") / 10, F.lit(1.0))).otherwise(F.col("score")))
    return scored.select(*KEY, "pipeline", F.greatest(F.lit(0.0), F.least("score", F.lit(1.0))).alias("score"))
