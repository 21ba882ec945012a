"""Detectors behind one contract, their gates, the envelope of scores, and the anomalies of a survey in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators import evaluation, images, lens, outliers, population, spatial, stencils, tessellation, variability

#: A detector takes the named tables of a survey and gives (region_id, score).
Detector = Callable[[dict[str, DataFrame]], DataFrame]



def _size(image: DataFrame) -> tuple[int, int]:
    """Width and height of the widest and highest image."""
    wide, high = image.agg(F.max("x"), F.max("y")).first()
    return int(wide or 0) + 1, int(high or 0) + 1


def _named(scores: DataFrame, score: str) -> DataFrame:
    return scores.select(F.col("image_id").alias("region_id"), F.col(score).alias("score"))


def lens_scores(t: dict[str, DataFrame], pixel_scale: float | None = None, threshold: float = 3.0, size: tuple[int, int] | None = None) -> DataFrame:
    image = t["image"].withColumnRenamed("region_id", "image_id")
    return _named(lens.detect(image, *(size or _size(image)), pixel_scale, threshold)["scores"], "lens_score")


def morphology_scores(t: dict[str, DataFrame], size: tuple[int, int] | None = None) -> DataFrame:
    image = t["image"].withColumnRenamed("region_id", "image_id")
    return _named(images.morphology(image, *(size or _size(image))), "morphology_score")


def wavelet_scores(t: dict[str, DataFrame], threshold: float = 3.0, size: tuple[int, int] | None = None) -> DataFrame:
    image = t["image"].withColumnRenamed("region_id", "image_id")
    planes = spatial.kept(stencils.wavelet_planes(image, *(size or _size(image))))
    noise = spatial.kept(stencils.wavelet_noise(planes))
    regions = spatial.kept(stencils.wavelet_regions(planes, noise, threshold))
    return _named(stencils.wavelet_scores(noise, regions, stencils.wavelet_objects(regions)), "wavelet_score")


def distribution_scores(t: dict[str, DataFrame], span: float = 100.0) -> DataFrame:
    """Bins, cells and bandwidth are fixed parts of the fields' span."""
    points, by = t["positions"], ["region_id"]
    found = tessellation.distribution_scores(
        tessellation.voronoi_statistics(tessellation.voronoi_cells(points, by), by), spatial.landy_szalay(points, [0.0, 0.2 * span, 0.4 * span, 0.8 * span], by),
        spatial.clark_evans(points, spatial.nearest(points, by, 0.16 * span)), spatial.overdensities(spatial.kernel_density(points, 0.08 * span, 21, 0.0, span, by), by, 21), by,
    )
    return found.select("region_id", F.col("distribution_score").alias("score"))


def temporal_scores(t: dict[str, DataFrame]) -> DataFrame:
    frames = t["frames"].withColumnRenamed("region_id", "image_id")
    diffs = spatial.kept(images.difference(frames, images.reference_stack(frames)))
    found = images.residual_components(images.residual_pixels(diffs, images.difference_noise(diffs)))
    places = found.withColumn("cell", F.concat_ws(",", F.floor(F.col("cx") / 3), F.floor(F.col("cy") / 3)))
    return _named(images.temporal_scores(images.residual_classes(places, ["image_id", "cell"]), ["image_id"]), "temporal_score")


DETECTORS: dict[str, tuple[str, Detector]] = {
    "lens": ("image", lens_scores),
    "morphology": ("image", morphology_scores),
    "wavelet": ("image", wavelet_scores),
    "distribution": ("positions", distribution_scores),
    "temporal": ("frames", temporal_scores),
    "transient": ("catalog", lambda t: outliers.transient_scores(t["catalog"]).select("region_id", F.col("transient_score").alias("score"))),
    "population": ("cmd", lambda t: population.population_scores(t["cmd"]).select("region_id", F.col("population_score").alias("score"))),
    "variability": ("points", lambda t: variability.overall(variability.classify(t["points"]).join(t["points"].select("source_id", "region_id").distinct(), "source_id"), ["region_id"]).select("region_id", F.col("variability_score").alias("score"))),
    "kinematic": ("catalog", lambda t: outliers.kinematic_scores(t["catalog"].groupBy("region_id").agg(F.count("pmra").alias("n_pm")).join(outliers.runaways(t["catalog"]).groupBy("region_id").agg(F.count("*").alias("n_runaways")), "region_id", "left").select("region_id", "n_pm", F.coalesce("n_runaways", F.lit(0)).alias("n_runaways"), F.lit(0).alias("n_groups"), F.lit(0).alias("n_streams"))).select("region_id", F.col("kinematic_score").alias("score"))),
}


def enabled(gates: dict[str, bool], name: str) -> bool:
    """Detectors that the gates don't mention run."""
    return gates.get(name, True)


def scores(tables: dict[str, DataFrame], gates: dict[str, bool] | None = None, detectors: dict[str, tuple[str, Detector]] | None = None) -> DataFrame:
    """(region_id, detector, score) of all enabled detectors whose table is there; the others are never planned."""
    out = None
    for name, (needs, run) in (detectors or DETECTORS).items():
        if enabled(gates or {}, name) and needs in tables:
            own = run(tables).select(F.col("region_id").cast("string").alias("region_id"), F.lit(name).alias("detector"), "score")
            out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no enabled detector has its table")
    return out


def survey(tables: dict[str, DataFrame], gates: dict[str, bool] | None = None, threshold: float = 0.1) -> DataFrame:
    """Regions at or above the threshold with scores, class and verdict: the whole chain as one plan."""
    matrix = evaluation.ensemble(evaluation.score_matrix(scores(tables, gates)))
    kept = matrix.where(F.col("ensemble_score") >= threshold)
    return evaluation.verdicts(evaluation.region_classes(kept, F.lit(0)), 1.5 * F.col("n_agreeing"))


def wide_field(tiles: DataFrame, id_col: str = "source_id", order: str = "tile") -> DataFrame:
    """The union of overlapping tiles' catalogs, each source once, from the first tile that has it."""
    from pyspark.sql import Window

    known = F.col(id_col).isNotNull()
    first = tiles.where(known).withColumn("nth", F.row_number().over(Window.partitionBy("source", id_col).orderBy(order))).where("nth = 1").drop("nth")
    return first.unionByName(tiles.where(~known))


def mosaic(pixels: DataFrame) -> DataFrame:
    """Co-added pixels (x, y on a common grid): means of what overlaps."""
    return pixels.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("x", "y").agg(F.avg("v").alias("v"), F.count("*").alias("coverage"))
