"""Patterns put into images, and how often a detector's score rises for them.

Patterns are a relation (image_id, injection, kind, x0, y0): their light is one too, which joins the copies of an image as
a sum by pixel. So the images before and after all injections are scored by one plan. Chance comes from
hashes of the image's name, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes in pixels, angles in degrees.
PATTERNS = {
    "arc": {"radius": 30.0, "angle": 90.0, "width": 3.0, "brightness": 200.0},
    "ring": {"radius": 25.0, "width": 3.0, "brightness": 150.0, "completeness": 0.8},
    "overdensity": {"n_sources": 20, "spread": 15.0, "brightness": 300.0},
}
#: What a score must gain for a pattern to count as found, and for it to count as half found.
FOUND, HALF_FOUND = 0.05, 0.01


def scaled(scale: float) -> dict[str, dict[str, float]]:
    """The patterns with radii and spreads fitted to smaller or larger images."""
    return {kind: {k: v * scale if k in ("radius", "spread") else v for k, v in own.items()} for kind, own in PATTERNS.items()}


def unit(*parts: Column) -> Column:
    """A number from 0 up to 1 that the parts decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 2**32


def injections(images: DataFrame, width: int, height: int, margin: int = 50) -> DataFrame:
    """(image_id, injection, kind, x0, y0): each kind of pattern once in each image, from injection 1 on.

    Arcs and rings stand in the middle, overdensities anywhere but within the margin (a quarter of the side at most).
    """
    kinds = F.array(*[F.struct(F.lit(i).alias("injection"), F.lit(k).alias("kind")) for i, k in enumerate(PATTERNS, 1)])
    own = images.select("image_id").distinct().select("image_id", F.inline(kinds))

    def at(size: int, axis: str) -> Column:
        edge = min(margin, size // 4)
        free = edge + F.floor(unit(F.col("image_id"), F.col("kind"), F.lit(axis)) * (size - 2 * edge))
        return F.when(F.col("kind") == "overdensity", free).otherwise(size // 2).cast("int").alias(axis + "0")

    return own.select("*", at(width, "x"), at(height, "y"))


def light(plan: DataFrame, width: int, height: int, patterns: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(image_id, injection, x, y, v): what each pattern adds to the pixels of its image."""
    p = patterns or PATTERNS
    key = ["image_id", "injection"]
    arc, ring, many = p["arc"], p["ring"], p["overdensity"]
    grid = plan.where(F.col("kind") != "overdensity").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    dx, dy = (F.col("x") - F.col("x0")).cast("double"), (F.col("y") - F.col("y0")).cast("double")
    r, theta = F.sqrt(dx * dx + dy * dy), F.atan2(dy, dx)
    chance = lambda name: unit(F.col("image_id"), F.col("kind"), F.lit(name))
    shape = lambda own: own["brightness"] * F.exp(-0.5 * F.pow((r - own["radius"]) / (own["width"] / 2), 2))
    turn = theta - (chance("angle") * (2 * math.pi) - math.pi)
    turn = turn - 2 * math.pi * F.floor(turn / (2 * math.pi))
    bow = F.when((F.abs(r - arc["radius"]) < arc["width"]) & (turn < math.radians(arc["angle"])), shape(arc))
    circle = shape(ring)
    for i in range(int((1 - ring["completeness"]) * 4)):
        gap = F.abs(theta - (chance(f"gap{i}") * (2 * math.pi) - math.pi)) < 0.3 + 0.5 * chance(f"width{i}")
        circle = circle * F.when(gap, 0.1).otherwise(1.0)
    drawn = grid.withColumn("v", F.when(F.col("kind") == "arc", bow).otherwise(circle)).where(F.col("v").isNotNull()).select(*key, "x", "y", "v")

    # Sources lie by the quantiles of a normal spread, a golden angle apart, from a first direction that the image decides.
    n = int(many["n_sources"])
    j = F.col("j")
    stars = plan.where(F.col("kind") == "overdensity").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    away, way = many["spread"] * F.sqrt(-2 * F.ln(1 - (j + 0.5) / n)), chance("angle") * (2 * math.pi) + j * 2.399963229728653
    part = lambda step: (j + 1) * step - F.floor((j + 1) * step)
    stars = stars.select(*key, F.floor(F.col("x0") + away * F.cos(way)).cast("int").alias("sx"), F.floor(F.col("y0") + away * F.sin(way)).cast("int").alias("sy"), (1 + 1.5 * part(0.7548776662466927)).alias("sigma"), (many["brightness"] * (0.3 + 0.7 * part(0.5698402909980532))).alias("flux"))
    stars = stars.where(F.col("sx").between(3, width - 4) & F.col("sy").between(3, height - 4))
    near = F.sequence(F.lit(-3), F.lit(3))
    spots = stars.withColumn("i", F.explode(near)).withColumn("k", F.explode(near))
    psf = F.col("flux") * F.exp(-(F.col("i") * F.col("i") + F.col("k") * F.col("k")) / (2 * F.col("sigma") * F.col("sigma")))
    return drawn.unionByName(spots.select(*key, (F.col("sx") + F.col("i")).alias("x"), (F.col("sy") + F.col("k")).alias("y"), psf.alias("v")))


def injected(pixels: DataFrame, plan: DataFrame, width: int, height: int, patterns: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The images as they are and after each injection, under the names image_id#injection, 0 for the image itself.

    Null and NaN pixels count as 0, and so do absent ones that a pattern lights up.
    """
    v = F.when(F.col("v").isNull() | F.isnan("v"), 0.0).otherwise(F.col("v").cast("double"))
    own = pixels.select("image_id", "x", "y", v.alias("v"))
    copies = own.join(plan.select("image_id", "injection"), "image_id").unionByName(own.withColumn("injection", F.lit(0)))
    every = copies.unionByName(light(plan, width, height, patterns)).groupBy("image_id", "injection", "x", "y").agg(F.sum("v").alias("v"))
    return every.select(F.concat_ws("#", F.col("image_id").cast("string"), "injection").alias("image_id"), "x", "y", "v")


def parted(scores: DataFrame) -> DataFrame:
    """scores of injected images with the image's own name and the number of the injection."""
    return scores.withColumn("injection", F.substring_index("image_id", "#", -1).cast("int")).withColumn("image_id", F.regexp_replace("image_id", "#[0-9]+$", ""))


def gains(scores: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """before, after and credit (1, half or none) of each injection, from (by, image_id, injection, score)."""
    before = scores.where("injection = 0").select(*by, "image_id", F.col("score").alias("before"))
    pairs = scores.where("injection > 0").select(*by, "image_id", "injection", F.col("score").alias("after")).join(before, [*by, "image_id"])
    gain = F.col("after") - F.col("before")
    return pairs.withColumn("credit", F.when(gain > FOUND, 1.0).when(gain > HALF_FOUND, 0.5).otherwise(0.0))


def lens_thresholds(scores: DataFrame, genomes: list[tuple[int, float]]) -> DataFrame:
    """Lens scores of each image under each genome's threshold, without another look at the pixels.

    scores are lens.detect's with a threshold no higher than any genome's; genomes, (id, threshold), are a population,
    bounded by its size. Gives (genome_id, image_id, score, features): arc, ring, completeness, peak, score.
    """
    each = F.array(*[F.struct(F.lit(g).cast("long").alias("genome_id"), F.lit(float(t)).alias("threshold")) for g, t in genomes])
    own = scores.select("image_id", "peak", "arc_snr", "ring_snr", "completeness", F.inline(each))
    c, zero = F.col, F.lit(0.0)
    seen = lambda x, own: F.when(c(own) > c("threshold"), c(x)).otherwise(zero)
    own = own.select("genome_id", "image_id", seen("arc_snr", "arc_snr").alias("arc"), seen("ring_snr", "ring_snr").alias("ring"), seen("completeness", "ring_snr").alias("complete"), F.when(c("peak") > 0, 0.1).otherwise(zero).alias("bright"))
    score = F.least(c("arc") / 10, F.lit(0.4)) + F.least(c("ring") / 10, F.lit(0.3)) + F.when(c("complete") > 0.6, 0.2).otherwise(zero) + c("bright")
    own = own.withColumn("score", F.greatest(zero, F.least(score, F.lit(1.0))))
    return own.select("genome_id", "image_id", "score", F.array(c("arc") / 10, c("ring") / 10, "complete", "bright", "score").alias("features"))


def fitness_inputs(scores: DataFrame, history: int = 20, most: int = 8) -> DataFrame:
    """(genome_id, score, novelty, diversity, recovery), a row an image, from (genome_id, image_id, injection, score, features).

    novelty is 0.7 of a genome's distance from the history (the genomes just before it; 0.5 for the first) and 0.3 the
    share of features above 0.05; diversity is the mean over the greatest distance of its images, of which the first
    most by hash take part, a documented bound; recovery is the mean credit of the injections.
    """
    from skyloom.operators.learning import diversity, euclidean

    own = scores.where("injection = 0")
    place = F.posexplode("features")
    means = own.select("genome_id", place.alias("at", "f")).groupBy("genome_id", "at").agg(F.avg("f").alias("f"))
    means = means.groupBy("genome_id").agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("all")).select("genome_id", F.col("all.f").alias("mean"))
    later = means.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(history)), lambda k: k + F.col("genome_id"))).alias("genome_id"), F.col("mean").alias("past"))
    near = means.join(later, "genome_id", "left").groupBy("genome_id", "mean").agg(F.min(euclidean(F.col("mean"), F.col("past"))).alias("d"))
    active = F.size(F.filter("mean", lambda f: f > 0.05)) / F.size("mean")
    novel = near.select("genome_id", (0.7 * F.coalesce(1 / (1 + F.exp(-(F.col("d") - 3))), F.lit(0.5)) + 0.3 * active).alias("novelty"))
    few = own.select("image_id").distinct().orderBy(F.md5(F.col("image_id").cast("string")), "image_id").limit(most)
    varied = diversity(own.join(F.broadcast(few), "image_id", "left_semi"), ["genome_id"], "image_id", "features")
    found = gains(scores, ["genome_id"]).groupBy("genome_id").agg(F.avg("credit").alias("recovery"))
    return own.select("genome_id", "score").join(novel, "genome_id").join(varied, "genome_id", "left").join(found, "genome_id", "left").na.fill(0.0, ["diversity", "recovery"])
