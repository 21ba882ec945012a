"""Rules of single surveys, colours by what a catalog has, and rankings of anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.stats import clip, finite
from skyloom.operators.catalog import choose_epochs, cones
from skyloom.sources.storage import saved

#: Codes of types and of filters.
TYPES = {3: "galaxy", 6: "star"}
FILTERS = {1: "g", 2: "r", 3: "i"}
#: Fixed value: the error of a point that has none.
MISSING_ERROR = 0.1


def looked_up(table: dict[int, str], code: Column, default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for k, v in table.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def with_types(catalog: DataFrame, code: str = "type") -> DataFrame:
    """obj_type from a survey's numeric type."""
    return catalog.withColumn("obj_type", looked_up(TYPES, F.col(code), "unknown"))


def matched_catalog(table: DataFrame, ra: str = "MatchRA", dec: str = "MatchDec", mag: str = "W3_F606W", source_id: str = "MatchID") -> DataFrame:
    """A catalog from a table of matched detections; a magnitude that is not finite is null."""
    return table.select(F.col(source_id).cast("string").alias("source_id"), F.col(ra).cast("double").alias("ra"), F.col(dec).cast("double").alias("dec"), F.when(finite(F.col(mag)), F.col(mag)).cast("double").alias("mag"))


def clean_points(points: DataFrame, flags: str = "catflags", code: str = "filtercode") -> DataFrame:
    """Points without flags, with their band and an error where none is given; other filters fall out."""
    return points.where(F.col(flags) == 0).withColumn("band", looked_up(FILTERS, F.col(code))).where(F.col("band").isNotNull()).withColumn("magerr", F.coalesce("magerr", F.lit(MISSING_ERROR)))


def nested_light_curves(points: DataFrame, by: str = "source_id") -> DataFrame:
    """(source, curves): a map of bands to points in time order. A source's points are a bounded group."""
    band = points.groupBy(by, "band").agg(F.sort_array(F.collect_list(F.struct("mjd", "mag", "magerr"))).alias("points"))
    return band.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("band", "points"))).alias("curves"))


def points_near(points: DataFrame, sources: DataFrame, positions: DataFrame) -> DataFrame:
    """points (source_id, ...) of the sources in the cones of positions (region_id, ra, dec, radius_arcmin), with region_id and sep_arcmin."""
    return points.join(cones(sources, positions).select("region_id", "source_id", "sep_arcmin"), "source_id")


def archive_epochs(observations: DataFrame, missions: list[str], by: list[str], **limits) -> DataFrame:
    """Calibrated images of the missions with a filter and a time, two a filter at least, as choose_epochs thins them."""
    c = F.col
    fine = c("mission").isin(missions) & (c("product") == "image") & (c("calib_level") >= 2) & (F.trim("band") != "") & (F.trim("band") != "--") & finite(c("mjd")) & (c("mjd") > 0)
    kept = observations.where(fine).withColumn("band", F.trim("band")).withColumn("n", F.count("*").over(Window.partitionBy(*by))).where("n >= 2").drop("n")
    return choose_epochs(kept, by, **limits)


def cmd_colour(bp_rp: Column, g_r: Column, g: Column, r: Column, mag: Column) -> Column:
    """bp_rp where it is given, else g_r, else g - r of finite magnitudes; null unless it and mag are finite."""
    colour = F.coalesce(bp_rp, g_r, F.when(finite(g) & finite(r), g - r))
    return F.when(finite(colour) & finite(mag), colour)


def photometric_colour(bp: Column, rp: Column, g: Column, r: Column, mag: Column) -> Column:
    """bp - rp where both are finite and neither is 0, else g - r where both are finite; null without a finite mag."""
    return F.when(finite(mag), F.when(finite(bp) & finite(rp) & (bp != 0) & (rp != 0), bp - rp).when(finite(g) & finite(r), g - r))


def variable_candidates(astrometric: DataFrame, photometric: DataFrame) -> DataFrame:
    """Both kinds of outliers, one after the other; a source may be both."""
    columns = [c for c in astrometric.columns if c in photometric.columns]
    return astrometric.select(*columns, F.lit("astrometric").alias("kind")).unionByName(photometric.select(*columns, F.lit("photometric").alias("kind")))


def inverted(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """anomaly_score: (greatest - score) / (greatest - least) of the group, 0 where all are alike."""
    ends = scores.groupBy(*by).agg(F.max(score).alias("high"), F.min(score).alias("low"))
    joined = scores.join(ends, by) if by else scores.crossJoin(F.broadcast(ends))  # one row without groups
    width = F.col("high") - F.col("low")
    return joined.withColumn("anomaly_score", F.when(width < 1e-10, F.lit(0.0)).otherwise((F.col("high") - F.col(score)) / width)).drop("high", "low")


def masked_top(scores: DataFrame, mask: Column, most: int, score: str = "anomaly_score", order: str = "seq") -> DataFrame:
    """The masked rows with the highest scores."""
    return scores.where(mask).orderBy(F.col(score).desc(), order).limit(most)


def consensus_ranking(ratings: DataFrame, pattern: str = "pattern_id", rating: str = "rating", weight: str = "weight", buckets: int = 1024) -> DataFrame:
    """Patterns with their weighted mean rating and their place, best first; ties by pattern, patterns without a mean last.

    Means that agree to nine digits are ties, as sums of doubles depend on the order of their rows; for the same reason
    the means are written once, so that ends, counts and places are of the same ones. Counts of buckets of ratings give each bucket
    its first place and patterns are ranked within their bucket, so that no task ranks them all.
    """
    means = saved(ratings.groupBy(pattern).agg((F.sum(F.col(rating) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("consensus")).withColumn("_level", F.round("consensus", 9)))
    ends = means.agg(F.min("_level").alias("low"), F.max("_level").alias("high"))
    part = F.floor((F.col("high") - F.col("_level")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * buckets)
    keyed = means.join(F.broadcast(ends)).withColumn("bucket", F.when(F.col("consensus").isNull(), buckets + 1).otherwise(F.coalesce(part, F.lit(0)))).drop("low", "high")
    counts = keyed.groupBy("bucket").agg(F.count("*").alias("n"))  # buckets + 2 rows at most
    start = counts.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("_level").desc(), pattern))
    return keyed.withColumn("nth", nth).join(F.broadcast(start), "bucket").select(pattern, "consensus", (F.col("start") + F.col("nth")).cast("long").alias("place"))


def signal_to_noise(pixels: DataFrame, noise: DataFrame, by: str = "image_id") -> DataFrame:
    """Peak over rms by image; 0 where rms is 0 or less."""
    peak = pixels.groupBy(by).agg(F.max("v").alias("peak"))
    return peak.join(noise.select(by, "rms"), by).select(by, F.when(F.col("rms") > 0, F.col("peak") / F.col("rms")).otherwise(F.lit(0.0)).alias("snr"))


def visible_sources(pixels: DataFrame, places: DataFrame, width: int, height: int, least: float = 2.0, inner: int = 3, outer: int = 30) -> DataFrame:
    """places (place_id, image_id, px, py) with visible: whether the mean around the place stands off its wider surroundings.

    Pixels meet places on cells as wide as the surroundings, so a place reads nine cells and not its image.
    """
    inside = (F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)
    spots = places.where(inside).select("place_id", "image_id", F.col("px").cast("int").alias("cx"), F.col("py").cast("int").alias("cy"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spots = spots.withColumn("a", F.explode(F.transform(near, lambda d: F.floor(F.col("cx") / outer) + d))).withColumn("b", F.explode(F.transform(near, lambda d: F.floor(F.col("cy") / outer) + d)))
    cells = pixels.select("image_id", "x", "y", "v", F.floor(F.col("x") / outer).alias("a"), F.floor(F.col("y") / outer).alias("b"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    met = cells.join(spots, ["image_id", "a", "b"]).where((dx >= -outer) & (dx < outer) & (dy >= -outer) & (dy < outer))
    centre = (F.abs(dx) <= inner) & (F.abs(dy) <= inner)
    seen = met.groupBy("place_id").agg(F.median("v").alias("med"), F.stddev_pop("v").alias("std"), F.count("*").alias("n"), F.avg(F.when(centre, F.col("v"))).alias("mid"))
    seen = seen.select("place_id", ((F.col("n") >= 10) & (F.col("std") >= 1e-10) & (F.abs(F.col("mid") - F.col("med")) / F.col("std") >= least)).alias("visible"))
    return places.join(seen, "place_id", "left").withColumn("visible", F.coalesce("visible", F.lit(False)))


def place_of(pixel_x: Column, pixel_y: Column, ra: Column, dec: Column, reference: tuple[float, float, float, float], scale: float) -> tuple[Column, Column]:
    """Pixel coordinates as given, else from the sky by a linear projection about a reference (ra, dec, x, y), scale degrees a pixel."""
    ra0, dec0, x0, y0 = reference
    return F.coalesce(pixel_x, x0 - (ra - ra0) * F.cos(F.radians(F.lit(dec0))) / scale), F.coalesce(pixel_y, y0 + (dec - dec0) / scale)


def pixel_scale(cdelt: Column) -> Column:
    """Arcseconds a pixel from degrees a pixel."""
    return F.abs(cdelt) * 3600


def _top_means(results: DataFrame, part: int = 5, buckets: int = 1000) -> DataFrame:
    """The mean of each genome's highest part of scores, exact: whole buckets of scores count by their sums, and the one bucket that the limit cuts by its distinct scores."""
    high = F.col("score").isNotNull()
    own = results.where(high).select("genome_id", "score", F.greatest(F.lit(0), F.least(F.floor(F.col("score") * buckets), F.lit(buckets))).alias("bucket"))
    w = Window.partitionBy("genome_id")
    down = lambda c: w.orderBy(F.col(c).desc()).rowsBetween(Window.unboundedPreceding, -1)
    full = own.groupBy("genome_id", "bucket").agg(F.count("*").alias("m"), F.sum("score").alias("total"))
    full = full.withColumn("before", F.coalesce(F.sum("m").over(down("bucket")), F.lit(0))).withColumn("most", F.greatest(F.lit(1), F.floor(F.sum("m").over(w) / part)))
    cut = full.where((F.col("before") < F.col("most")) & (F.col("before") + F.col("m") > F.col("most"))).select("genome_id", "bucket", (F.col("most") - F.col("before")).alias("need"))
    tail = own.join(cut, ["genome_id", "bucket"]).groupBy("genome_id", "need", "score").agg(F.count("*").alias("m"))
    take = F.greatest(F.lit(0), F.least(F.col("m"), F.col("need") - F.coalesce(F.sum("m").over(down("score")), F.lit(0))))
    tail = tail.withColumn("take", take).select("genome_id", F.col("take").alias("m"), (F.col("take") * F.col("score")).alias("total"))
    whole = full.where(F.col("before") + F.col("m") <= F.col("most")).select("genome_id", "m", "total")
    return whole.unionByName(tail).groupBy("genome_id").agg((F.sum("total") / F.sum("m")).alias("anomaly"))


def fitness_components(results: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """anomaly, significance and fitness of each genome from (genome_id, score, novelty, diversity, recovery), a row an image.

    anomaly is the mean of the top fifth of scores, one at least; significance the mean over the deviation, a fifth
    of it, 1 at most (anomaly itself for a single score).
    """
    share = {"anomaly": 0.35, "significance": 0.25, "novelty": 0.15, "diversity": 0.1, "recovery": 0.15} | (weights or {})
    sums = results.groupBy("genome_id").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("novelty", "diversity", "recovery")])
    sums = sums.join(_top_means(results), "genome_id", "left")
    own = F.when(F.col("n") > 1, F.least(F.col("mean") / F.greatest("std", F.lit(0.01)) / 5, F.lit(1.0))).otherwise(F.col("anomaly"))
    sums = sums.withColumn("significance", own)
    return sums.withColumn("fitness", sum((v * F.col(k) for k, v in share.items()), F.lit(0.0))).drop("mean", "std", "n")


def outcome_deltas(before: DataFrame, after: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """What each metric gained from one period to the next; a period that lacks a row counts as 0."""
    joined = before.select(by, *[F.col(m).alias(f"{m}_before") for m in metrics]).join(after.select(by, *[F.col(m).alias(f"{m}_after") for m in metrics]), by, "full")
    return joined.select(by, *[(F.coalesce(f"{m}_after", F.lit(0)) - F.coalesce(f"{m}_before", F.lit(0))).alias(f"{m}_delta") for m in metrics])


def forest_score(decision: Column) -> Column:
    """A retrained forest's decision as a score from 0 to 1."""
    return clip(-decision / 2 + 0.5)


def told(anomalies: DataFrame, properties: str = "properties") -> DataFrame:
    """A line for each anomaly: kind, place (sky before pixels), score and properties in order."""
    c = F.col
    place = F.when(c("ra").isNotNull() & c("dec").isNotNull(), F.format_string("RA=%.4f, Dec=%.4f", "ra", "dec")).when(c("px").isNotNull() & c("py").isNotNull(), F.format_string("pixel (%.0f, %.0f)", "px", "py")).otherwise("unknown location")
    kept = F.array_sort(F.map_entries(properties))
    shown = F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"]))), ", ")
    return anomalies.withColumn("line", F.concat_ws("; ", "anomaly_type", place, F.concat(F.lit("score "), F.format_string("%.3f", "score")), shown))
