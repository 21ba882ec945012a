"""Sources that are computed: tilings, HEALPix pixels, random regions, and the survey queue."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.sphere import galactic_lat, separation


def hex_tiles(fields: DataFrame, tile_arcmin: float = 3.0, overlap: float = 0.2, most: int = 500) -> DataFrame:
    """Tiles that cover each field (field_id, ra, dec, radius_arcmin): rows a step apart, odd ones shifted by half a step; the first most in order of rows."""
    from pyspark.sql import Window

    step = 2 * tile_arcmin * (1 - overlap) / 60
    reach = F.ceil(F.col("radius_arcmin") / 60 / step).cast("int")
    grid = fields.withColumn("j", F.explode(F.sequence(-reach, reach))).withColumn("i", F.explode(F.sequence(-reach, reach)))
    dec = F.col("dec") + F.col("j") * step
    squeeze = F.greatest(F.cos(F.radians(dec)), F.lit(0.1))
    shift = F.when(F.pmod("j", F.lit(2)) == 1, 0.5).otherwise(0.0)
    grid = grid.where(dec.between(-90, 90)).select("field_id", "j", "i", F.pmod(F.col("ra") + (F.col("i") + shift) * step / squeeze, F.lit(360.0)).alias("tile_ra"), dec.alias("tile_dec"), "ra", "dec", "radius_arcmin")
    inside = grid.where(separation(F.col("ra"), F.col("dec"), F.col("tile_ra"), F.col("tile_dec")) * 60 <= F.col("radius_arcmin"))
    nth = F.row_number().over(Window.partitionBy("field_id").orderBy("j", "i"))
    return inside.withColumn("tile", nth).where(F.col("tile") <= most).select("field_id", "tile", "tile_ra", "tile_dec")


def ring_position(pixel: Column, nside: int) -> tuple[Column, Column]:
    """Right ascension and declination of the centre of a HEALPix pixel in ring order."""
    n, cap, total = float(nside), 2 * nside * (nside - 1), 12 * nside * nside
    south = F.lit(total - 1) - pixel
    polar = F.when(pixel < cap, pixel).otherwise(south) + 1
    ring = F.floor((1 + F.sqrt((2 * polar - 1).cast("double"))) / 2)
    ring = ring - (2 * ring * (ring - 1) >= polar).cast("int")
    nth = polar - 2 * ring * (ring - 1)
    z_cap = 1 - ring * ring / (3 * n * n)
    lon_north = (nth - 0.5) * 90 / ring
    belt = pixel - cap
    row = F.floor(belt / (4 * nside)) + nside
    at = F.pmod(belt, F.lit(4 * nside)) + 1
    shift = F.when(F.pmod(row + nside, F.lit(2)) == 0, 0.5).otherwise(0.0)  # rows alternate by half a pixel
    z_belt = 4 / 3 - 2 * row / (3 * n)
    lon_belt = (at - 1 + shift) * 90 / n
    in_north, in_south = pixel < cap, pixel >= total - cap
    z = F.when(in_north, z_cap).when(in_south, -z_cap).otherwise(z_belt)
    return F.when(in_north, lon_north).when(in_south, 360 - lon_north).otherwise(lon_belt), F.degrees(F.asin(z))


def survey_pixels(spark: SparkSession, nside: int = 64, least_latitude: float = 20.0, order: str = "galactic_latitude", seed: int = 42) -> DataFrame:
    """(pixel, ra, dec, ord) of all pixels off the galactic plane, by latitude (highest first), ring or hash."""
    pixels = spark.range(12 * nside * nside).withColumnRenamed("id", "pixel")
    ra, dec = ring_position(F.col("pixel"), nside)
    out = pixels.select("pixel", ra.alias("ra"), dec.alias("dec")).withColumn("b", galactic_lat(F.col("ra"), F.col("dec"))).where(F.abs("b") >= least_latitude)
    key = {"galactic_latitude": -F.abs("b"), "ring": F.col("pixel"), "random": F.xxhash64("pixel", F.lit(seed))}[order]
    return out.withColumn("ord", key)


def mixed(x: Column) -> Column:
    """A number from 0 to 1 of a whole number, by integers below 2^31, as other engines can make it too."""
    low = F.lit((1 << 31) - 1)
    x = (x.cast("long") * 1103515245 + 12345).bitwiseAND(low)
    x = x.bitwiseXOR(F.shiftright(x, 15))
    x = (x * 1664525 + 1013904223).bitwiseAND(low)
    x = x.bitwiseXOR(F.shiftright(x, 13))
    return (x * 69069 + 1).bitwiseAND(low) / float(1 << 31)


def random_regions(spark: SparkSession, n: int, least_latitude: float = 20.0, radius_arcmin: float = 3.0, seed: int = 42) -> DataFrame:
    """n regions uniform on the sphere off the galactic plane, from a mixed counter, so that reruns agree."""
    over = math.ceil(n / max(0.01, 1 - math.sin(math.radians(least_latitude))) * 1.5) + 64
    drawn = spark.range(over).select("id", (mixed(F.col("id") * 2 + seed) * 360).alias("ra"), F.degrees(F.asin(2 * mixed(F.col("id") * 2 + 1 + seed) - 1)).alias("dec"))
    return drawn.where(F.abs(galactic_lat(F.col("ra"), F.col("dec"))) >= least_latitude).orderBy("id").limit(n).select(F.col("id").alias("region_id"), "ra", "dec", F.lit(radius_arcmin).alias("radius_arcmin"))


def sources_in_regions(regions: DataFrame, sources: DataFrame, radius_arcmin: float) -> DataFrame:
    """regions with the number of sources within the radius and the brightest one's magnitude."""
    from skyloom.operators.spatial import sky_join

    near = sky_join(regions.select("region_id", "ra", "dec"), sources.select("ra", "dec", "mag"), radius_arcmin)
    found = near.groupBy("region_id").agg(F.count("*").alias("n_sources"), F.min("mag_r").alias("brightest"))
    return regions.join(found, "region_id", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))


def regions_from_json(spark: SparkSession, path: str, radius_arcmin: float = 3.0) -> DataFrame:
    read = spark.read.schema("ra double, dec double, radius double").json(path, multiLine=True)
    return read.select("ra", "dec", F.coalesce("radius", F.lit(radius_arcmin)).alias("radius_arcmin"))


def pending(pixels: DataFrame, visited: DataFrame) -> DataFrame:
    return pixels.join(visited.select("pixel"), "pixel", "left_anti")


def next_pixels(pixels: DataFrame, visited: DataFrame, n: int = 1) -> DataFrame:
    return pending(pixels, visited).orderBy("ord", "pixel").limit(n)


def coverage(pixels: DataFrame, visited: DataFrame) -> DataFrame:
    """Totals of the survey: pixels, visited ones among them, remaining, percentage, and those with findings."""
    seen = visited.groupBy("pixel").agg(F.max("n_findings").alias("n_findings"))
    out = pixels.join(seen.withColumn("seen", F.lit(1)), "pixel", "left").agg(F.count("*").alias("total"), F.count("seen").alias("visited"), F.count_if(F.col("n_findings") > 0).alias("with_findings"))
    return out.withColumn("remaining", F.col("total") - F.col("visited")).withColumn("percent", F.when(F.col("total") > 0, F.round(F.col("visited") / F.col("total") * 100, 2)).otherwise(0.0))
